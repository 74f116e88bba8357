"""Quality by co-training two views of a document.

The content view sees the text: shares of characters, hashed words, word lengths, repeated words and lines. The metadata
view sees what stands beside it: source, language, stated length. Each is a logistic model. In each of ROUNDS rounds every
view scores all documents that are not in the sample of labelled ones. Of those that it is surer of than the other view is,
it hands the EACH that it ranks highest and the EACH that it ranks lowest, none twice, to the other view to learn from, with
its calibrated probabilities as labels: a view that knows little is seldom the surer one. A fold that neither learned from calibrates both,
and a last logistic model over the two calibrated scores weighs them for all documents.

Both views of all documents are computed once and written as a table; rounds and scores read that. Bounds: at most SAMPLE
labelled documents, chosen by a hash of the id, and 4 x EACH others a round come to the driver, each id once, however often
it is repeated; nothing else does. These are chosen by slices of the ids first, so the last task meets at most
2^SLICE_BITS x EACH rows of a list, at any size. An id that stands for several texts is handed on once, by the text that is
surest.

Null counts as the empty text; null metadata is a value of its own. Without labels of both kinds all scores are 1.
An id labelled more than once has the least of its labels. Repeated rows are scored each for itself; of rows with
the same id one (the least by its views) is learned from. Very long texts count by their whole length. Other columns are not
read, so their names clash with nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mix64, pieces, table, tidy, written
from .words import chunks, hashed_words

SAMPLE = 20_000
ROUNDS, EACH = 4, 400
#: What is surest is chosen in 2^SLICE_BITS slices, and then among what these leave: 2^SLICE_BITS times EACH rows of a list at most.
SLICE_BITS = 8
KEEP = 0.5
SOURCES, LANGS, SIZES = 64, 16, 24
WORDS = 256
FIGURES = 128 + 14
CONTENT, META = FIGURES + WORDS, SOURCES + LANGS + SIZES + 1


def figures(text: str) -> np.ndarray:
    """Square roots of the shares of all ASCII characters, and figures about words and lines."""
    raw = text.encode("utf-8", "replace")
    n = max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = text.split(), text.split("\n")
    w = max(1, len(words))
    letters = sum(map(len, words))
    upper = counts[65:91].sum()
    lower = counts[97:123].sum()
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:], strict=False)))
    out = np.empty(FIGURES)
    out[:128] = np.sqrt(counts[:128] / n)
    out[128:] = (
        np.sqrt(counts[128:].sum() / n), upper / max(1, upper + lower), (n - upper - lower - counts[128:].sum() - counts[32] - counts[10]) / n,
        letters / w / 10, distinct / w, distinct / np.sqrt(w) / 10, pairs / w, len(set(lines)) / len(lines), np.log1p(w) / 10,
        np.log1p(len(lines)) / 10, np.log1p(w / len(lines)) / 5, float(w < 20), sum(x.istitle() for x in words) / w, sum(not x[-1].isalnum() for x in words) / w,
    )
    return out


def metadata(source: str | None, lang: str | None, n_chars: int | None) -> list[int]:
    """The places of the ones in the metadata view."""
    place = lambda v, n: zlib.crc32(str(v).encode("utf-8", "replace")) % n if v is not None else n - 1
    size = SIZES - 1 if n_chars is None or n_chars < 0 else min(SIZES - 2, int(n_chars).bit_length())
    return [place(source, SOURCES), SOURCES + place(lang, LANGS), SOURCES + LANGS + size, META - 1]


def words_of(texts: list[str]) -> np.ndarray:
    """Square roots of the shares of words by hash."""
    out = []
    for part in chunks([t.lower() for t in texts]):
        words, first, *_ = hashed_words(part)
        of = np.repeat(np.arange(len(part)), np.diff(first))
        n = np.bincount(of * WORDS + (mix64(words.copy()) >> np.uint64(56)).astype(np.int64) % WORDS, minlength=len(part) * WORDS).reshape(-1, WORDS)
        out.append(np.sqrt(n / np.maximum(1, n.sum(axis=1, keepdims=True))))
    return np.concatenate(out) if out else np.empty((0, WORDS))


def content(texts: list[str]) -> np.ndarray:
    return np.hstack([np.array([figures(t) for t in texts]).reshape(-1, FIGURES), words_of(texts)])


def ones(places: list[list[int]]) -> np.ndarray:
    out = np.zeros((len(places), META))
    for i, p in enumerate(places):
        out[i, p] = 1
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, strength: float) -> np.ndarray:
    """Weights of a logistic model, the constant last and free; Newton's method."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w, pull = np.zeros(x1.shape[1]), np.full(x1.shape[1], strength)
    pull[-1] = 1e-6
    for _ in range(40):
        p = sigmoid(x1 @ w)
        step = np.linalg.solve((x1 * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ x1 + np.diag(pull), x1.T @ (p - y) + pull * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def raw_score(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


class Model:
    """Both views' weights, their calibrations, and the weights of the combination."""

    def __init__(self, view: list[np.ndarray], calibration: list[np.ndarray], joint: np.ndarray) -> None:
        self.view, self.calibration, self.joint = view, calibration, joint

    def score(self, x: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        both = np.stack([raw_score(raw_score(x[i], self.view[i])[:, None], self.calibration[i]) for i in range(2)], axis=1)
        return sigmoid(raw_score(both, self.joint))


Views = tuple[np.ndarray, np.ndarray]
#: Asked with both views' weights and calibrations, gives for each view what it is surest of: both views of these, and its probabilities.
Ask = Callable[[list[np.ndarray], list[np.ndarray]], list[tuple[Views, np.ndarray]]]


def calibrated(x: Views, i: int, view: list[np.ndarray], calibration: list[np.ndarray]) -> np.ndarray:
    return sigmoid(raw_score(raw_score(x[i], view[i])[:, None], calibration[i]))


def surer(p: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.abs(p - 0.5) > np.abs(other - 0.5)


def co_train(x: Views, y: np.ndarray, fold: np.ndarray, ask: Ask | None, rounds: int = ROUNDS) -> Model:
    """x, y: labelled documents, of which those in fold only calibrate. What one view is surest of the other learns from."""
    learn = ~fold
    learned = [[(x[i][learn], y[learn])] for i in range(2)]
    for step in range(rounds + 1):
        view = [fit(*map(np.concatenate, zip(*learned[i], strict=True)), 0.1 if i == 0 else 3.0) for i in range(2)]
        calibration = [fit(raw_score(x[i][fold], view[i])[:, None], y[fold], 1e-2) for i in range(2)]
        if step == rounds or ask is None:
            break
        for i, (found, p) in enumerate(ask(view, calibration)):
            learned[1 - i].append((found[1 - i], p))
    both = np.stack([raw_score(raw_score(x[i][fold], view[i])[:, None], calibration[i]) for i in range(2)], axis=1)
    return Model(view, calibration, fit(both, y[fold], 1.0))


SEEN = "doc_id long, tie long, content binary, places array<int>"


def _views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch):
            a = content([t or "" for t in piece.column("text").to_pylist()]).astype(np.float16)
            b = [metadata(*v) for v in zip(*(piece.column(c).to_pylist() for c in ("source", "lang", "n_chars")), strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("tie"), pa.array([r.tobytes() for r in a], pa.binary()), pa.array(b, pa.list_(pa.int32()))], names=[c.split()[0] for c in SEEN.split(", ")])


def _both(batch: pa.RecordBatch | pa.Table) -> Views:
    a = np.frombuffer(b"".join(batch.column("content").to_pylist()), np.float16).reshape(-1, CONTENT).astype(np.float32)
    return a, ones(batch.column("places").to_pylist())


def _ranked(view: list[np.ndarray], calibration: list[np.ndarray], given: list[frozenset[int]], each: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(list, doc_id, p, tie): of what a task sees, the surest of each view and label (list: 2 * view, and 1 more for the lowest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {k: (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)) for k in range(4)}
        for batch in batches:
            x, ids, tie = _both(batch), batch.column("doc_id").to_numpy(), batch.column("tie").to_numpy()
            both = [calibrated(x, i, view, calibration) for i in range(2)]
            for i in range(2):
                p = both[i]
                free = surer(p, both[1 - i]) & ~np.isin(ids, np.array(sorted(given[i]), np.int64))
                for label in range(2):
                    k = 2 * i + label
                    d, q, t = (np.concatenate(c) for c in zip(best[k], (ids[free], p[free], tie[free]), strict=True))
                    order = np.lexsort((d, t, q if label else -q))
                    d, q, t = d[order], q[order], t[order]
                    one = np.sort(np.unique(d, return_index=True)[1])[:each]
                    best[k] = d[one], q[one], t[one]
        columns = [np.concatenate([best[k][c] for k in range(4)]) for c in range(3)]
        lists = np.repeat(np.arange(4), [len(best[k][0]) for k in range(4)])
        yield pa.RecordBatch.from_arrays([pa.array(lists), *map(pa.array, columns)], names=["list", "doc_id", "p", "tie"])

    return run


def surest(ranked: DataFrame, each: int) -> DataFrame:
    """(list, doc_id, p): the first of each list, an id once in it; by slices of the ids first, so that no task meets what all tasks found."""
    ranked = ranked.withColumn("slice", F.shiftright("tie", 64 - SLICE_BITS)).withColumn("place", F.when(F.col("list") % 2 == 0, -F.col("p")).otherwise(F.col("p")))
    first = ranked.repartition("list", "slice").groupBy("list", "slice", "doc_id", "tie").agg(F.min("place").alias("place"))
    for group in (["list", "slice"], ["list"]):
        order = Window.partitionBy(*group).orderBy("place", "tie", "doc_id")
        first = first.withColumn("n", F.row_number().over(order)).where(F.col("n") <= each)
    return first.select("list", "doc_id", F.abs("place").alias("p"))


def _fetched(seen: DataFrame, ids: list[int]) -> dict[int, tuple[bytes, list[int]]]:
    """The views of a bounded number of ids, each id once."""
    asked = F.broadcast(seen.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long"))
    rows = seen.join(asked, "doc_id").groupBy("doc_id").agg(F.min(F.struct("content", "places")).alias("v"))
    return {r.doc_id: (bytes(r.v.content), r.v.places) for r in rows.collect()}


def _arrays(found: list[tuple[bytes, list[int]]]) -> Views:
    return np.frombuffer(b"".join(f[0] for f in found), np.float16).reshape(-1, CONTENT).astype(np.float32), ones([f[1] for f in found])


def train(seen: DataFrame, labels: DataFrame, sample: int = SAMPLE, each: int = EACH, rounds: int = ROUNDS) -> Model | None:
    """seen: both views of all documents, as a table."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("quality"))
    chosen = {r.doc_id: r.quality for r in known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()}
    if not chosen:
        return None
    found = _fetched(seen, sorted(chosen))
    ids = sorted(found)
    x, y = _arrays([found[i] for i in ids]), np.array([chosen[i] > 0 for i in ids], float)
    fold = np.array([zlib.crc32(str(i).encode()) % 4 == 2 for i in ids], bool)
    if len(set(y[fold])) < 2 or len(set(y[~fold])) < 2:
        return None
    given = [frozenset(ids), frozenset(ids)]
    pool = seen.where("doc_id IS NOT NULL")

    def ask(view: list[np.ndarray], calibration: list[np.ndarray]) -> list[tuple[Views, np.ndarray]]:
        ranked = pool.mapInArrow(_ranked(view, calibration, given, each), "list long, doc_id long, p double, tie long")
        rows = surest(ranked, each).collect()  # 4 * each rows
        views = _fetched(pool, sorted({r.doc_id for r in rows})) if rows else {}
        out = []
        for i in range(2):
            mine = sorted({r.doc_id: r.p for r in sorted(rows, key=lambda r: (abs(r.p - 0.5), r.p)) if r.list // 2 == i}.items())
            given[i] = given[i] | {d for d, _ in mine}
            out.append((_arrays([views[d] for d, _ in mine]), np.array([p for _, p in mine])))
        return out

    return co_train(x, y, fold, ask, rounds)


def _scorer(model: Model | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.ones(batch.num_rows) if model is None else model.score(_both(batch)).astype(float)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return run


@tidy
def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, each: int = EACH, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, score (probability of good quality), kept (score of KEEP or more)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"))
    seen = written(docs.withColumn("tie", F.xxhash64(F.lit("cotrain"), "doc_id")).mapInArrow(_views, SEEN), "views")
    model = train(seen, labels.select("doc_id", "quality"), sample, each, rounds)
    return seen.mapInArrow(_scorer(model), "doc_id long, score double").withColumn("kept", F.col("score") >= KEEP)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
