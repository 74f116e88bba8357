"""Repeated passages by a sparse suffix array over minimisers.

Words are runs without white space, as they stand. Of every WINDOW runs of GRAM words in a text the one with the least
hash is a minimiser; a window of LEAST = GRAM + WINDOW - 1 words holds one, and equal windows hold the same one at the same
place. Only suffixes that begin at a minimiser are kept, and of these only those whose first GRAM words occur elsewhere too.
Every suffix carries RIGHT words that follow and LEFT that precede, as hashes of 32 bits, and which windows are its own.

Suffixes are sorted by what follows. Neighbours are compared to the right and, from the minimiser back, to the left: the
windows that both share are repeated. That settles most, but not suffixes whose twin stands apart in this order
(between them are others that go on alike and begin differently). So a suffix also hands on those of its windows that its
predecessor does not share, as long as some neighbour goes on far enough at all: of every stretch of neighbours that share a
window the first hands it on. Windows are handed on by eights, under a hash of the words that all eight hold; what nobody
else has ends there, and of the rest equal windows are found by their hashes. So every window that occurs twice is found,
however many suffixes begin alike and however they are dealt to tasks and batches; minimisers with up to three suffixes
are compared in full at once.

A passage is a run of repeated windows. At each suffix the outermost repeated windows tell whether it is the first: it
repeats another one if both occur at a lesser (doc_id, word). The least occurrence of a window is never a repeat by
itself, so deleting what repeats leaves one.

Null and empty texts, and texts of fewer than LEAST words, have no passages. Rows without an id are left out. Rows that
repeat an id and a text count once; an id with several texts has the passages of all. Very long texts are handled one at
a time. Other columns are not read, so their names clash with nothing. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, mix64, pieces, table, tidy, written
from .words import NOT_SPACE, chunks, hashed_words

GRAM, WINDOW = 10, 41
LEAST = GRAM + WINDOW - 1
LEFT, RIGHT = WINDOW, LEAST + 2
#: Windows handed on together, and rows whose windows are hashed at once.
TOGETHER, SLICE = 8, 2048
FEW = 3
STEP = np.uint64(0x9E3779B97F4A7C15)
HELD = "key long, n int, doc_id long, pos int, windows long, n_left int, n_right int, following binary, preceding binary"
FOUND = "doc_id long, start int, end int, one long, two long, windows array<long>, starts array<int>"


def sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over every width neighbours, by doubling."""
    have = 1
    out = x
    while have < width:
        step = min(have, width - have)
        out = pick(out[:-step], out[step:])
        have += step
    return out


def minimisers(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, text, word within the text, own windows) of all minimisers of texts whose words stand one after the other; of equal ones all.

    Bit j of the windows: it is the minimiser of the window that begins j words before it."""
    n, none = len(words), (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)
    if n < LEAST:
        return none
    g = np.zeros(n - GRAM + 1, np.uint64)
    for i in range(GRAM):
        g = (g ^ (g >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25) + words[i : n - GRAM + 1 + i]
    g = mix64(g) | np.uint64(1)
    least = sliding(g, WINDOW, np.minimum)
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = of[: len(least)] == of[LEAST - 1 : LEAST - 1 + len(least)]
    least = np.where(inside, least, np.uint64(0))
    pad = np.zeros(WINDOW - 1, np.uint64)
    over = sliding(np.concatenate([pad, least, pad]), WINDOW, np.maximum)
    at = np.flatnonzero(over[: len(g)] == g)
    windows = np.zeros(len(at), np.int64)
    for j in range(WINDOW):
        begin = at - j
        mine = (begin >= 0) & (begin < len(least))
        mine[mine] = least[begin[mine]] == g[at[mine]]
        windows |= mine.astype(np.int64) << j
    return g[at], of[at], at - first[of[at]], windows


def _text_hash(words: np.ndarray) -> int:
    return int((mix64(words * np.uint64(0x8CB92BA72F3D8DD7) + np.arange(len(words), dtype=np.uint64)).sum(dtype=np.uint64) + np.uint64(len(words))).view(np.int64))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch):
            ids, done = piece.column("doc_id").to_numpy(zero_copy_only=False), 0
            for part in chunks(piece.column("text").to_pylist()):
                words, first, *_ = hashed_words(part, NOT_SPACE)
                key, of, pos, windows = minimisers(words, first)
                text = np.zeros(len(part), np.int64)
                for i in np.unique(of).tolist():
                    text[i] = _text_hash(words[first[i] : first[i + 1]])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[done + of].astype(np.int64)), pa.array(text[of]), pa.array(pos.astype(np.int32)), pa.array(windows)], names=["key", "doc_id", "text_hash", "pos", "windows"])
                done += len(part)


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each anchor (key, n, pos, windows) of a text, with the words around it, filled up with zeros."""
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    for batch in batches:
        for piece in pieces(batch):
            anchors, hashes, ids, done = piece.column("anchors"), piece.column("text_hash").to_pylist(), piece.column("doc_id").to_pylist(), 0
            for part in chunks(piece.column("text").to_pylist()):
                words, first, *_ = hashed_words(part, NOT_SPACE)
                small = (words >> np.uint64(32)).astype(np.uint32).astype(">u4")
                rows: list[list] = [[] for _ in kinds]
                for i in range(len(part)):
                    a, b = first[i], first[i + 1]
                    if _text_hash(words[a:b]) != hashes[done + i]:
                        continue
                    own, back = small[a:b].tobytes(), small[a:b][::-1].tobytes()
                    for x in anchors[done + i].as_py():
                        p, n = x["pos"], int(b - a)
                        right, left = own[4 * p : 4 * (p + RIGHT)], back[4 * (n - p) : 4 * (n - p + LEFT)]
                        for out, v in zip(rows, (x["key"], x["n"], ids[done + i], p, x["windows"], len(left) // 4, len(right) // 4, right.ljust(4 * RIGHT, b"\0"), left.ljust(4 * LEFT, b"\0")), strict=True):
                            out.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names=[c.split()[0] for c in HELD.split(", ")])
                done += len(part)


def common(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Number of leading words that two rows share."""
    differ = x != y
    at = np.where(differ.any(axis=1), differ.argmax(axis=1), x.shape[1])
    return np.minimum(at, np.minimum(nx, ny))


def between(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Bits from low to high, of the WINDOW that there are."""
    low, high = np.maximum(low, 0), np.minimum(high, WINDOW - 1)
    return np.where(low <= high, (np.int64(2) << np.maximum(high, 0)) - (np.int64(1) << np.minimum(low, WINDOW)), 0)


def runs(bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, lowest bit, highest bit) of the first runs of ones, then of the second ones, and so on."""
    rows = np.flatnonzero(bits)
    bits = bits[rows]
    while len(rows):
        low = bits & -bits
        rest = bits & (bits + low)
        run = bits ^ rest
        yield rows, octaves(low), octaves(run)
        rows, bits = rows[rest != 0], rest[rest != 0]


def octaves(x: np.ndarray) -> np.ndarray:
    """The number of the highest bit."""
    return np.frexp(x.astype(float))[1].astype(np.int64) - 1


class Suffixes:
    """Some suffixes in order, as arrays."""

    def __init__(self, batch: pa.RecordBatch | pa.Table) -> None:
        column = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) if isinstance(batch, pa.RecordBatch) else batch[c].to_numpy().astype(np.int64)
        self.key, self.n, self.doc, self.pos, self.windows, self.n_left, self.n_right = (column(c.split()[0]) for c in HELD.split(", ")[:7])
        words = lambda c, width: np.frombuffer(b"".join(batch.column(c).to_pylist()), ">u4").astype(np.uint32).reshape(-1, width)
        self.right, self.left = words("following", RIGHT), words("preceding", LEFT)

    def taken(self, which: np.ndarray | slice) -> Suffixes:
        out = object.__new__(Suffixes)
        out.__dict__ = {k: v[which] for k, v in self.__dict__.items()}
        return out

    def joined(self, other: Suffixes) -> Suffixes:
        out = object.__new__(Suffixes)
        out.__dict__ = {k: np.concatenate([v, other.__dict__[k]]) for k, v in self.__dict__.items()}
        return out

    def distinct(self) -> Suffixes:
        """Without rows that equal the one before (they come from rows that repeat an id and a text)."""
        new = np.ones(len(self.key), bool)
        same = lambda x: (x[1:] == x[:-1]) if x.ndim == 1 else (x[1:] == x[:-1]).all(axis=1)
        new[1:] = ~(same(self.key) & same(self.doc) & same(self.pos) & same(self.left) & same(self.right))
        return self.taken(new)

    def shared(self, step: int) -> tuple[np.ndarray, np.ndarray]:
        """For every row but the last step ones and the one step further: the windows that both share, and the words that follow alike."""
        i, j = slice(None, -step), slice(step, None)
        same = self.key[i] == self.key[j]
        after = np.where(same, common(self.right[i], self.n_right[i], self.right[j], self.n_right[j]), 0)
        before = common(self.left[i], self.n_left[i], self.left[j], self.n_left[j])
        place = (self.doc[i] != self.doc[j]) | (self.pos[i] != self.pos[j])
        return np.where(same & place, between(LEAST - after, before), 0), after

    def hashes(self, rows: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of the words from begin to end, counted from the minimiser, for each of the rows."""
        out = np.empty(len(rows), np.uint64)
        for a in range(0, len(rows), SLICE):
            r = rows[a : a + SLICE]
            words = np.concatenate([self.left[r][:, ::-1], self.right[r]], axis=1).astype(np.uint64)
            power = np.cumprod(np.full(words.shape[1], STEP, np.uint64), dtype=np.uint64)
            total = np.concatenate([np.zeros((len(r), 1), np.uint64), np.cumsum(mix64(words + np.uint64(1)) * power, axis=1, dtype=np.uint64)], axis=1)
            at, b, e = np.arange(len(r)), begin[a : a + SLICE] + LEFT, end[a : a + SLICE] + LEFT
            back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(words.shape[1], pow(int(STEP), -1, 1 << 64), np.uint64)]), dtype=np.uint64)
            out[a : a + SLICE] = mix64((total[at, e] - total[at, b]) * back[b] + (e - b).astype(np.uint64))
        return out.view(np.int64)


def _settled(s: Suffixes, from_row: int, to_row: int, starts: bool, ends: bool) -> Iterator[pa.RecordBatch]:
    """What the rows from from_row to to_row show; the others are their neighbours. starts, ends: nothing comes before the first, after the last row (of the partition)."""
    n = len(s.key)
    confirmed, prior, after = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for step in (1, 2):
        if n > step:
            windows, follow = s.shared(step)
            confirmed[step:] |= windows
            confirmed[:-step] |= windows
            if step == 1:
                prior[1:] = windows
                after[1:] = follow
                after[:-1] = np.maximum(after[:-1], follow)
    if starts:  # what stands in the partition before, and after, is unknown
        after[:1] = RIGHT
    if ends:
        after[-1:] = RIGHT
    new = np.concatenate([[True], s.key[1:] != s.key[:-1]])
    number = np.cumsum(new) - 1
    whole = (np.bincount(number)[number] == s.n) & (s.n <= FEW)
    confirmed &= s.windows
    possible = between(LEAST - after, s.n_left) & s.windows & between(LEAST - s.n_right, s.n_left)
    handed = np.where(whole, 0, possible & ~prior)
    inside = np.arange(n)
    inside = (inside >= from_row) & (inside < to_row)
    confirmed, handed = np.where(inside, confirmed, 0), np.where(inside, handed, 0)
    names = [c.split()[0] for c in FOUND.split(", ")]
    nothing = lambda m, kind: pa.nulls(m, kind)
    for rows, low, high in runs(confirmed):
        one, two = s.hashes(rows, -high, LEAST - high), s.hashes(rows, -low, LEAST - low)
        start, end = (s.pos[rows] - high).astype(np.int32), (s.pos[rows] - low + LEAST).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(s.doc[rows]), pa.array(start), pa.array(end), pa.array(one), pa.array(two), nothing(len(rows), pa.list_(pa.int64())), nothing(len(rows), pa.list_(pa.int32()))], names=names)
    for j in range(0, WINDOW, TOGETHER):
        last = min(j + TOGETHER, WINDOW) - 1
        some = (handed >> j) & ((1 << (last - j + 1)) - 1)
        rows = np.flatnonzero(some)
        if not len(rows):
            continue
        core = s.hashes(rows, np.full(len(rows), -j), np.full(len(rows), LEAST - last)) ^ np.int64(j)
        each = [np.where(some[rows] >> k & 1 == 1)[0] for k in range(last - j + 1)]
        owner = np.concatenate(each)
        offset = np.concatenate([np.full(len(x), j + k) for k, x in enumerate(each)])
        order = np.argsort(owner, kind="stable")
        owner, offset = owner[order], offset[order]
        window = s.hashes(rows[owner], -offset, LEAST - offset)
        ends_at = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(rows)))]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends_at), pa.array(v)) for v in (window, (s.pos[rows[owner]] - offset).astype(np.int32))]
        yield pa.RecordBatch.from_arrays([pa.array(s.doc[rows]), nothing(len(rows), pa.int32()), nothing(len(rows), pa.int32()), pa.array(core), nothing(len(rows), pa.int64()), *lists], names=names)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated windows of neighbours, and windows that are handed on, by row; a row waits for the two that follow it."""
    held, waiting, starts = None, 0, True
    keep = 2 * FEW
    for batch in batches:
        if not batch.num_rows:
            continue
        held = Suffixes(batch) if held is None else held.joined(Suffixes(batch))
        held = held.distinct()
        to = max(waiting, len(held.key) - keep)
        if to > waiting:
            yield from _settled(held, waiting, to, starts, False)
            cut = max(0, to - keep)
            held, waiting, starts = held.taken(slice(cut, None)), to - cut, starts and cut == 0
    if held is not None and waiting < len(held.key):
        yield from _settled(held, waiting, len(held.key), starts, True)


@tidy
def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start_word, end_word, n_words, repeats): the passages of LEAST words or more that occur more than once,
    apart for those that repeat an earlier occurrence and those that are the first."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(f"doc_id IS NOT NULL AND length(text) >= {2 * LEAST - 1}")
    anchors = written(docs.mapInArrow(_anchors, "key long, doc_id long, text_hash long, pos int, windows long"), "anchors")
    differ = " OR ".join(f"min({c}) <> max({c})" for c in ("doc_id", "pos"))
    keys = written(anchors.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.expr(differ).alias("several")).where("several").select("key", F.least(F.col("n"), F.lit(FEW + 1)).cast("int").alias("n")), "repeated-keys")
    kept = anchors.join(keys, "key").select("doc_id", "text_hash", F.struct("key", "n", "pos", "windows").alias("a")).distinct()
    by_text = written(kept.groupBy("doc_id", "text_hash").agg(F.collect_list("a").alias("anchors")), "by-text")
    dropped(anchors, keys)  # before the texts travel
    held = written(docs.join(by_text, "doc_id").mapInArrow(_suffixes, HELD), "suffixes")
    dropped(by_text)
    order = ["key", "following", "doc_id", "pos", "preceding"]
    compared = written(held.repartitionByRange(*order[:4]).sortWithinPartitions(*order).mapInArrow(_compare, FOUND), "found")
    dropped(held)
    handed = compared.where("windows IS NOT NULL").select("doc_id", F.col("one").alias("core"), "windows", "starts")
    cores = written(handed.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core"), "cores")
    windows = handed.join(cores, "core").select("doc_id", F.explode(F.arrays_zip("windows", "starts")).alias("w")).select("doc_id", F.col("w.windows").alias("one"), F.col("w.starts").alias("start")).distinct()
    windows = written(windows, "windows")
    twice = written(windows.groupBy("one").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("one"), "twice")
    apart = windows.join(twice, "one").select("doc_id", "start", (F.col("start") + LEAST).alias("end"), "one", F.col("one").alias("two"))
    spans = written(compared.where("windows IS NULL").select("doc_id", "start", "end", "one", "two").unionByName(apart).distinct(), "spans")
    ends = spans.select("doc_id", "start", F.col("one").alias("window")).unionByName(spans.select("doc_id", (F.col("end") - LEAST).alias("start"), F.col("two").alias("window")))
    least = written(ends.groupBy("window").agg(F.min(F.struct("doc_id", "start")).alias("least")), "first")
    of = lambda c: least.select(F.col("window").alias(c), F.col("least").alias(f"least_{c}"))
    earlier = lambda c, start: F.col(f"least_{c}") < F.struct(F.col("doc_id"), start.alias("start"))
    told = spans.join(of("one"), "one").join(of("two"), "two").select("doc_id", "start", "end", (earlier("one", F.col("start")) & earlier("two", F.col("end") - LEAST)).alias("repeats"))
    order = Window.partitionBy("doc_id", "repeats").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum((F.coalesce(F.col("start") > F.col("reach"), F.lit(True))).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    islands = told.withColumn("reach", reach).withColumn("island", island).groupBy("doc_id", "repeats", "island").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"))
    return islands.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "repeats")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
