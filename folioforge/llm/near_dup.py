"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles, verified by weighted Jaccard similarity.

Shingles are five words in lower case. The weight of a shingle in a text is its term frequency in octaves,
1 + floor(log2(occurrences)), times its inverse document frequency: a line that fills most of a text by being repeated
does not make it a copy of all others that repeat the line, and lines that stand in many documents count for little.

The inverse document frequency is log(share) / log(COMMON), between LOWEST and 1; the share is taken of all documents
and 1 / COMMON more that have nothing, so that the rule is the same at every size and what a single document has
weighs 1. Documents that are kin count as one: the copies of a group that is itself a large part of all documents would
otherwise make their own text worthless. Kin share one of KIN keys, each of the least shingles of AGREE parts of the hash
space (of texts that are similar at 0.85 about 1 in 100 is no kin, of texts that share a fifth 1 in 20 is); a document
counts as one over the number of its kin wherever these are more than a share HEAVY of all (below that, a group is too
small to be common by itself). Common shingles are found by Misra-Gries summaries of all documents, whose error is known,
and all that may be common are counted again exactly. There are at most about 2 / COMMON times the mean number of
shingles of a document of them, and KIN / HEAVY heavy kin: bounds that do not grow with the corpus.

Texts with the same words are one class from the start; the first of them (by id) stands for it. SAMPLES consistent
weighted samples (shingle, t) of each make BANDS keys. What shares a key is a bucket:

* up to MOST members, all pairs are compared;
* larger ones are cut to chunks, each compared within and with the bucket's first member;
* a larger bucket whose members these comparisons do not make one class is settled exactly. In rounds, all its members
  meet a hub with the most frequent elements (an original has no edits of its own), until a round no longer halves what
  is open. Of the rest, every pair that can be similar and is not yet in one class is compared, found by prefixes:
  with elements from rare to frequent, the first one that two texts share leaves both with weight enough to be similar.

Comparisons are of 64-bit hashes of (shingle, octave). Links (similarity of LEAST or more) connect classes; the class id
is the least doc_id. The banding misses a pair with similarity 0.8 with probability 0.002, and less for more similar ones;
a pair that shares a bucket is compared or already connected, however large the bucket.

Null counts as the empty text; texts without words are one class. Rows without an id are in no class: class_id is
null, they are kept. Rows that repeat an id are in the classes of their texts (texts with the same least id are one
class). Very long texts are handled like others, a text at a time. Other columns are not read, so their names clash with
nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, pieces, table, tidy, written
from .components import connected_components
from .words import chunks, hashed_words, shingles

WIDTH, LEAST = 5, 0.8
SAMPLES, BANDS = 48, 12
COMMON, LOWEST = 0.02, 0.02
KIN, AGREE, HEAVY = 5, 3, 0.005
MOST = 128
#: Counters of a summary at least, and shingles that wait to be merged into one.
COUNTERS, WAITING = 1 << 16, 1 << 20
#: What a document without kin counts; all counts are whole numbers, so that they do not depend on the order of sums.
UNIT = 1 << 24
PART = np.uint64((1 << 48) - 1)
#: Counters of the frequencies that order elements (any order is right), and slack for sums of 32-bit weights.
SLOTS, SLACK = 1 << 18, 1e-4
#: Shingles whose samples are drawn at once: what fits a processor's cache.
BLOCK = 1 << 14

SEEDS = mix64(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
ODD = mix64(np.arange(1001, 1001 + SAMPLES, dtype=np.uint64)) | np.uint64(1)
KEYS = [f"k{i}" for i in range(BANDS)]


def _gamma_steps(steps: int = 1 << 16) -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of equal steps: the inverse of 1 - (1 + x) exp(-x), by bisection."""
    u, low, high = (np.arange(steps) + 0.5) / steps, np.zeros(steps), np.full(steps, 50.0)
    for _ in range(60):
        x = (low + high) / 2
        less = 1 - (1 + x) * np.exp(-x) < u
        low, high = np.where(less, x, low), np.where(less, high, x)
    return low


GAMMA = _gamma_steps()
RATE, LOG_C = GAMMA.astype(np.float32), np.log(GAMMA).astype(np.float32)


class Idf:
    """Weights of the common shingles (48 bits, sorted); all others weigh 1."""

    def __init__(self, shingle: np.ndarray, weight: np.ndarray) -> None:
        self.shingle, self.weight = shingle, weight.astype(np.float32)

    def of(self, shingle: np.ndarray) -> np.ndarray | None:
        if not len(self.shingle):
            return None
        at = np.minimum(np.searchsorted(self.shingle, shingle), len(self.shingle) - 1)
        hit = self.shingle[at] == shingle
        return np.where(hit, self.weight[at], np.float32(1)) if hit.any() else None


def sorted_shingles(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By chunk: number of texts, the shingles (48 bits) sorted within each text, the text of each, and its words."""
    for part in chunks([(t or "").lower() for t in texts]):
        words, first, *_ = hashed_words(part)
        for a in range(0, len(part), 60_000):  # a text's number has 16 bits
            f = first[a : a + 60_001]
            s, of = shingles(words[f[0] : f[-1]], f - f[0], WIDTH)
            key = np.sort((of.astype(np.uint64) << np.uint64(48)) | (s & PART))
            yield len(f) - 1, key & PART, (key >> np.uint64(48)).astype(np.int64), words[f[0] : f[-1]], f - f[0]


def counted(shingle: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each text, the text of each, and how often it occurs there."""
    new = np.ones(len(shingle), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(new)
    return shingle[at], of[at], np.diff(at, append=len(shingle))


def octaves(count: np.ndarray) -> np.ndarray:
    """1 + floor(log2(count))."""
    return np.frexp(count.astype(float))[1].astype(np.int64)


def elements(shingle: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of (shingle, octave) for every octave that a shingle reaches in its text, and the shingle and text of each."""
    shingle, of, count = counted(shingle, of)
    n = octaves(count)
    first = np.cumsum(n) - n
    octave = (np.arange(int(n.sum())) - np.repeat(first, n)).astype(np.uint64)
    shingle, of = np.repeat(shingle, n), np.repeat(of, n)
    return mix64(shingle + octave * np.uint64(0xC2B2AE3D27D4EB4F)), shingle, of


def kin(n: int, shingle: np.ndarray, of: np.ndarray) -> np.ndarray:
    """KIN keys for each of n texts: the hash space has KIN * AGREE parts, and a key is made of the least shingles of AGREE of them; -1: without words."""
    parts = KIN * AGREE
    if not len(shingle):
        return np.full((n, KIN), -1, np.int64)
    key = (of.astype(np.uint64) << np.uint64(48)) | shingle
    width = np.uint64((1 << 48) // parts)
    low = (np.arange(n, dtype=np.uint64) << np.uint64(48))[:, None] + np.arange(parts, dtype=np.uint64)[None, :] * width
    at = np.searchsorted(key, low.ravel()).reshape(n, parts)
    least = key[np.minimum(at, len(key) - 1)]
    found = (at < len(key)) & (least - low < width)
    least = np.where(found, least & PART, np.uint64(0)).reshape(n, KIN, AGREE)
    out = np.broadcast_to(np.arange(1, KIN + 1, dtype=np.uint64), (n, KIN)).copy()
    for i in range(AGREE):
        out = mix64(out ^ (least[:, :, i] + np.uint64(i)))
    out = (out & np.uint64((1 << 63) - 1)).astype(np.int64)
    return np.where(found.any(axis=1)[:, None], out, -1)


def samples(shingle: np.ndarray, weight: np.ndarray | None, first: np.ndarray) -> np.ndarray:
    """SAMPLES consistent weighted samples (32 bits of shingle and t) of each text; first: where the texts' shingles begin.

    For a shingle of weight S: t = floor(ln S / r + beta), ln y = r (t - beta), and the shingle with the least
    ln c - ln y - r is, with its t, the sample, where r, c are from Gamma(2, 1) and beta is uniform, hashed from shingle and
    sample. Without weights all are 1, and t is 0.
    """
    out = np.empty((len(first), SAMPLES), np.uint32)
    log_s = None if weight is None else np.log(weight).astype(np.float32)
    low = shingle & np.uint64(0xFFFFFFFF)
    packed = np.empty(len(shingle), np.uint64)
    for j in range(SAMPLES):
        for a in range(0, len(shingle), BLOCK):
            u = (shingle[a : a + BLOCK] ^ SEEDS[j]) * ODD[j]
            u ^= u >> np.uint64(32)
            u *= np.uint64(0xD6E8FEB86659FD93)
            u ^= u >> np.uint64(29)
            value, r = LOG_C[(u >> np.uint64(16)) & np.uint64(0xFFFF)], RATE[u & np.uint64(0xFFFF)]
            u >>= np.uint64(32)
            beta = u.astype(np.float32)
            beta *= np.float32(2.0**-32)
            name = low[a : a + BLOCK]
            if log_s is not None:
                t = np.floor(log_s[a : a + BLOCK] / r + beta)
                beta -= t
                name = name ^ (t.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) & np.uint64(0xFFFFFFFF))
            beta -= np.float32(1)
            beta *= r
            value += beta
            value += np.float32(64)
            value *= np.float32(2.0**25)
            np.bitwise_or(value.astype(np.uint64) << np.uint64(32), name, out=packed[a : a + BLOCK])
        out[:, j] = np.minimum.reduceat(packed, first) & np.uint64(0xFFFFFFFF)
    return out


class Summary:
    """A Misra-Gries summary of weighted shingles: what the first counter beyond the limit has is taken from all.

    missed: what a count may be too low by. The number of counters follows the mean number of shingles of a document, so that
    this stays below a quarter of what is common; leaving out what is rare at the end adds a quarter at most."""

    def __init__(self) -> None:
        self.item, self.count = np.empty(0, np.uint64), np.empty(0)
        self.missed = self.total = self.texts = 0.0

    def add(self, item: np.ndarray, weight: np.ndarray) -> None:
        items, at = np.unique(np.concatenate([self.item, item]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([self.count, weight]), len(items))
        self.total += weight.sum()
        limit = max(COUNTERS, int(4 / COMMON * self.total / max(self.texts, UNIT)))
        if len(items) > limit:
            drop = np.partition(counts, len(counts) - limit - 1)[len(counts) - limit - 1]
            self.missed += drop
            counts = counts - drop
        self.item, self.count = items[counts > 0], counts[counts > 0]

    def closed(self) -> None:
        """Leaves out what is rare in the partition, however few texts it has: up to a quarter of what would be common there."""
        rare = self.count <= COMMON / 4 * self.texts
        self.missed += self.count[rare].max(initial=0)
        self.item, self.count = self.item[~rare], self.count[~rare]


def weights_of(n: int, shingle: np.ndarray, of: np.ndarray, heavy: dict[int, int]) -> np.ndarray:
    """What each text counts: UNIT, or UNIT by the number of its kin where these are heavy."""
    of_kin = kin(n, shingle, of)
    keys = np.array(sorted(heavy), np.int64)
    if not len(keys):
        return np.full(n, float(UNIT))
    at = np.minimum(np.searchsorted(keys, of_kin), len(keys) - 1)
    size = np.where(keys[at] == of_kin, np.array([heavy[k] for k in keys.tolist()])[at], 1).max(axis=1)
    return np.maximum(UNIT // size, 1).astype(float)


def _kin_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of a batch have a kin key; -1: how many have words."""
    for batch in batches:
        have, texts = [np.empty(0, np.int64)], 0
        for piece in pieces(batch):
            for n, shingle, of, *_ in sorted_shingles(piece.column("text").to_pylist()):
                found = kin(n, shingle, of)
                texts += int((found >= 0).any(axis=1).sum())
                have.append(found[found >= 0])
        key, count = np.unique(np.concatenate(have), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array([*key, -1], pa.int64()), pa.array([*count, texts], pa.int64())], names=["kin", "n"])


def _counter(candidates: np.ndarray | None, heavy: dict[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Weighted document frequencies of a partition: of the candidates, or in a summary with what it missed (shingle -1) and all texts (-2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = Summary()
        exact = np.zeros(0 if candidates is None else len(candidates))
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for piece in pieces(batch):
                for n, shingle, of, *_ in sorted_shingles(piece.column("text").to_pylist()):
                    weight = weights_of(n, shingle, of, heavy)
                    found, owner, _ = counted(shingle, of)
                    w = weight[owner]
                    summary.texts += weight[np.unique(owner)].sum()
                    if candidates is None:
                        waiting.append((found, w))
                        if sum(len(x[0]) for x in waiting) > WAITING:
                            summary.add(*map(np.concatenate, zip(*waiting, strict=True)))
                            waiting = []
                    else:
                        at = np.minimum(np.searchsorted(candidates, found), len(candidates) - 1)
                        hit = candidates[at] == found
                        exact += np.bincount(at[hit], w[hit], minlength=len(candidates))
        if waiting:
            summary.add(*map(np.concatenate, zip(*waiting, strict=True)))
        summary.closed()
        item, count = (summary.item, summary.count) if candidates is None else (candidates[exact > 0], exact[exact > 0])
        numbers = [*count.astype(np.int64), int(summary.missed), int(summary.texts)]
        yield pa.RecordBatch.from_arrays([pa.array([*item.astype(np.int64), -1, -2], pa.int64()), pa.array(numbers, pa.int64())], names=["shingle", "n"])

    return run


def idf_of(docs: DataFrame) -> Idf:
    """The weights of the shingles that more than a share COMMON of the documents have, from all documents."""
    texts = docs.select("text")
    kins = written(texts.mapInArrow(_kin_counter, "kin long, n long").groupBy("kin").agg(F.sum("n").alias("n")).where("n > 1 OR kin = -1"), "kin")
    every = sum(r.n for r in kins.where("kin = -1").collect())
    heavy = {r.kin: r.n for r in kins.where((F.col("kin") >= 0) & (F.col("n") > F.lit(HEAVY * every))).collect()}
    count = lambda f: texts.mapInArrow(f, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    first = written(count(_counter(None, heavy)), "frequencies")
    known = {r.shingle: r.n for r in first.where("shingle < 0").collect()}
    all_texts = known.get(-2, 0) + UNIT / COMMON
    may = [r.shingle for r in first.where((F.col("shingle") >= 0) & (F.col("n") + F.lit(known.get(-1, 0)) > F.lit(COMMON * all_texts))).collect()]
    if not may:
        return Idf(np.empty(0, np.uint64), np.empty(0))
    exact = {r.shingle: r.n for r in count(_counter(np.array(sorted(may), np.uint64), heavy)).where("shingle >= 0").collect()}
    common = np.array(sorted(k for k, n in exact.items() if n > COMMON * all_texts), np.uint64)
    share = np.array([exact[int(k)] for k in common]) / all_texts
    return Idf(common, np.maximum(LOWEST, np.log(share) / np.log(COMMON)) if len(common) else np.empty(0))


def text_hashes(words: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Two hashes of each text's sequence of words."""
    place = (np.arange(len(words)) - np.repeat(first[:-1], np.diff(first))).astype(np.uint64)
    out = []
    for k in (0x8CB92BA72F3D8DD7, 0xAAAAAAAAAAAAAAAB):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(words * np.uint64(k) + place), dtype=np.uint64)])
        out.append((total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64))
    return out


SIGNED = "id long, words1 long, words2 long, " + ", ".join(f"{k} long" for k in KEYS)


def band_keys(s: np.ndarray) -> np.ndarray:
    """A key for each band of the samples of each text."""
    pair = s[:, ::2].astype(np.uint64) << np.uint64(32) | s[:, 1::2]
    k = SAMPLES // BANDS // 2
    key = np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15) + np.zeros((len(s), 1), np.uint64)
    for i in range(k):
        key = mix64(key ^ pair[:, i::k])
    return key.view(np.int64)


def _signer(idf: Idf) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, words1, words2: two hashes of the sequence of words, a key for each band; null without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                one, two, keys, none = [], [], [], []
                for n, shingle, of, words, f in sorted_shingles(piece.column("text").to_pylist()):
                    for out, h in zip((one, two), text_hashes(words, f), strict=True):
                        out.append(h)
                    shingle, of, count = counted(shingle, of)
                    have, first = np.unique(of, return_index=True)
                    signed, empty = np.zeros((n, BANDS), np.int64), np.ones(n, bool)
                    if len(have):
                        weight = idf.of(shingle)
                        if weight is not None or (count > 1).any():
                            weight = octaves(count).astype(np.float32) * (np.float32(1) if weight is None else weight)
                        signed[have], empty[have] = band_keys(samples(shingle, weight, first)), False
                    keys.append(signed)
                    none.append(empty)
                keys, none = np.concatenate(keys), np.concatenate(none)
                columns = [piece.column("id"), pa.array(np.concatenate(one)), pa.array(np.concatenate(two)), *(pa.array(np.ascontiguousarray(k), mask=none) for k in keys.T)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "words1", "words2", *KEYS])

    return run


READ = "id long, words1 long, several boolean, elements binary, weights binary"


def _reader(idf: Idf) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, elements: 64 bits each, weights: empty if all are 1) of the texts with the words asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                found, weights, same = [], [], []
                for n, shingle, of, words, f in sorted_shingles(piece.column("text").to_pylist()):
                    same.append(np.stack(text_hashes(words, f)))
                    element, shingle, of = elements(shingle, of)
                    w = idf.of(shingle)
                    bounds = np.searchsorted(of, np.arange(n + 1))
                    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                        found.append(element[a:b].tobytes())
                        weights.append(b"" if w is None or (w[a:b] == 1).all() else w[a:b].tobytes())
                asked = np.stack([piece.column(c).to_numpy(zero_copy_only=False) for c in ("words1", "words2")])
                right = pa.array((np.concatenate(same, axis=1) == asked).all(axis=0))
                yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("words1"), piece.column("several"), pa.array(found, pa.binary()), pa.array(weights, pa.binary())], names=[c.split()[0] for c in READ.split(", ")]).filter(right)

    return run


def similarities(sets: list[np.ndarray], weights: list[np.ndarray | None], columns: int = 1 << 14) -> np.ndarray:
    """Weighted Jaccard similarity of all pairs of sets of elements; an element weighs the same in all sets."""
    n = len(sets)
    size = np.array([float(len(s)) if w is None else float(w.sum(dtype=float)) for s, w in zip(sets, weights, strict=True)])
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    weight = np.concatenate([np.ones(len(s), np.float32) if w is None else w for s, w in zip(sets, weights, strict=True)])
    order = np.argsort(every, kind="stable")
    every, owner, weight = every[order], owner[order], weight[order]
    new = np.ones(len(every), bool)
    new[1:] = every[1:] != every[:-1]
    number = np.cumsum(new) - 1
    shared = np.bincount(number) > 1
    keep = shared[number]
    owner, weight = owner[keep], weight[keep]
    number = (np.cumsum(shared) - 1)[number[keep]]
    both = np.zeros((n, n))
    for a in range(0, int(number[-1]) + 1 if len(number) else 0, columns):
        i, j = np.searchsorted(number, [a, a + columns])
        m = np.zeros((n, min(columns, int(number[j - 1]) - a + 1)), np.float32)
        m[owner[i:j], number[i:j] - a] = np.sqrt(weight[i:j])
        both += m @ m.T
    union = size[:, None] + size[None, :] - both
    found = np.where(union > 0, both / np.where(union > 0, union, 1), 1.0)
    np.fill_diagonal(found, 1.0)
    return found


def _verify(key: tuple, rows: pa.Table) -> pa.Table:
    """Links of a list as a forest: each member with the least of those it is connected to."""
    ids = rows["id"].to_pylist()
    sets = [np.frombuffer(x, np.uint64) for x in rows["elements"].to_pylist()]
    weights = [np.frombuffer(x, np.float32) if x else None for x in rows["weights"].to_pylist()]
    linked = similarities(sets, weights) >= LEAST - 1e-6
    root = np.array(ids, np.int64)
    while True:  # the least label among neighbours, until none changes
        new = np.where(linked, root[None, :], np.iinfo(np.int64).max).min(axis=1)
        if (new == root).all():
            break
        root = new
    moved = [(i, int(r)) for i, r in zip(ids, root, strict=True) if i != r]
    return pa.table({"a": pa.array([m[0] for m in moved], pa.int64()), "b": pa.array([m[1] for m in moved], pa.int64())})


def candidate_lists(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lists (list, id) whose members are to be compared, about MOST each, from (id, keys); and the members (band, key, id) of larger buckets."""
    keyed = F.explode(F.array(*(F.struct(F.lit(i).alias("band"), F.col(k).alias("key")) for i, k in enumerate(KEYS)))).alias("b")
    exploded = signed.where(f"{KEYS[0]} IS NOT NULL").select("id", keyed).select(F.col("b.band").alias("band"), F.col("b.key").alias("key"), "id")
    buckets = written(exploded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("hub")).where("n > 1"), "buckets")
    members = written(exploded.join(buckets, ["band", "key"]), "members")
    part = F.when(F.col("n") <= MOST, 0).otherwise(F.pmod(F.xxhash64("id", "band"), F.ceil(F.col("n") / F.lit(MOST - 1))))
    lists = members.groupBy("band", "key", part.alias("part")).agg(F.collect_set("id").alias("ids"), F.min("hub").alias("hub"))
    lists = written(lists.select(F.sort_array(F.array_union("ids", F.array("hub"))).alias("ids")).distinct(), "lists")
    return lists.select(F.xxhash64("ids").alias("list"), F.explode("ids").alias("id")), members.where(F.col("n") > MOST).select("band", "key", "id")


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of elements by their last bits."""
    n = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for x in batch.column("elements"):
            n += np.bincount((np.frombuffer(x.as_py(), np.uint64) & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
    slot = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array(n[slot], pa.int64())], names=["slot", "n"])


def _prefixer(counts: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, size, score: mean frequency, tokens: the elements from rare to frequent while those left weigh LEAST of all, reach).

    Texts x, y are similar only if their overlap has LEAST / (1 + LEAST) of the sum of their sizes. From the first shared
    token on, x has rest at most: so size(y) <= reach(x) = rest * (1 + LEAST) / LEAST - size(x), and likewise size(x) <= reach(y).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, scores, tokens, reach = [], [], [], []
            for e, w in zip(batch.column("elements").to_pylist(), batch.column("weights").to_pylist(), strict=True):
                e = np.frombuffer(e, np.uint64)
                w = np.frombuffer(w, np.float32).astype(float) if w else np.ones(len(e))
                n, size = counts[(e & np.uint64(SLOTS - 1)).astype(np.int64)], w.sum()
                order = np.lexsort((e, n))
                rest = size - np.cumsum(w[order]) + w[order]
                k = int((rest >= (LEAST - SLACK) * size).sum())
                sizes.append(size)
                scores.append((n * w).sum() / max(size, 1e-9))
                tokens.append(e[order[:k]].view(np.int64))
                reach.append(rest[:k] * ((1 + LEAST) / LEAST) - size + SLACK * size)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.float64()), pa.array(scores, pa.float64()), pa.array(tokens, pa.list_(pa.int64())), pa.array(reach, pa.list_(pa.float64()))], names=["id", "size", "score", "tokens", "reach"])

    return run


def _links(asked: DataFrame, one: DataFrame) -> DataFrame:
    """Links (a, b) found in lists (list, id), with the elements of each id."""
    return written(asked.join(one, "id").groupBy("list").applyInArrow(_verify, "a long, b long"), "links")


def _pair_links(pairs: DataFrame, one: DataFrame) -> DataFrame:
    """Links of pairs (a, b): each a with its b in lists of MOST."""
    sizes = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    part = F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / F.lit(MOST - 1)))
    lists = pairs.join(sizes, "a").groupBy("a", part.alias("part")).agg(F.collect_set("b").alias("bs"))
    return _links(lists.select(F.xxhash64("a", "part").alias("list"), F.explode(F.array_union(F.array("a"), "bs")).alias("id")), one)


def _open(large: DataFrame, component: DataFrame) -> DataFrame:
    """Members (band, key, id, label) of the larger buckets that are not all in one component."""
    labelled = written(large.join(component.withColumnRenamed("node", "id"), "id", "left").select("band", "key", "id", F.coalesce("component", "id").alias("label")), "labelled")
    several = labelled.groupBy("band", "key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("band", "key")
    return written(labelled.join(several, ["band", "key"]), "open")


def _prefix_pairs(opened: DataFrame, prefixes: DataFrame) -> DataFrame:
    """All pairs (a, b) of different labels that can be similar by their sizes and the first element they share."""
    tokens = opened.select("id", "label").distinct().join(prefixes, "id").select("id", "label", "size", F.explode(F.arrays_zip("tokens", "reach")).alias("t"))
    tokens = written(tokens.select(F.col("t.tokens").alias("token"), "label", "id", "size", F.col("t.reach").alias("reach")), "tokens")
    groups = written(tokens.groupBy("token", "label").agg(F.min("size").alias("size"), F.max("reach").alias("reach"), F.max(F.col("reach") - F.col("size")).alias("spare")), "groups")
    # of two texts one is not the smaller, so one of a pair reaches its own size
    several = groups.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.max("spare").alias("most")).where("x < y AND most >= 0").select("token")
    groups = groups.join(several, "token")
    x, y = (groups.select("token", *(F.col(c).alias(f"{c}_{p}") for c in ("label", "size", "reach", "spare"))) for p in "xy")
    both = x.join(y, "token").where("label_x < label_y AND size_x <= reach_y AND size_y <= reach_x AND (spare_x >= 0 OR spare_y >= 0)").select("token", "label_x", "label_y")
    a, b = (tokens.select("token", F.col("label").alias(f"label_{p}"), F.col("id").alias(i), F.col("size").alias(f"size_{p}"), F.col("reach").alias(f"reach_{p}")) for p, i in (("x", "a"), ("y", "b")))
    found = both.join(a, ["token", "label_x"]).join(b, ["token", "label_y"])
    return written(found.where("size_x <= reach_y AND size_y <= reach_x").select("a", "b").distinct(), "pairs")


def settled(large: DataFrame, one: DataFrame, links: DataFrame) -> DataFrame:
    """Components of links, and of those still missing between members (band, key, id) of larger buckets; one: the elements of each id."""
    component = connected_components(links)
    opened = _open(large, component)
    left, before, used = opened.count(), math.inf, None
    if not left:
        return component
    one = written(one.join(opened.select("id").distinct(), "id"), "open-elements")
    counts = np.zeros(SLOTS, np.int64)
    found = one.select("elements").mapInArrow(_frequencies, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # SLOTS rows at most
    counts[found["slot"].to_numpy()] = found["n"].to_numpy()
    prefixes = written(one.select("id", "elements", "weights").mapInArrow(_prefixer(counts), "id long, size double, score double, tokens array<long>, reach array<double>"), "prefixes")
    while 0 < left <= before / 2:
        free = opened.join(prefixes.select("id", "score"), "id")
        if used is not None:
            free = free.join(opened.join(used.withColumnRenamed("hub", "id"), ["band", "key", "id"]).select("band", "key", "label").distinct(), ["band", "key", "label"], "left_anti")
        hubs = free.groupBy("band", "key").agg(F.max(F.struct("score", F.bitwise_not("id").alias("less"))).alias("h")).select("band", "key", F.bitwise_not("h.less").alias("hub"))
        hubs = written(hubs, "hubs")
        used = hubs if used is None else used.unionByName(hubs)
        pairs = written(opened.join(hubs, ["band", "key"]).where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
        links = links.unionByName(_pair_links(pairs, one))
        component = connected_components(links)
        opened = _open(large, component)
        left, before = opened.count(), left
    return connected_components(links.unionByName(_pair_links(_prefix_pairs(opened, prefixes), one))) if left else component


@tidy
def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id, kept (it is the one that stays of its class)."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    idf = idf_of(docs)
    signed = written(docs.mapInArrow(_signer(idf), SIGNED), "signatures")
    keys = [F.first(k).alias(k) for k in KEYS]
    rows = signed.where("id IS NOT NULL").groupBy("words1", "words2", "id").agg(F.count(F.lit(1)).alias("n"), *keys)
    same = written(rows.groupBy("words1", "words2").agg(F.min("id").alias("id"), F.max(F.col("n") > 1).alias("several"), *keys), "texts")
    lists, large = candidate_lists(same.select("id", *KEYS))
    asked = written(lists, "asked")
    needed = asked.select("id").distinct().join(same.select("id", "words1", "words2", "several"), "id").hint("merge")  # more than may be broadcast but for toys: one plan at all sizes
    one = written(docs.join(needed, "id").mapInArrow(_reader(idf), READ), "elements")
    several = one.where("several").dropDuplicates(["id", "words1"])  # rows that repeat an id with its text
    one = one.where("NOT several").unionByName(several).select("id", "elements", "weights")
    links = _links(asked, one)
    component = settled(large, one, links)
    of = same.select("words1", "words2", "id").join(component, F.col("id") == F.col("node"), "left").select("words1", "words2", F.coalesce("component", "id").alias("class_id"))
    of = written(of, "classes")
    found = signed.select("id", "words1", "words2").join(of, ["words1", "words2"], "left")
    class_id = F.when(F.col("id").isNotNull(), F.col("class_id"))
    return found.select(F.col("id").alias("doc_id"), class_id.alias("class_id"), F.coalesce(F.col("id") == F.col("class_id"), F.lit(True)).alias("kept"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
