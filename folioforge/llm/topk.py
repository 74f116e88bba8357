"""Exact top-k by inner product over a bit-sliced index.

Components are quantised to floor(scale * x). The index holds blocks of rows: for each component one bitmap for every
bit of its value (shifted to be non-negative), a bit of which is a row. Queries are kept in the same way. A task meets a
group of blocks with a chunk of queries, and scores every row of the one for every query of the other:

* Where all sums are exact in floating point (by the product of the lengths, below 2 ** 24 or 2 ** 53), the slices are put
  together again and scores are products of matrices, tile by tile. Rows go in the order of ids, so that only a score above
  a query's k-th best so far can change it; the greatest score of a tile tells whether there is one.
* Other scores stay in slices. The slices of a component are added once for each bit of the query's component, at that
  bit's weight; negative components add the complement. The additions are carry-save: three bitmaps of a weight become
  one of it and one of the next. What is left is the score of all rows of the block at once, one bitmap a bit. From the
  most significant slice down, the rows that have the bit are taken while they are fewer than k; those that still tie
  after the last slice are the boundary, resolved by their ids.

The best of each task are then merged. All steps are exact; nothing is sampled or capped.

Vectors that are null or hold null or non-finite components take no part, neither do rows without an id. Shorter
vectors count as filled up with zeros. Quantised components end at 2 ** 53 either way; scores are exact however large, and
ranked so, but reported as the nearest long. Rows that share an id are candidates each, but not for queries of that id; a
query id that repeats is asked once, with its greatest vector. Fewer than k candidates give as many rows as there are.
Other columns are not read, so their names clash with nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from .common import table, written

BLOCKS = "block long, ids binary, low long, bits int, dims int, slices array<binary>"
#: A score is high * 2 ** 63 + low.
BEST = "query_id long, vec_id long, high long, low long"
#: Quantised components end here: beyond, doubles have no units any more.
LARGEST = 2.0**53
#: Lengths of vectors whose products are exact as floats and as doubles.
SHORT, LONG = 2.0**12, 2.0**26
#: Queries and rows of a tile of scores, which stays in a core's cache.
TILE = (512, 1024)
#: Pairs of a query and a row that are worth a task, and how many tasks to make of them at least and at most.
WORTH, TASKS = 2**30, (16, 256)
#: Components that a task holds at most, of rows and of queries; beyond, there are more tasks.
HELD = (2**25, 2**23)


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.where(~odd).select("id", F.transform("v", lambda x: F.floor(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), x * scale))).cast("long")).alias("q"))


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of the lists, and their elements one after the other; null elements of floats are NaN."""
    parts = column.chunks
    lengths = [np.diff(p.offsets.to_numpy()) for p in parts]
    elements = [p.flatten().to_numpy(zero_copy_only=False) for p in parts]
    return np.concatenate(lengths or [np.zeros(0, np.int64)]), np.concatenate(elements or [np.zeros(0, np.int64)])


def _matrix(lengths: np.ndarray, elements: np.ndarray) -> np.ndarray:
    """The lists as rows, filled up with zeros."""
    out = np.zeros((len(lengths), lengths.max(initial=0)), np.int64)
    if out.size == len(elements):
        out[:] = elements.reshape(out.shape)
    else:
        out[np.arange(out.shape[1]) < lengths[:, None]] = elements
    return out


def _bitmap(bits: np.ndarray) -> bytes:
    return np.packbits(bits, bitorder="little").tobytes()


def slices_of(q: np.ndarray) -> tuple[int, int, list[bytes]]:
    """The least value, the number of bits, and the bitmaps of all components, the bits of one after the other."""
    low = int(q.min()) if q.size else 0
    bits = max(1, (int(q.max()) - low).bit_length()) if q.size else 1
    u = (q - low).T.astype(np.uint64)
    return low, bits, [_bitmap((row >> np.uint64(b)) & np.uint64(1) == 1) for row in u for b in range(bits)]


def values_of(low: int, bits: int, dims: int, slices: list[bytes], rows: int) -> np.ndarray:
    """The components that slices_of was given, a line for each component."""
    if not dims:
        return np.zeros((0, rows), np.int64)
    bitmaps = np.frombuffer(b"".join(slices), np.uint8).reshape(dims, bits, -1)
    out = np.full((dims, rows), low, np.int32 if bits <= 23 and abs(low) <= 2**23 else np.int64)
    for b in range(bits):
        out += np.unpackbits(bitmaps[:, b], axis=1, count=rows, bitorder="little").astype(out.dtype) << b
    return out


def _build(scale: float | None) -> Callable[[tuple, pa.Table], pa.Table]:
    """Makes a block of the rows (id, v); v are components, or are quantised already if there is no scale."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        ids = rows["id"].to_numpy()
        lengths, v = _lists(rows["v"])
        if scale is not None:
            fit = np.ones(len(ids), bool)
            finite = np.isfinite(v)
            if not finite.all():
                of = np.repeat(np.arange(len(ids)), lengths)
                fit[of[~finite]] = False
                ids, lengths, v = ids[fit], lengths[fit], v[fit[of]]
            with np.errstate(over="ignore"):
                v = np.floor(np.clip(v.astype(np.float64) * scale, -LARGEST, LARGEST)).astype(np.int64)
        order = np.argsort(ids, kind="stable")
        q = _matrix(lengths, v)[order]
        low, bits, slices = slices_of(q)
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.binary())]
        row = [key[0].as_py(), ids[order].astype(np.int64).tobytes(), low, bits, q.shape[1], slices]
        return pa.table({c.split()[0]: pa.array([x], k) for c, x, k in zip(BLOCKS.split(", "), row, kinds, strict=True)}).slice(0, min(1, len(ids)))

    return run


def score_slices(query: list[int], slices: list[int], bits: int, everything: int) -> list[int]:
    """Bitmaps of score + constant, least significant first, for bitmaps of the components as integers."""
    columns: list[list[int]] = []
    for d, x in enumerate(query):
        for j in range(abs(x).bit_length()):
            if abs(x) >> j & 1:
                while len(columns) < j + bits:
                    columns.append([])
                for b in range(bits):
                    s = slices[d * bits + b]
                    columns[j + b].append(s if x > 0 else s ^ everything)
    w = 0
    while w < len(columns):
        c = columns[w]
        if len(c) > 1 and w + 1 == len(columns):
            columns.append([])
        while len(c) > 2:
            a, b, d = c.pop(), c.pop(), c.pop()
            x = a ^ b
            c.append(x ^ d)
            columns[w + 1].append(a & b | d & x)
        if len(c) == 2:
            a, b = c
            columns[w] = [a ^ b]
            columns[w + 1].append(a & b)
        w += 1
    return [c[0] if c else 0 for c in columns]


def largest(score: list[int], among: int, k: int) -> tuple[int, int, int]:
    """Rows that are among the k largest for sure, the boundary rows that tie for the other places, and how many places."""
    sure, tied = 0, among
    for s in reversed(score):
        n = (sure | tied & s).bit_count()
        if n > k:
            tied &= s
        elif n < k:
            sure |= tied & s
            tied &= ~s
        else:
            return sure | tied & s, 0, 0
    return sure, tied, k - sure.bit_count()


def rows_of(bitmap: int) -> Iterator[int]:
    while bitmap:
        low = bitmap & -bitmap
        yield low.bit_length() - 1
        bitmap ^= low


def block_best(query_id: int, query: list[int], ids: np.ndarray, low: int, bits: int, dims: int, slices: list[int], k: int) -> list[tuple[int, int]]:
    """(score, id) of the k best rows of a block; more only where ids repeat at the boundary."""
    query = [*query[:dims], *[0] * (dims - len(query))]
    everything = (1 << len(ids)) - 1
    own = slice(*np.searchsorted(ids, [query_id, query_id + 1]))
    among = everything ^ sum(1 << i for i in range(own.start, own.stop))
    score = score_slices(query, slices, bits, everything)
    sure, tied, places = largest(score, among, k)
    chosen = [*rows_of(sure)]
    for _ in range(min(places, tied.bit_count())):  # rows are in the order of ids: the lowest bits are the smallest ids
        bit = tied & -tied
        chosen.append(bit.bit_length() - 1)
        tied ^= bit
    constant = sum(x * low if x > 0 else x * (low + (1 << bits) - 1) for x in query)
    return [(sum((s >> i & 1) << w for w, s in enumerate(score)) + constant, int(ids[i])) for i in chosen]


def _better(scores: np.ndarray, first: int, best: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each line: of best, which were found at the rows at, and of scores, of the rows from first on."""
    h, k = best.shape
    above = scores > best[:, -1:]
    if scores.shape[1] > k and np.isneginf(best[:, -1]).any():  # not k yet: of this tile, its own k best and their ties
        above &= scores >= np.partition(scores, -k, axis=1)[:, -k, None]
    line, row = np.divmod(np.flatnonzero(above), scores.shape[1])  # on one line, several times as fast
    lines = np.concatenate([np.repeat(np.arange(h), k), line])
    values = np.concatenate([best.ravel(), scores[line, row]])
    rows = np.concatenate([at.ravel(), row + first])
    order = np.lexsort((rows, -values, lines))
    lines = lines[order]
    order = order[np.arange(len(lines)) - np.searchsorted(lines, np.arange(h))[lines] < k]
    return values[order].reshape(h, k), rows[order].reshape(h, k)


def dense_best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, ids and scores of the k best rows for each query. rows: a column for each id, in the order of ids.

    Sums must be exact in the type of the matrices."""
    found = []
    for a in range(0, len(query_ids), TILE[0]):
        asked, q = query_ids[a : a + TILE[0]], queries[a : a + TILE[0]]
        best, at = np.full((len(q), k), -np.inf, q.dtype), np.zeros((len(q), k), np.int64)
        start, end = np.searchsorted(ids, asked, "left"), np.searchsorted(ids, asked, "right")
        own = [(r, i) for i in np.flatnonzero(start < end) for r in range(start[i], end[i])]
        own_row, own_query = np.array(sorted(own), np.int64).reshape(-1, 2).T
        tile = np.empty((len(q), TILE[1]), q.dtype)
        for s in range(0, len(ids), TILE[1]):
            part = rows[:, s : s + TILE[1]]
            scores = np.matmul(q, part, out=tile) if part.shape[1] == TILE[1] else q @ part
            x, y = np.searchsorted(own_row, [s, s + TILE[1]])
            scores[own_query[x:y], own_row[x:y] - s] = -np.inf
            hit = np.flatnonzero(np.fmax.reduce(scores, axis=1) > best[:, -1])
            if len(hit):
                best[hit], at[hit] = _better(scores[hit], s, best[hit], at[hit])
        line, place = np.nonzero(best > -np.inf)
        found.append((asked[line], ids[at[line, place]], best[line, place].astype(np.int64)))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def sliced_best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """The same for sums of any size, by slices of 65,536 rows at a time; up to k of each."""
    for s in range(0, len(ids), 65_536):
        low, bits, slices = slices_of(rows[:, s : s + 65_536].astype(np.int64).T)
        whole = [int.from_bytes(x, "little") for x in slices]
        for i, q in zip(query_ids.tolist(), queries, strict=True):
            for score, j in block_best(i, q.astype(np.int64).tolist(), ids[s : s + 65_536], low, bits, len(rows), whole, k):
                yield i, j, score


def _unpacked(blocks: pa.Table, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids in their order, the components of each as a column, as floats if these hold them, and the kind of each by length."""
    parts = [np.frombuffer(i, np.int64) for i in blocks["ids"].to_pylist()]
    ids = np.concatenate(parts)
    order = np.argsort(ids, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    small = all(b <= 23 and abs(v) <= 2**23 for b, v in zip(blocks["bits"].to_pylist(), blocks["low"].to_pylist(), strict=True))
    out, squares = np.zeros((dims, len(ids)), np.float32 if small else np.float64), np.zeros(len(ids))
    at = 0
    for n, part in enumerate(parts):
        low, bits, held = (blocks[c][n].as_py() for c in ("low", "bits", "dims"))
        to, at = place[at : at + len(part)], at + len(part)
        v = values_of(low, bits, held, blocks["slices"][n].as_py(), len(part))
        out[:held, to] = v
        squares[to] = sum((line.astype(np.float64) ** 2 for line in v), np.zeros(len(part)))
    return ids[order], out, (np.sqrt(squares) >= SHORT).astype(np.int8) + (np.sqrt(squares) >= LONG)


def _search(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        columns = [np.zeros(0, np.int64)] * 4
        if len(blocks) and len(asked):
            dims = max(max(t["dims"].to_pylist()) for t in (blocks, asked))
            ids, rows, row_kind = _unpacked(blocks, dims)
            query_ids, queries, query_kind = _unpacked(asked, dims)
            found = []
            for x in np.unique(row_kind):
                own, of = (ids, rows) if (row_kind == x).all() else (ids[row_kind == x], rows[:, row_kind == x])
                for y in np.unique(query_kind):
                    who, what = query_ids[query_kind == y], np.ascontiguousarray(queries[:, query_kind == y].T)
                    if max(x, y) < 2:
                        exact = (np.float32, np.float64)[max(x, y)]
                        i, j, score = dense_best(who, what.astype(exact, copy=False), own, of.astype(exact, copy=False), k)
                        found.append((i, j, score >> 63, score & (2**63 - 1)))
                    else:
                        best = [(i, j, s >> 63, s & (2**63 - 1)) for i, j, s in sliced_best(who, what, own, of, k)]
                        found.append(np.array(best, np.int64).reshape(-1, 4).T)
            columns = [np.concatenate(c) for c in zip(*found, strict=True)]
        return pa.table({c.split()[0]: v for c, v in zip(BEST.split(", "), columns, strict=True)})

    return run


def _dealt(vectors: DataFrame, blocks: int, scale: float | None) -> DataFrame:
    """One row per block of the vectors (id, v), dealt by a hash of the id."""
    return vectors.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).groupBy("block").applyInArrow(_build(scale), BLOCKS)


def _counted(blocks: DataFrame) -> tuple[int, int]:
    """Vectors of the blocks and their most components."""
    rows, dims = blocks.agg(F.sum(F.octet_length("ids")), F.max("dims")).first()
    return (rows or 0) // 8, dims or 0


def build_index(vectors: DataFrame, rows: int, block_rows: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """One row per block of about block_rows of the vectors, which are rows; those that take no part are left out."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    if not isinstance(v.schema["v"].dataType.elementType, FloatType | DoubleType):
        v = v.withColumn("v", F.col("v").cast("array<double>"))
    return _dealt(v, max(1, -(-rows // block_rows)), scale)


def _meeting(blocks: DataFrame, own: str, count: int, other: str, others: int) -> DataFrame:
    """Each block once for each of the others, in partitions by what is to be met in one task; Spark shall not join these, which are much work and few bytes."""
    every = F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))
    met = blocks.withColumn(own, F.pmod("block", F.lit(count))).withColumn(other, F.explode(every)).drop("block")
    return met.repartition(2 * count * others, "group", "chunk")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, block_rows: int | None = None, chunk: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best vectors for each query; queries hold the same columns as vectors.

    block_rows: rows of a block, by default between 2048 and 65,536. chunk: queries of a chunk. Blocks are dealt to
    groups, and each group meets each chunk in a task of its own, which holds both; so a block travels once for each
    chunk, a query and its k best once for each group. By default tasks are few, up to 256, while a task can hold its share.
    """
    n = vectors.count()
    block_rows = block_rows or min(65_536, max(2048, n // 2048))
    index = written(build_index(vectors, n, block_rows, id_col, vector_col, scale), "bit-slices")
    rows, dims = _counted(index)
    q = written(quantised(queries, id_col, vector_col, scale).groupBy("id").agg(F.max("q").alias("v")), "queries")
    asked = q.count()
    tasks = min(TASKS[1], max(TASKS[0], rows * asked // WORTH))
    chunks = max(round(math.sqrt(4 * tasks * asked / max(1, rows))), -(-asked * dims // HELD[1]), 1)  # what is sent of a query, with its best, is about 4 times what is sent of a row
    chunks = max(1, -(-asked // chunk)) if chunk else chunks
    groups = max(1, min(-(-n // block_rows), max(-(-tasks // chunks), -(-rows * dims // HELD[0]))))
    pieces = chunks * max(1, -(-asked // (chunks * 16_384)))
    packed = written(_dealt(q, pieces, None), "asked")
    held, asking = _meeting(index, "group", groups, "chunk", chunks), _meeting(packed, "chunk", chunks, "group", groups)
    best = held.groupBy("group", "chunk").cogroup(asking.groupBy("group", "chunk")).applyInArrow(_search(k), BEST)
    order = Window.partitionBy("query_id").orderBy(F.desc("high"), F.desc("low"), "vec_id")  # cut to k rows a task before the shuffle
    as_long = F.when(F.col("high") > 0, F.lit(2**63 - 1)).when(F.col("high") < -1, F.lit(-(2**63))).otherwise(F.shiftleft("high", 63).bitwiseOR(F.col("low")))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", as_long.alias("score"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
           FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
