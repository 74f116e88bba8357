"""Exact deduplication against a history of distinct digests held in minimal perfect hash tables.

A shard of the history is one row: the bit arrays of a minimal perfect hash, a slot for each distinct digest with
the whole digest, and the locator of the row that wins for it. New rows are first reduced to one row per digest,
then looked up in the shard that their digest belongs to. A minimal perfect hash answers for any key, members or
not, so a lookup compares all bytes of the digest in the slot; those that differ are new and grouped apart.

Texts are equal if they are identical without white space (U+0009 to U+000D, U+0020). Null counts as the empty
text; empty texts are equal to each other. Of equal texts the one with the most code points as it came stays, of
these the one with the smallest id (null ids last). Rows repeated with the same id count as rows of their own:
each is kept if it carries the id that stays. Any long is an id. Very long texts are hashed where they stand; only
digests travel. Other columns are not read, so their names clash with nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, mix64, table, text_of, written

INDEX = "shard int, levels array<binary>, sizes array<long>, digests binary, points binary, ids binary, no_id binary, counts binary"
GROUPS = "digest binary, points long, id long, n long"
NO_ID = np.iinfo(np.int64).max
#: Bits of a level for each key that is left.
GAMMA = 2


def digest(text: Column) -> Column:
    """SHA-256 of the text without white space, as hexadecimal digits."""
    return F.sha2(F.translate(text, SPACES, "").cast("binary"), 256)


def _words(digests: np.ndarray) -> list[np.ndarray]:
    return [np.ascontiguousarray(digests[:, i : i + 8]).view(np.uint64)[:, 0] for i in (0, 8, 16, 24)]


def _position(words: list[np.ndarray], level: int, size: int) -> np.ndarray:
    x = np.full(len(words[0]), level + 1, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for w in words:
        x = mix64(x ^ w)
    return (x % np.uint64(size)).astype(np.int64)


def perfect_hash(digests: np.ndarray) -> tuple[list[bytes], list[int], np.ndarray]:
    """Bit arrays and their sizes, and the slot (0 to n - 1) of each of n distinct digests of 32 bytes.

    On each level a key sets a bit if no other key hashes there; the others go on to the next level. A key's slot
    is the number of bits before its own.
    """
    words, left, slots = _words(digests), np.arange(len(digests)), np.empty(len(digests), np.int64)
    levels, sizes, base = [], [], 0
    while len(left):
        size = max(64, GAMMA * len(left))
        at = _position([w[left] for w in words], len(sizes), size)
        bits = np.bincount(at, minlength=size) == 1
        alone = bits[at]
        slots[left[alone]] = base + np.cumsum(bits)[at[alone]] - 1
        base += int(bits.sum())
        left = left[~alone]
        levels.append(np.packbits(bits).tobytes())
        sizes.append(size)
    return levels, sizes, slots


def slots_of(digests: np.ndarray, levels: list[bytes], sizes: list[int]) -> np.ndarray:
    """The slot that each digest would have; -1 if no level answers. Only a comparison tells members apart."""
    words, left, slots, base = _words(digests), np.arange(len(digests)), np.full(len(digests), -1, np.int64), 0
    for level, (packed, size) in enumerate(zip(levels, sizes, strict=True)):
        bits = np.unpackbits(np.frombuffer(packed, np.uint8), count=size).astype(bool)
        at = _position([w[left] for w in words], level, size)
        hit = bits[at]
        slots[left[hit]] = base + np.cumsum(bits)[at[hit]] - 1
        base += int(bits.sum())
        left = left[~hit]
    return slots


def _bytes_of(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def _longs(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().fill_null(int(NO_ID)).to_numpy(zero_copy_only=False).astype(np.int64)


def _build(key: tuple, rows: pa.Table) -> pa.Table:
    digests = _bytes_of(rows["digest"])
    levels, sizes, slots = perfect_hash(digests)
    order = np.empty(len(slots), np.int64)
    order[slots] = np.arange(len(slots))
    points, ids, n = (_longs(rows[c])[order] for c in ("points", "id", "n"))
    no_id = np.packbits(rows["id"].combine_chunks().is_null().to_numpy(zero_copy_only=False)[order])
    row = [key[0].as_py(), levels, sizes, digests[order].tobytes(), points.tobytes(), ids.tobytes(), no_id.tobytes(), n.tobytes()]
    kinds = [pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int64()), *[pa.binary()] * 5]
    return pa.table({c.split()[0]: pa.array([v], k) for c, v, k in zip(INDEX.split(", "), row, kinds, strict=True)})


def _probe(index: pa.Table, rows: pa.Table) -> pa.Table:
    """Groups of the history and of the new rows together: of a digest in both, the better winner and both counts."""
    new, points, ids, n = _bytes_of(rows["digest"]), *(_longs(rows[c]) for c in ("points", "id", "n"))
    no_id = rows["id"].combine_chunks().is_null().to_numpy(zero_copy_only=False)
    if not index.num_rows:
        return _groups(new, points, ids, no_id, n)
    shard = {c: index[c][0].as_py() for c in index.column_names}
    old = np.frombuffer(shard["digests"], np.uint8).reshape(-1, 32)
    o_points, o_ids, o_n = (np.frombuffer(shard[c], np.int64).copy() for c in ("points", "ids", "counts"))
    o_no_id = np.unpackbits(np.frombuffer(shard["no_id"], np.uint8), count=len(old)).astype(bool)
    slot = slots_of(new, shard["levels"], shard["sizes"])
    member = slot >= 0
    member[member] = (old[slot[member]] == new[member]).all(axis=1)
    at = slot[member]
    o_n[at] += n[member]
    key = lambda p, i, x: (p, ~x, ~i)
    mine, theirs = key(points[member], ids[member], no_id[member]), key(o_points[at], o_ids[at], o_no_id[at])
    better, tied = np.zeros(len(at), bool), np.ones(len(at), bool)
    for a, b in zip(mine, theirs, strict=True):
        better |= tied & (a > b)
        tied &= a == b
    o_points[at[better]], o_ids[at[better]], o_no_id[at[better]] = points[member][better], ids[member][better], no_id[member][better]
    both = [np.concatenate(x) for x in ((old, new[~member]), (o_points, points[~member]), (o_ids, ids[~member]), (o_no_id, no_id[~member]), (o_n, n[~member]))]
    return _groups(*both)


def _groups(digests: np.ndarray, points: np.ndarray, ids: np.ndarray, no_id: np.ndarray, n: np.ndarray) -> pa.Table:
    return pa.table({"digest": pa.array([x.tobytes() for x in digests], pa.binary()), "points": pa.array(points), "id": pa.array(ids, mask=no_id), "n": pa.array(n)})


def distinct_digests(rows: DataFrame, shards: int) -> DataFrame:
    """One row per digest of rows (id, points, digest): its count and the row that wins; summed in part before the shuffle."""
    best = F.max(F.struct(F.col("points"), F.col("id").isNotNull().alias("has"), F.bitwise_not("id").alias("less")))  # ~id falls as id rises, for all longs
    groups = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), best.alias("b"))
    shard = F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")
    return groups.select(shard.alias("shard"), "digest", F.col("b.points").alias("points"), F.bitwise_not("b.less").alias("id"), "n")


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """The sharded index over rows (id, points, digest) of the history; digests spread evenly, whatever their counts."""
    return distinct_digests(history, shards).groupBy("shard").applyInArrow(_build, INDEX)


def lookup(index: DataFrame, new: DataFrame, shards: int) -> DataFrame:
    """One row per digest of the history or the new rows: (digest, points, id of the row that stays, n)."""
    return index.groupBy("shard").cogroup(distinct_digests(new, shards).groupBy("shard")).applyInArrow(_probe, GROUPS)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_rows: int = 50_000) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    One half of the rows (by a hash of the id) is indexed as the history, the other half is looked up in it.
    shard_rows: digests in a shard, about; a shard is what one task holds.
    """
    rows = written(docs.select(F.col(id_col).cast("long").alias("id"), F.length(text_of(text_col)).cast("long").alias("points"), F.unhex(digest(text_of(text_col))).alias("digest")), "digests")
    shards = max(96, -(-rows.count() // shard_rows))
    old = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
    groups = lookup(build_index(rows.where(old), shards), rows.where(~old), shards)
    groups = groups.select("digest", F.col("id").alias("keep_id"), F.col("n").alias("group_size"))
    return rows.join(groups, "digest").select(F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
     k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
                  count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""
