"""Packing documents into batches of equal padded length.

A histogram of all lengths is cut to buckets by dynamic programming, so that padding every document to its bucket's
longest is least in total. Batches then form inside each bucket: as many documents as fit the token budget at the
bucket's length. The histogram has a row for each length that occurs: as many as the longest text has words at most,
however many documents there are. The best cut moves to the right with the length that ends a bucket, so the search for
it halves its range again and again: buckets x lengths x log(lengths) steps, in whole numbers. The cut is optimal.

Null and empty texts have length 0 and share the shortest bucket. A document longer than the budget is a batch of its
own. Repeated rows are packed each for itself. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import running_sum, slice_bits, table, text_of, word_count, written


def best_cuts(least: np.ndarray, longest: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every j from 1 on, the least of least[i] + longest[j - 1] * (before[j] - before[i]) over i < j, and its i.

    The best i never falls as j rises: of all ranges of j at once the middle is solved, which parts the ranges of i for the halves.
    """
    n = len(longest)
    total, cut = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    left, right, low, high = (np.array([x]) for x in (1, n, 0, n - 1))
    while len(left):
        j = (left + right) // 2
        size = np.minimum(high, j - 1) - low + 1
        start = np.cumsum(size) - size
        i = np.arange(int(size.sum())) - np.repeat(start - low, size)
        of = np.repeat(j, size)
        value = least[i] + longest[of - 1] * (before[of] - before[i])
        total[j] = np.minimum.reduceat(value, start)
        cut[j] = np.minimum.reduceat(np.where(value == np.repeat(total[j], size), i, n), start)
        left, right, low, high = (np.concatenate(x) for x in ((left, j + 1), (j - 1, right), (low, cut[j]), (cut[j], high)))
        some = left <= right
        left, right, low, high = left[some], right[some], low[some], high[some]
    return total, cut


def bucket_bounds(longest: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The longest length of each bucket, ascending, for lengths (ascending) and their counts: least total padding.

    least[j]: the padded total of the first j lengths cut to k buckets; a bucket of lengths i to j - 1 costs longest[j - 1]
    for each of its documents. Fewer buckets if there are fewer lengths.
    """
    longest, n = longest.astype(np.int64), len(longest)
    before = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts, dtype=np.int64)])
    least = np.concatenate([np.zeros(1, np.int64), longest * before[1:]])
    cuts = []
    for _ in range(min(buckets, n) - 1):
        least, cut = best_cuts(least, longest, before)
        cuts.append(cut)
    bounds, j = [], n
    for cut in reversed(cuts):
        bounds.append(int(longest[j - 1]))
        j = int(cut[j])
        if j == 0:
            break
    if j:
        bounds.append(int(longest[j - 1]))
    return bounds[::-1]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 16, budget: int = 65_536) -> DataFrame:
    """One row per document: doc_id, n_tokens, bucket, bucket_tokens (its padded length), batch, slot.

    Tokens are words. Batches are numbered within their bucket; every batch but a bucket's last is full.
    """
    rows = written(docs.select(F.col(id_col).alias("doc_id"), word_count(text_of(text_col)).alias("n_tokens")), "lengths")
    histogram = rows.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).orderBy("n_tokens").collect()
    if not histogram:
        return rows.selectExpr("doc_id", "n_tokens", "0 AS bucket", "0L AS bucket_tokens", "0L AS batch", "0L AS slot")
    bounds = bucket_bounds(np.array([h.n_tokens for h in histogram]), np.array([h.n for h in histogram]), buckets)
    number = sum(((F.col("n_tokens") > b).cast("int") for b in bounds[:-1]), F.lit(0))
    placed = rows.withColumn("bucket", number).withColumn("bucket_tokens", F.element_at(F.array(*(F.lit(b).cast("long") for b in bounds)), F.col("bucket") + 1))
    keyed = placed.withColumn("_key", F.xxhash64(F.lit("packing"), F.col("doc_id").cast("string"))).withColumn("_one", F.lit(1))
    ranked = running_sum(keyed, ["bucket"], "_key", ["doc_id", "n_tokens"], "_one", "_rank", slice_bits(rows.count()))
    fits = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), F.col("bucket_tokens")))).cast("long")
    return ranked.select("doc_id", "n_tokens", "bucket", "bucket_tokens", F.floor(F.col("_rank") / fits).cast("long").alias("batch"), (F.col("_rank") % fits).cast("long").alias("slot"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
