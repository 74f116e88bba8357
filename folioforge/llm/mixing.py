"""Mixing sources to target weights along a curriculum.

Every source has a weight and a schedule: over the training run (time 0 to 1) its rate goes linearly from a start to
an end, with mean 1. The integral of the rate is the source's cumulative demand of words; inverting it gives the time
at which a given word of the source is wanted. Documents are taken in an order of their own (a hash of the id) and
again from the start when the source is used up, and the plan is range-sorted by training position.

Sources are numbered by code point, null last, and weigh 5, 2, 1, repeating. They share the size of the whole corpus
by weight; a target stops at three times the source's size, and what is left over is shared again by weight. A
document at the end of a source's demand is taken in part, so that a source gives its rounded target exactly; within
three passes no document gives more than three times its size. Null texts and texts of white space have size 0 and
give nothing. The same id more than once: each row is taken for itself; the documents of rows that agree in id, source and
text come each as often as the one of them taken most. A very long text counts as often as any. Clashing names of other
columns do no harm. Sources are few: their shares are computed in one task, a row a source. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import running_sum, slice_bits, table, text_of, word_count, written

WEIGHTS = (5, 2, 1)
#: Rates at the start and the end of training of the sources that weigh 5, 2 and 1; each pair has mean 1.
RATES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
PASSES = 3


def targets(sizes: DataFrame) -> DataFrame:
    """Adds turn, target and wanted (the target in whole words) to sizes (source, source_size): one row per source.

    Shared by filling up: in the order of cap by weight, a source is at its cap if the level that the rest would
    reach is above it. These windows hold one row per source, not the documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("turn", (F.row_number().over(by_name) - 1) % len(WEIGHTS))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("turn") + 1).cast("double")
    capped = ranked.withColumn("weight", weight).withColumn("cap", F.lit(float(PASSES)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    upto, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))
    heavy = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))
    level = capped.withColumn("level", left / heavy)
    full = F.col("cap") <= F.col("weight") * F.col("level")
    free = level.withColumn("level", F.min(F.when(~full, F.struct(F.col("cap") / F.col("weight"), "source", "level"))).over(everything)["level"])
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("level")))
    return free.withColumn("target", target).withColumn("wanted", F.floor(F.col("target") + 0.5).cast("long")).select("source", "source_size", "turn", "target", "wanted")


def order_key(id_col: Column) -> Column:
    """The first 60 bits of the MD5 of the id as text, spread over the longs; in the order of the digests."""
    digits = F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return (F.conv(digits, 16, 10).cast("long") - F.lit(1 << 59)) * F.lit(16)


def overlap(start: Column, size: Column, end: Column) -> Column:
    """Words of [start, start + size) that lie before end."""
    return F.greatest(F.lit(0), F.least(size, end - start))


def position(share: Column, turn: Column) -> Column:
    """The time at which a source has given this share of its demand: the inverse of its integrated rate."""
    at = lambda i: F.element_at(F.array(*(F.lit(r[i]) for r in RATES)), turn + 1)
    first, slope = at(0), at(1) - at(0)
    return F.when(slope == 0.0, share).otherwise((F.sqrt(first * first + F.lit(2.0) * slope * share) - first) / slope)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, first and last position (null if not taken),
    copies (passes of which it gives half of its words or more); _mark, a hash of the text, tells rows with the same id apart."""
    rows = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_of(text_col)).alias("size"), F.xxhash64(text_of(text_col)).alias("_mark")), "sizes")
    shares = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))).withColumnRenamed("source", "_of")
    keyed = rows.withColumn("_key", order_key(F.col("doc_id")))
    summed = running_sum(keyed, ["source"], "_key", ["doc_id", "size", "_mark"], "size", "_at", slice_bits(rows.count()))
    d = summed.join(shares, F.col("source").eqNullSafe(F.col("_of"))).drop("_of")
    takes = [overlap(F.col("_at") + p * F.col("source_size"), F.col("size"), F.col("wanted")) for p in range(PASSES)]
    time = lambda word: F.when(F.col("taken") > 0, position(F.least(F.lit(1.0), (word + 0.5) / F.col("wanted")), F.col("turn")))
    passes = sum(((t > 0).cast("int") for t in takes), F.lit(0))
    last = (passes - 1) * F.col("source_size") + F.col("_at")
    copies = sum(((t > 0) & (2 * t >= F.col("size"))).cast("int") for t in takes)
    d = d.withColumn("taken", sum(takes, F.lit(0)).cast("long")).withColumn("copies", copies)
    return d.select("doc_id", "source", "size", "source_size", "target", "taken", "copies", "_mark", time(F.col("_at")).alias("first_position"), time(last).alias("last_position"))


def sorted_by_position(plan: DataFrame) -> DataFrame:
    return plan.repartitionByRange(F.col("first_position").isNull(), "first_position", "doc_id").sortWithinPartitions(F.col("first_position").isNull(), "first_position", "doc_id")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents themselves: each as often as the mix uses it (the last time in part counts from half on), in training order."""
    plan = mix(docs, id_col, text_col, source_col).where("copies > 0").groupBy("doc_id", "source", "size", "_mark").agg(F.max("copies").alias("_n"), F.min("first_position").alias("_position"))
    plan = plan.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), "_mark", "_n", "_position")
    whole = docs.select(F.struct("*").alias("_doc"))  # so that no column of the documents clashes with the plan's
    own = lambda c: F.col("_doc")[c]
    same = own(id_col).eqNullSafe(F.col("_id")) & own(source_col).eqNullSafe(F.col("_source")) & (word_count(F.coalesce(own(text_col), F.lit(""))) == F.col("_size")) & (F.xxhash64(F.coalesce(own(text_col), F.lit(""))) == F.col("_mark"))
    copies = whole.join(plan, same).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    ordered = copies.repartitionByRange("_position", "_id", "_copy").sortWithinPartitions("_position", "_id", "_copy")
    return ordered.select(*(own(c).alias(c) for c in docs.columns))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_position")
    return sorted_by_position(plan)


OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                  substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS k FROM documents),
     s AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS n FROM d GROUP BY source),
     w AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, n % 3 AS turn, CASE n % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight,
                  3.0::DOUBLE * CAST(source_size AS BIGINT) AS cap FROM s),
     l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
           FROM w WINDOW o AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
     t AS (SELECT *, CASE WHEN f IS NULL THEN cap ELSE least(cap, weight * f) END AS target FROM (
           SELECT *, (SELECT level FROM l WHERE NOT cap <= weight * level ORDER BY cap / weight, source IS NULL, source LIMIT 1) AS f FROM l)),
     a AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.turn, CAST(floor(t.target + 0.5) AS BIGINT) AS wanted,
                  CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos
           FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
     b AS (SELECT *, greatest(0, least(size, wanted - pos)) + greatest(0, least(size, wanted - pos - source_size)) + greatest(0, least(size, wanted - pos - 2 * source_size)) AS taken,
                  least(1.0::DOUBLE, (pos + 0.5::DOUBLE) / wanted) AS share FROM a)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken,
       CASE WHEN taken <= 0 THEN NULL
            WHEN turn = 0 THEN (sqrt(1.5::DOUBLE * 1.5 + 2.0::DOUBLE * -1.0 * share) - 1.5) / -1.0
            WHEN turn = 1 THEN share
            ELSE (sqrt(0.5::DOUBLE * 0.5 + 2.0::DOUBLE * 1.0 * share) - 0.5) / 1.0 END AS first_position
FROM b
"""
