"""From documents to packed training batches: toxicity, exact copies, near copies, source mix, packing.

Every stage takes the documents that its predecessor kept, and all but the last return documents with the columns
they came with.

Null texts are empty texts, and very long ones are read whole. Rows without an id are never dropped as copies by their id;
of equal texts one row stays, and rows that repeat an id with its text stay or go together. Ties go to the smallest id, but
for exact copies to the longest original first. Other columns come along, whatever their names. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import table, text_of, written
from folioforge.llm.exact_dedup import digest, exact_dedup
from folioforge.llm.mixing import mixed_documents
from folioforge.llm.near_dup import classes
from folioforge.llm.packing import pack
from folioforge.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    gone = exact_dedup(docs).where("NOT kept").select("doc_id", F.col("text_sha256").alias("sha256")).distinct()
    return docs.join(gone, docs.doc_id.eqNullSafe(gone.doc_id) & (digest(text_of()) == gone.sha256), "left_anti")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    gone = classes(docs).groupBy("doc_id").agg(F.max("kept").alias("kept")).where("NOT kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document in the batches."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixing), ("packing", packing)]

#: No SQL tells what the toxicity and near-copy stages keep; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
