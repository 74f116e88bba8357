"""Plain text files as documents of one body."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def decoded(content: Column) -> Column:
    """Bytes as UTF-8, malformed ones replaced; one line feed for every kind of line end."""
    return T.unify_newlines(F.make_valid_utf8(content.cast("string")))


def read_plain(spark: SparkSession, path: str) -> DataFrame:
    """(doc, raw) of the text files under a path. Files of no bytes have an empty body: Spark does not read them, but lists them."""
    files = spark.read.format("binaryFile").load(path)
    is_text = T.suffix(F.col("path")).isin(".txt", ".md", ".markdown")
    read = files.where(is_text).select(T.file_name(F.col("path")).alias("doc"), decoded(F.col("content")).alias("raw"))
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    empty = [(str(s.getPath().toString()),) for s in at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at.suffix("/*")) or [] if s.isFile() and s.getLen() == 0]
    none = spark.createDataFrame(empty, "path string").where(is_text).select(T.file_name(F.col("path")).alias("doc"), F.lit("").alias("raw"))
    return read.unionByName(none)
