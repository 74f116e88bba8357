"""Around a run: dispatch by suffix, supplied text, later recognition, settings by job, folders, the queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..settings import DEFAULT, Settings
from . import pages as P

FORMATS = {
    "paged": (".pdf", ".xps", ".epub", ".mobi", ".fb2", ".cbz", ".svg"),
    "image": (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".gif", ".webp", ".pnm", ".jp2"),
    "text": (".txt", ".md", ".markdown"),
    "office": (".docx", ".odt"),
}


def formats(spark: SparkSession) -> DataFrame:
    """(suffix, kind) of all that can be read."""
    return spark.createDataFrame([(s, k) for k, v in FORMATS.items() for s in v], "suffix string, kind string").orderBy("suffix")


def reader_of(path: Column) -> Column:
    """office, plain, or paged for everything else, known or not."""
    s = T.suffix(path)
    return F.when(s.isin(*FORMATS["office"]), "office").when(s.isin(*FORMATS["text"]), "plain").otherwise("paged")


def is_readable(name: Column) -> Column:
    return T.suffix(name).isin(*(s for v in FORMATS.values() for s in v))


def queue_results(queue: DataFrame, results: DataFrame) -> DataFrame:
    """The queue (name, ...) with what came of each file: state waiting, done or failed, and the message."""
    found = results.select(F.col("doc").alias("_doc"), "ok", "message")
    state = F.when(F.col("ok").isNull(), "waiting").when(F.col("ok"), "done").otherwise("failed")
    return queue.join(found, F.col("name") == F.col("_doc"), "left").withColumn("state", state).drop("_doc", "ok")


def queued(files: DataFrame, by: tuple[str, ...] = ("name", "size"), order: str = "seq") -> DataFrame:
    """Readable files, each once: the first of those that agree in by."""
    first = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return files.where(is_readable(F.col("name"))).withColumn("_n", first).where("_n = 1").drop("_n")


def with_supplied(pages: DataFrame, supplied: DataFrame) -> DataFrame:
    """pages (doc, page_no, raw) with raw from supplied (doc, page_no, text) where that is not blank, and ocr."""
    s = supplied.select("doc", "page_no", F.col("text").alias("_text"))
    given = T.strip(F.coalesce("_text", F.lit(""))) != ""
    return pages.join(s, ["doc", "page_no"], "left").withColumn("ocr", given).withColumn("raw", F.when(F.col("ocr"), F.col("_text")).otherwise(F.col("raw"))).drop("_text")


def fold_in(finished: DataFrame, keys: DataFrame, recognised: DataFrame, settings: Settings = DEFAULT, normaliser=T.nfkc) -> DataFrame:
    """finished (doc, page_no, text, ocr) with the pages that were recognised later, cleaned by their document's known
    boilerplate. Pages that come out blank, or are not among the finished, change nothing. Folding in again is the same."""
    few = P.few_keys(keys)
    new = recognised.select("doc", "page_no", F.col("text").alias("_raw")).join(few, "doc", "left")
    new = new.select("doc", "page_no", P.prepare_page_text(F.coalesce("_raw", F.lit("")), F.col("_keys"), settings, normaliser).alias("_new")).where("_new <> ''")
    both = finished.join(new, ["doc", "page_no"], "left")
    return both.withColumn("ocr", F.col("ocr") | F.col("_new").isNotNull()).withColumn("text", F.coalesce("_new", "text")).drop("_new")


def unread_scans(pages: DataFrame, recognised: DataFrame) -> DataFrame:
    """Scanned pages for which nothing was recognised."""
    return pages.where("scanned").join(recognised.select("doc", "page_no").distinct(), ["doc", "page_no"], "left_anti")


def stale(jobs: DataFrame, done: DataFrame) -> DataFrame:
    """Jobs (doc, settings) that have not been done with these settings: what a change queues again."""
    key = lambda d: d.withColumn("_hash", F.xxhash64(F.to_json("settings")))
    return key(jobs).join(key(done).select("doc", "_hash"), ["doc", "_hash"], "left_anti").drop("_hash")


def output_folders(files: DataFrame, order: str = "seq", tail: str = "_reduced") -> DataFrame:
    """files (name, seq) with folder: the stem, and for a stem that a file of another name took first, its suffix as well."""
    files = files.withColumn("_stem", T.stem(F.col("name")))
    first = files.groupBy(F.col("_stem").alias("_of")).agg(F.min(F.struct(order, "name")).alias("_first"))
    plain, other = F.concat("_stem", F.lit(tail)), F.concat("_stem", F.lit("_"), F.regexp_extract("name", r"\.([^.]*)$", 1), F.lit(tail))
    joined = files.join(first, F.col("_stem").eqNullSafe(F.col("_of")), "left")
    return joined.withColumn("folder", F.when(F.col("name") == F.col("_first.name"), plain).otherwise(other)).drop("_stem", "_of", "_first")


def shared(value: Column) -> Column:
    """The value that all rows of a group have, null if they differ."""
    return F.when((F.count_distinct(value) == 1) & (F.count(value) == F.count(F.lit(1))), F.min(value))


def states(queue: DataFrame) -> DataFrame:
    return queue.groupBy("state").agg(F.count(F.lit(1)).alias("n"))
