"""Late text and new files as streams.

Recognised text that arrives later is folded into a table of finished pages, batch by batch. A batch is applied once:
its number is in the name of the version it writes, so a batch that is run again writes the same version again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.lifecycle import fold_in
from ..settings import DEFAULT, Settings


def version_path(table: str, version: int) -> str:
    return f"{table}/version={version:09d}"


def fold_in_stream(recognised: DataFrame, keys: DataFrame, table: str, checkpoint: str, settings: Settings = DEFAULT, available_now: bool = True) -> StreamingQuery:
    """Folds a stream (doc, page_no, text) into the pages under table; batch n makes version n + 1 from version n.

    The first version (0) must be there. Of several texts for a page in a batch the greatest counts.
    """

    def apply(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        finished = spark.read.parquet(version_path(table, n))
        once = batch.groupBy("doc", "page_no").agg({"text": "max"}).withColumnRenamed("max(text)", "text")
        fold_in(finished, keys, once, settings).select(*finished.columns).write.mode("overwrite").parquet(version_path(table, n + 1))

    out = recognised.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()


def incoming_files(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A folder as a stream of files (path, modificationTime, length, content), a bounded number a batch."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)
