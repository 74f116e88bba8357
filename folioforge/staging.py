"""Tables that are written once where a run needs them more than once."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def staging_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in tests, where it is unset, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        made = tempfile.mkdtemp(prefix="folioforge-")
        atexit.register(shutil.rmtree, made, True)
        found = f"file://{made}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, so that what follows neither reads nor cleans its source again."""
    path = f"{staging_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def unstaged(*tables: DataFrame) -> None:
    """Deletes staged tables, once what was made of them is written."""
    for t in tables:
        spark = t.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(t.staged_at)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
