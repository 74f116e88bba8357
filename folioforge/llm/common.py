"""What the operators of this subpackage share: reading, cutting lineage, hashing, running sums."""

from __future__ import annotations

import atexit
import functools
import gc
import math
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What counts as white space in texts: U+0009 to U+000D and U+0020.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in tests, where it is unset, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        made = tempfile.mkdtemp(prefix="folioforge-")
        atexit.register(shutil.rmtree, made, True)
        found = f"file://{made}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: For each operator that runs just now, the tables it has written.
_open: list[list[str]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: later reads neither repeat its work nor depend on its executors.

    Within a function that is tidy, the table goes when the function ends."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that were written and are needed no more, and has Spark look for shuffle files that nothing needs any more."""
    spark = tables[0].sparkSession
    deleted(spark, [t.written_at for t in tables])
    gc.collect()
    spark._jvm.System.gc()


def deleted(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def tidy(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The operator with its result written as a table, and its other tables deleted after that.

    Only the result stays in the shared folder, for its caller to delete; an operator that calls this one does so."""

    @functools.wraps(operator)
    def run(*args, **options) -> DataFrame:
        mine: list[str] = []
        _open.append(mine)
        try:
            df = operator(*args, **options)
            spark = df.sparkSession
            _open.pop()
            out = written(df, operator.__name__)
        except BaseException:
            if _open and _open[-1] is mine:
                _open.pop()
            raise
        deleted(spark, mine)
        return out

    return run


def pieces(batch: pa.RecordBatch, column: str = "text", size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about size bytes of a column, so that Python holds few texts at once; a longer text is a slice of its own."""
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at, done = 0, 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(total, done + size, side="right")))
        yield batch.slice(at, end - at)
        at, done = end, int(total[end - 1])


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than SPACES."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, element by element; x is changed and returned."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slice_bits(rows: int, groups_hold: int = 4096) -> int:
    """Bits that cut a group of all rows to slices of about groups_hold rows; 64 slices at least."""
    return max(6, math.ceil(math.log2(max(1, rows) / groups_hold + 1)))


def running_sum(df: DataFrame, group: list[str], key: str, order: list[str], amount: str, out: str, bits: int) -> DataFrame:
    """Adds out: the sum of amount over the rows of the same group that come before this one.

    key: a column of evenly spread longs (a hash), the first in the order. The rows of a group are dealt by
    the key's first bits, so that no task holds a whole group: slices are summed alone, then come running sums
    over the few slices of each group, then over the rows of each slice. Equal rows share sums in any order.
    """
    cut = df.withColumn("_slice", F.shiftright(F.col(key), 64 - bits))
    own = [F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]
    sums = cut.groupBy(*own, F.col("_slice").alias("_s")).agg(F.sum(amount).alias("_sum"))
    names = [f"_g{i}" for i in range(len(group))]
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.partitionBy(*names).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    same = F.col("_slice") == F.col("_s")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    inner = Window.partitionBy(*group, "_slice").orderBy(key, *order).rowsBetween(Window.unboundedPreceding, -1)
    return cut.join(before, same).withColumn(out, F.col("_before") + F.coalesce(F.sum(amount).over(inner), F.lit(0))).drop("_slice", "_s", "_before", *names)
