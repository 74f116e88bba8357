"""Where results go: a file for each document by a table's folders, archives, the joined text."""

from __future__ import annotations

import ctypes
import io
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..staging import staged


def write_documents(documents: DataFrame, path: str) -> None:
    """documents (folder, markdown, ...) as a table partitioned by folder; only the folders written to are replaced."""
    documents.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("folder").parquet(path)


def joined_text(documents: DataFrame, *group: str) -> DataFrame:
    """One text of all documents (folder, name, markdown) of a group, in the order of folders and names."""
    ordered = F.array_sort(F.collect_list(F.struct("folder", "name", "markdown")))
    return documents.groupBy(*group).agg(F.array_join(F.transform(ordered, lambda x: x.markdown), "\n\n").alias("text"))


#: Bytes of texts that a task digests, about.
PIECE = 128 << 20


def _resumable() -> ctypes.CDLL | None:
    """OpenSSL's MD5, whose state can be handed on; None where Python has no such library."""
    try:
        import _hashlib

        found = ctypes.CDLL(_hashlib.__file__)
        return found if found.MD5_Init and found.MD5_Update and found.MD5_Final else None
    except (ImportError, OSError, AttributeError):
        return None


def _digest_on(states: dict[int, bytes]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Digests sorted rows (_p, _last, markdown) from the states of their pieces on: (_p, state), a digest after a text's last piece.
    A state is whether a text came yet, and OpenSSL's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        md5, open_ = _resumable(), {}
        for batch in batches:
            for p, last, text in zip(*(batch.column(c).to_pylist() for c in ("_p", "_last", "markdown")), strict=True):
                if p not in open_:
                    state = ctypes.create_string_buffer(256)
                    if p in states:
                        state.raw = states[p][1:]
                    else:
                        md5.MD5_Init(state)
                    open_[p] = [p in states and states[p][:1] == b"1", state, last]
                if text is not None:
                    data = (b"\n\n" if open_[p][0] else b"") + text.encode()
                    md5.MD5_Update(open_[p][1], data, ctypes.c_size_t(len(data)))
                    open_[p][0] = True
        out = []
        for p, (began, state, last) in open_.items():
            if last:
                digest = ctypes.create_string_buffer(16)
                md5.MD5_Final(digest, state)
                out.append({"_p": p, "state": digest.raw})
            else:
                out.append({"_p": p, "state": (b"1" if began else b"0") + state.raw})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("_p", pa.int32()), ("state", pa.binary())]))

    return run


def joined_digests(documents: DataFrame, *group: str, piece: int = PIECE) -> DataFrame:
    """(group, md5) of the texts that joined_text gives, also of those that no task and no value can hold.

    Documents are dealt into pieces by their order. A text within one piece is made; of a longer one the pieces are digested one
    after the other, all texts side by side, each from the state that the one before left. The driver gets a state for each
    piece that does not end its text. Where OpenSSL's states can't be had all texts are made, and must fit a value.
    """
    spark = documents.sparkSession
    d = documents.select(*group, "folder", "name", "markdown")
    made = lambda docs: joined_text(docs, *group).select(*group, F.md5(F.col("text").cast("binary")).alias("text"))
    total = d.agg(F.sum(F.octet_length("markdown"))).first()[0] or 0
    if total <= piece or _resumable() is None:
        return made(d)
    dealt = d.repartitionByRange(-(-total // piece), *group, "folder", "name")
    parts = staged(dealt.withColumn("_p", F.spark_partition_id()), "pieces")
    of = Window.partitionBy(*group)
    ranks = parts.groupBy(*group, "_p").agg(F.count(F.lit(1)).alias("_rows"))
    ranks = staged(ranks.select(*group, "_p", F.row_number().over(of.orderBy("_p")).alias("_k"), F.count(F.lit(1)).over(of).alias("_n")), "ranks")

    def within(which: Column, docs: DataFrame) -> DataFrame:
        r = ranks.where(which).select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), F.col("_p").alias("_q"), (F.col("_k") == F.col("_n")).alias("_last"))
        same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
        return docs.join(r, reduce(Column.__and__, same, F.col("_p") == F.col("_q"))).select(*group, "_p", "_last", "folder", "name", "markdown")

    out = made(within(F.col("_n") == 1, parts))
    chains: dict[int, list[int]] = {}
    rows = ranks.where("_n > 1").groupBy(*group).agg(F.array_sort(F.collect_list("_p")).alias("ps")).select("ps").collect()
    for ps in (r.ps for r in rows):  # a piece has one text at most that began before it, and one that goes on after it
        chains[ps[0]] = ps
    states: dict[int, bytes] = {}
    done: dict[int, bytes] = {}
    for k in range(max(map(len, chains.values()), default=0)):
        now = {ps[k]: first for first, ps in chains.items() if k < len(ps)}
        docs = within((F.col("_n") > 1) & (F.col("_k") == k + 1), parts.where(F.col("_p").isin(list(now))))
        ordered = docs.repartition(len(now), "_p").sortWithinPartitions("_p", "folder", "name", "markdown").select("_p", "_last", "markdown")
        left = {r._p: bytes(r.state) for r in ordered.mapInArrow(_digest_on({p: states[f] for p, f in now.items() if f in states}), "_p int, state binary").collect()}
        for p, first in now.items():
            (done if p == chains[first][-1] else states)[first] = left[p]
    if not done:
        return out
    found = spark.createDataFrame([(first, digest.hex()) for first, digest in done.items()], "_first int, text string")
    firsts = ranks.where("_n > 1 AND _k = 1").select(*group, "_p")
    return out.unionByName(firsts.join(found, F.col("_p") == F.col("_first")).select(*group, "text"))


def _zipped(names: list[str], texts: list[str | None]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in zip(names, texts, strict=True):
            z.writestr(zipfile.ZipInfo(name), text or "")
    return out.getvalue()


def archives(files: DataFrame) -> DataFrame:
    """(doc, archive): a zip of each document's files (doc, name, text), made a batch of rows at a time. A document's files must fit a value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_zipped([f["name"] for f in files.as_py()], [f["text"] for f in files.as_py()]) for files in batch.column("f")]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(made, pa.binary())], names=["doc", "archive"])

    kind = dict(files.dtypes)["doc"]
    return files.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("name", "text"))).alias("f")).mapInArrow(run, f"doc {kind}, archive binary")


def outputs(spark: SparkSession, path: str) -> DataFrame:
    """(folder, name, chars): what stands under a path; empty if nothing was written there."""
    at, store = _path(spark, path)
    if not store.exists(at) or not len(store.listStatus(at)):
        return spark.createDataFrame([], "folder string, name string, chars long")
    return spark.read.parquet(path).select(F.col("folder").cast("string").alias("folder"), "name", F.length("markdown").cast("long").alias("chars"))


def output(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """The documents of one folder; only that folder is read."""
    return spark.read.parquet(path).where(F.col("folder") == folder)


def drop_output(spark: SparkSession, path: str, folder: str) -> bool:
    """Deletes one folder; whether there was one."""
    name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(folder)
    at, store = _path(spark, f"{path}/folder={name}")
    return bool(store.delete(at, True))


def clear_outputs(spark: SparkSession, path: str) -> bool:
    at, store = _path(spark, path)
    return bool(store.delete(at, True))


def drop_stale(spark: SparkSession, path: str, documents: DataFrame) -> int:
    """Deletes the folders under a path that no document (folder) has any more; how many. Folders are partitions, few enough to name."""
    gone = [r.folder for r in outputs(spark, path).select("folder").distinct().join(documents.select("folder").distinct(), "folder", "left_anti").toLocalIterator()]
    return sum(drop_output(spark, path, f) for f in gone)


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def delivery_name(name: Column, ending: str = "md") -> Column:
    return F.concat(F.lit("optimised_"), F.regexp_replace(name, r"(?i)\.pdf$", ""), F.lit(f".{ending}"))
