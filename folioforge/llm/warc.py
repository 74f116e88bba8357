"""A deterministic sharded WARC writer, and its reader.

Records are range-sorted by id. Every partition writes gzip members, one a record, and rolls to a new file when the
compressed size is reached. Headers are made anew from the payload: digests, lengths, record ids that follow from the
content, a fixed date; so the same rows in the same ranges give the same bytes, whatever their order before. (Where
files begin follows from the ranges, which Spark samples for the number of partitions of the session.) A file is written under a temporary name of the attempt
and renamed when whole: a task that is run again replaces it with the same bytes. The manifest, written after all
tasks, names the files that count, with their size and digest; readers follow only the manifest.

Of records with equal payloads of MIN_REVISIT bytes or more, the one with the largest id is a response and the others
revisit it; smaller ones are all responses. Null payloads are empty. Null urls are written as an empty target. Rows
that repeat an id are each written; of equal payloads with the same largest id each such row is the response.
Rows without an id are written as responses, as nothing could refer to them. Very long payloads are records like others, held one at a
time. Other columns are not read, so their names clash with nothing. An empty table gives an empty manifest.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table

MIN_REVISIT = 1000
MANIFEST = "file string, records long, bytes long, sha256 string"
RECORDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
DATE = "2000-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit names the record it refers to and the digest of the payload, and leaves the payload out."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", target), ("Content-Type", "application/http; msgtype=response")]
    head += [("WARC-Payload-Digest", digest), ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()), ("X-Page-ID", "" if page_id is None else str(page_id))]
    if refers_to is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page", str(refers_to))]
    head.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    """One gzip member without time or name."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Roll:
    """Writes members to files of a folder; a file is renamed to its name once it is whole."""

    def __init__(self, uri: str, prefix: str, attempt: str, limit: int) -> None:
        self.store, self.folder = fs.FileSystem.from_uri(uri)
        self.store.create_dir(self.folder, recursive=True)
        self.prefix, self.attempt, self.limit = prefix, attempt, limit
        self.n, self.out, self.rows = 0, None, []

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.name = f"{self.prefix}-{self.n:05d}.warc.gz"
            self.temporary = f"{self.folder}/_{self.name}.{self.attempt}.tmp"
            self.out, self.sum, self.size, self.count = self.store.open_output_stream(self.temporary, compression=None), hashlib.sha256(), 0, 0
        self.out.write(data)
        self.sum.update(data)
        self.size += len(data)
        self.count += 1
        if self.size >= self.limit:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.store.move(self.temporary, f"{self.folder}/{self.name}")
            self.rows.append((self.name, self.count, self.size, self.sum.hexdigest()))
            self.n, self.out = self.n + 1, None


def revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", smallest: int = MIN_REVISIT) -> tuple[DataFrame, DataFrame]:
    """The pages as (page_id, url, html), and for those that revisit another (page_id, sha256, refers_to), without payloads."""
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("html"))
    digests = p.where(F.octet_length("html") >= smallest).select("page_id", F.unhex(F.sha2(F.col("html").cast("binary"), 256)).alias("sha256"))
    kept = digests.groupBy(F.col("sha256").alias("_d")).agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    found = digests.join(kept, F.col("sha256") == F.col("_d")).where("page_id < refers_to")
    return p, found.select("page_id", "sha256", "refers_to").distinct()


def write_warc(pages: DataFrame, repeats: DataFrame, uri: str, roll_bytes: int = 64 << 20, level: int = 6) -> DataFrame:
    """Writes pages (page_id, url, html), those in repeats (page_id, sha256, refers_to) as revisits, and returns the
    manifest, which stands beside the files as a table. Payloads are shuffled once: what a page repeats is sorted in
    just before it."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        roll = Roll(uri, f"part-{task.partitionId():05d}", f"{task.stageId()}-{task.taskAttemptId()}", roll_bytes)
        of, refers = None, {}
        for batch in batches:
            for page_id, url, html, sha256, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "sha256", "refers_to")), strict=True):
                if page_id != of:
                    of, refers = page_id, {}
                if sha256 is not None:
                    refers[sha256] = refers_to
                else:
                    payload = html.encode()
                    roll.add(member(record(page_id, url, payload, refers.get(hashlib.sha256(payload).digest()) if refers else None), level))
        roll.close()
        columns = [list(x) for x in zip(*roll.rows, strict=True)] or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=[c.split()[0] for c in MANIFEST.split(", ")])

    rows = pages.unionByName(repeats, allowMissingColumns=True)
    ordered = rows.repartitionByRange("page_id").sortWithinPartitions("page_id", F.col("sha256").isNull(), "url", "html")
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{uri}/_manifest")
    return rows.sparkSession.read.schema(MANIFEST).parquet(f"{uri}/_manifest")


def members(stream: io.BufferedIOBase, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    z, parts, data = zlib.decompressobj(31), [], b""
    while data or (data := stream.read(chunk)):
        parts.append(z.decompress(data))
        data = z.unused_data
        if z.eof:
            yield b"".join(parts)
            z, parts = zlib.decompressobj(31), []
    if parts and b"".join(parts):
        raise ValueError("a gzip member is cut off")


def parse(data: bytes) -> tuple:
    """(page_id, url, payload, type, page referred to, payload digest in hex) of a record, its digests verified."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if not lines[0].startswith("WARC/") or rest[len(block) :] != b"\r\n\r\n" or "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode() != fields["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    payload = block.partition(b"\r\n\r\n")[2]
    length = int(block.partition(b"\r\n\r\n")[0].rsplit(b"Content-Length: ", 1)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"][5:])
    if fields["WARC-Type"] == "response" and hashlib.sha1(payload).digest() != digest:
        raise ValueError(f"damaged payload of {fields['WARC-Record-ID']}")
    number = lambda k: int(fields[k]) if fields.get(k) else None
    return number("X-Page-ID"), fields["WARC-Target-URI"], payload if fields["WARC-Type"] == "response" else None, length, digest.hex(), fields["WARC-Type"], number("X-Refers-To-Page")


def read_warc(spark: SparkSession, uri: str, payloads: bool = True) -> DataFrame:
    """The records of the files that the manifest at uri names. Files are dealt to tasks and read as streams.

    A revisit's payload_bytes and payload_digest are those of the full payload; its payload is null.
    """
    files = spark.read.schema(MANIFEST).parquet(f"{uri}/_manifest").where("records > 0")
    schema = RECORDS if payloads else RECORDS.replace("payload binary, ", "")
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = dict(zip(kinds, zip(*rows, strict=True), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds[c]) for c in names], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for name, n in zip(batch.column("file").to_pylist(), batch.column("records").to_pylist(), strict=True):
                rows, seen, size = [], 0, 0
                with store.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                    for data in members(stream):
                        rows.append(parse(data) if payloads else (*(r := parse(data))[:2], None, *r[3:]))
                        seen, size = seen + 1, size + (len(data) if payloads else 200)
                        if size >= 8 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                if seen != n:
                    raise ValueError(f"{name} holds {seen} records, not {n}")
                if rows:
                    yield batch_of(rows)

    return files.select("file", "records").repartition(max(1, files.count())).mapInArrow(read, schema)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(*revisits(table(spark, sf_dir, "pages")), uri)
    return read_warc(spark, uri, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
     k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM k
"""
