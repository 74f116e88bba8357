"""WARC files, the queries with SQL, and the pipeline."""

import gzip
import hashlib
import io
from collections import Counter, defaultdict

import pytest
from conftest import SF
from pyspark.sql import functions as F

import corpus_pipeline
from folioforge.llm import registry
from folioforge.llm import warc as W
from folioforge.llm.near_dup import classes

PAGES = "page_id long, url string, html string, sha256 string, refers_to long"
BIG = "<p>é" + "x" * 1200
ROWS = [(1, "http://a", BIG), (2, "http://b", BIG), (9, None, BIG), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (None, "n", BIG), (7, "line\r\nbreak", "a\r\n\r\nb"), (8, "v", "y" * 300_000), (9, "again", BIG), (10, "w", "z" * 999), (11, "w", "z" * 999)]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", 99) for r in rows], PAGES)


@pytest.mark.parametrize("roll", [1, 500, 64 << 20])
def test_round_trip(spark, tmp_path, roll):
    uri = f"file://{tmp_path}/w"
    manifest = {r.file: r for r in W.write_warc(*W.revisits(pages(spark, ROWS)), uri, roll_bytes=roll).collect()}
    found = W.read_warc(spark, uri).collect()
    last = {}
    for i, _, h in ROWS:
        if len((h or "").encode()) >= 1000 and i is not None:
            last[h] = max(last.get(h, i), i)
    want = Counter()
    for i, u, h in ROWS:
        raw = (h or "").encode()
        to = last[h] if i is not None and h in last and i < last[h] else None
        want[i, (u or "").replace("\r", "%0D").replace("\n", "%0A"), raw if to is None else None, len(raw), hashlib.sha1(raw).hexdigest(), "response" if to is None else "revisit", to] += 1
    assert Counter((r.page_id, r.url, None if r.payload is None else bytes(r.payload), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == want
    files = sorted(p for p in (tmp_path / "w").iterdir() if p.name.endswith(".gz"))
    assert {p.name for p in files} == set(manifest) and not list((tmp_path / "w").glob("*.tmp"))
    for p in files:
        assert hashlib.sha256(p.read_bytes()).hexdigest() == manifest[p.name].sha256 and gzip.decompress(p.read_bytes()).startswith(b"WARC/1.1\r\n")
    again = {r.file: r.sha256 for r in W.write_warc(*W.revisits(pages(spark, ROWS[::-1])), f"{uri}2", roll_bytes=roll).collect()}
    assert again == {f: r.sha256 for f, r in manifest.items()}


def test_only_the_manifest_counts(spark, tmp_path):
    uri = f"file://{tmp_path}/w"
    W.write_warc(*W.revisits(pages(spark, ROWS)), uri)
    (tmp_path / "w" / "part-00099-00000.warc.gz").write_bytes(b"left by an attempt that failed")
    assert W.read_warc(spark, uri).count() == len(ROWS)
    W.write_warc(*W.revisits(pages(spark, [])), f"{uri}3")
    assert W.read_warc(spark, f"{uri}3").collect() == []


def test_damage_is_told():
    data = W.record(1, "u", b"payload", None)
    assert W.parse(data)[2] == b"payload"
    with pytest.raises(ValueError, match="damaged"):
        W.parse(data.replace(b"payload", b"pAyload"))
    with pytest.raises(ValueError, match="cut off"):
        list(W.members(io.BytesIO(W.member(data, 6)[:-20])))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_queries_agree_with_sql(agree, name):
    agree(registry.QUERIES[name], registry.ORACLES[name])


@pytest.mark.parametrize("name", ["op10_secrets", "op5_toxicity", "op7_packing", "op4_cotrain", "op6_suffix_dedup"])
def test_queries_cover_all_documents(spark, name):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    got = registry.QUERIES[name](spark, SF)
    assert got.select("doc_id").distinct().count() == n if name != "op6_suffix_dedup" else got.where("n_words < 50").count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.withColumn("_id", F.lit(1)).withColumn("text_sha256", F.lit("x"))
    odd = spark.createDataFrame([(900_001, None, None, None, None, 1, "x"), (900_002, "", "en", "s", 0, 1, "x"), (None, "only here", "en", None, 9, 1, "x")], extra.schema)
    step = extra.unionByName(odd)
    tox, exact, near, mixing, packing = (f for _, f in corpus_pipeline.STAGES)

    kept = tox(spark, step, SF).cache()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = {r.doc_id for r in kept.collect()}
    assert {900_001, 900_002, None} <= ids and sum(i in ids for i, t in labels.items() if not t) >= 0.95 * sum(not t for t in labels.values())

    one = exact(spark, kept, SF).cache()
    groups = defaultdict(list)
    for r in kept.collect():
        groups["".join(c for c in r.text or "" if c not in " \t\n\x0b\x0c\r")].append((-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
    assert sorted((r.doc_id or 0) for r in one.collect()) == sorted(min(g)[2] for g in groups.values())

    few = near(spark, one, SF).cache()
    of = {r.doc_id: r.class_id for r in classes(one).collect()}
    assert sorted((r.doc_id or 0) for r in few.collect()) == sorted((i or 0) for i, c in of.items() if i is None or i == c)

    mixed = mixing(spark, few, SF).cache()
    assert all(s.columns == extra.columns for s in (kept, one, few, mixed))
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in few.collect()}
    assert packing(spark, mixed, SF).count() == mixed.count()


def test_pipeline_of_nothing(spark):
    step = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, f in corpus_pipeline.STAGES:
        step = f(spark, step, SF)
        assert step.count() == 0


def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, SF).count() > 50 and corpus_pipeline.ORACLE_SQL is None
