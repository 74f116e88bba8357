"""Running lines, markdown, later text, folders."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_text import brute_clean

from folioforge.operators import lifecycle as L
from folioforge.operators import pages as P
from folioforge.operators import reports as R
from folioforge.settings import Settings

SCHEMA = "doc string, page_no int, page_count int, raw string"
NUMBER = re.compile(r"^\s*(?:page\s+)?\d{1,4}(?:\s*[/|of]{1,2}\s*\d{1,4})?\s*$", re.I)


def document(name, pages):
    return [(name, i + 1, len(pages), t) for i, t in enumerate(pages)]


def corpus(spark):
    rows = document("plain", [f"Harbour Survey {i}\nText of page {i} goes on\nmore text\nand more\nlines of it\n{i} of 9" for i in range(1, 9)])
    rows += document("twice", [f"Top line\nwords {i}\n" + ("Top line\n" if i == 2 else "") + f"unique ending {'x' * i}" for i in range(1, 7)])
    rows += document("short", ["Same head\nbody"] * 3)
    rows += document("blank", ["Head of it\nbody a", "", None, "Head of it\nbody b", "Head of it\nbody c", "  "])
    rows += document("digits", ["12\n34\nShared line\nalpha", "7\nShared line\nbeta", "Shared line\ngamma", "Shared line\ndelta"])
    return spark.createDataFrame(rows, SCHEMA), rows


def brute_keys(pages, s):
    if not s.strip_repeated_lines or len(pages) < 4:
        return set()
    edges, twice = Counter(), set()
    for t in pages:
        keys = [re.sub(r"\d+", "#", x.strip()) for x in t.split("\n") if x.strip()]
        twice |= {k for k, n in Counter(keys).items() if n > 1}
        edges.update({k for k in keys[: s.repeat_scan_lines] + keys[-s.repeat_scan_lines :] if 2 <= len(k) <= 100 and sum(map(str.isalpha, k)) > 2})
    return {k for k, n in edges.items() if n >= max(3, int(len(pages) * s.repeat_ratio)) and k not in twice}


def brute_strip(t, keys, s):
    if not keys and not s.drop_page_numbers:
        return t
    kept = [x for x in t.split("\n") if not x.strip() or not (re.sub(r"\d+", "#", x.strip()) in keys or s.drop_page_numbers and NUMBER.match(x.strip()))]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).strip()


@pytest.mark.parametrize("s", [Settings(), Settings(drop_page_numbers=False), Settings(strip_repeated_lines=False, drop_page_numbers=False), Settings(repeat_ratio=0.9, repeat_scan_lines=1)])
def test_reduced(spark, s):
    df, rows = corpus(spark)
    texts = {(d, n): brute_clean(t or "", s) for d, n, _, t in rows}
    keys = {d: brute_keys([t for (e, _), t in texts.items() if e == d], s) for d, *_ in rows}
    got = P.boilerplate(P.cleaned(df, s), s).collect()
    assert {(r.doc, r.key) for r in got} == {(d, k) for d, ks in keys.items() for k in ks} and len(got) == sum(map(len, keys.values()))
    assert {(r.doc, r.page_no): r.text for r in P.reduced(df, s).collect()} == {k: brute_strip(t, keys[k[0]], s) for k, t in texts.items()}


def test_both_ways_to_strip_agree(spark):
    df, _ = corpus(spark)
    clean = P.cleaned(df)
    keys = P.boilerplate(clean)
    one = {(r.doc, r.page_no): r.text for r in P.stripped(clean, keys).collect()}
    assert one == {(r.doc, r.page_no): r.text for r in P.stripped_by_lines(clean, keys).collect()}


def test_keys_take_one_shuffle(spark):
    df, _ = corpus(spark)
    plan = P.furniture_counts(P.cleaned(df, normaliser=None))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


def test_markdown(spark):
    df = spark.createDataFrame([("a.pdf", 2, 2, "raw", "", False), ("a.pdf", 1, 2, "raw", "Body", True)], SCHEMA + ", text string, visual boolean")
    made = P.document_markdown(P.marked(df), Settings.of_request(text_only=True)).first().markdown
    assert made == "# a.pdf\npages: 2\n\n--- p.1 | see p001.png ---\n\nBody\n--- p.2 | no text ---\n"
    assert P.NOTE in P.document_markdown(P.marked(df)).first().markdown


def finished(spark):
    df, _ = corpus(spark)
    return P.reduced(df).select("doc", "page_no", "text", F.lit(False).alias("ocr")), P.boilerplate(P.cleaned(df))


def test_fold_in_is_as_processing_again(spark):
    df, _ = corpus(spark)
    pages, keys = finished(spark)
    late = spark.createDataFrame([("blank", 2, "Head of it\nread   later\n7"), ("blank", 3, "\n 12 \n"), ("gone", 1, "x"), ("plain", 1, None)], "doc string, page_no int, text string")
    once = L.fold_in(pages, keys, late)
    got = {(r.doc, r.page_no): (r.text, r.ocr) for r in once.collect()}
    assert got["blank", 2] == ("read later", True) and got["blank", 3] == ("", False) and len(got) == pages.count()
    assert {(r.doc, r.page_no): (r.text, r.ocr) for r in L.fold_in(once, keys, late).collect()} == got
    again = P.reduced(L.with_supplied(df, late))
    assert {(r.doc, r.page_no): r.text for r in again.where("doc <> 'blank' OR page_no <> 3").collect()} == {k: t for k, (t, _) in got.items() if k != ("blank", 3)}


def test_supplied_text(spark):
    df, _ = corpus(spark)
    given = spark.createDataFrame([("plain", 1, "handed"), ("plain", 2, " \n ")], "doc string, page_no int, text string")
    got = {r.page_no: (r.raw, r.ocr) for r in L.with_supplied(df, given).where("doc = 'plain'").collect()}
    assert got[1] == ("handed", True) and not got[2][1] and got[2][0].startswith("Harbour")


def test_queue_and_folders(spark):
    files = spark.createDataFrame([(1, "r.docx", 5), (2, "r.odt", 5), (3, "r.docx", 5), (4, "r.docx", 6), (5, "x.exe", 1), (6, ".pdf", 1)], "seq int, name string, size int")
    assert [r.seq for r in L.queued(files).orderBy("seq").collect()] == [1, 2, 4]
    assert [r.folder for r in L.output_folders(files.where("seq < 4")).orderBy("seq").collect()] == ["r_reduced", "r_odt_reduced", "r_reduced"]
    assert L.formats(spark).count() == 22


def test_results(spark):
    n = "doc string, page_no int, page_count int, raw string, text string, visual boolean, scanned boolean, ocr boolean, tables int, tables_rejected int, figures_saved int"
    df = P.marked(spark.createDataFrame([("d", 1, 2, "x" * 40, "y" * 20, True, True, False, 1, 0, 0), ("d", 2, 2, "", "", False, True, False, 0, 2, 3)], n))
    r = R.doc_results(df)
    d = r.first()
    assert (d.images_saved, d.tokens_in, d.tokens_out, d.saving, d.needs_ocr, d.ocr_remaining) == (4, 10, 5, 0.5, True, True)
    assert d.message == "2 pages, 4 images, 1 tables, ~5 tokens"
    keys = spark.createDataFrame([("d", "Page #")], "doc string, key string")
    text = R.manifest(r, keys).first().manifest
    assert "running lines removed (# for any number):\n  - Page #\n" in text and "warnings:\n  - 2 of 2 pages" in text and text.startswith("source: d\npages: 2\n")
    assert '"scans":[{"page":1,"image":"d/p001.png"}]' in R.report_json(r, R.page_stats(df)).first().report
    assert R.run_notes(r, R.page_stats(df), keys).first().chars == {1: 20, 2: 0}
    assert R.batch_totals(r).first().scans_unread == 2


def test_late_text_as_a_stream(spark, tmp_path):
    from folioforge.streaming import late_text as S

    pages, keys = finished(spark)
    pages.write.parquet(S.version_path(f"{tmp_path}/t", 0))
    schema = "doc string, page_no int, text string"
    spark.createDataFrame([("blank", 2, "read later"), ("blank", 2, "and")], schema).coalesce(1).write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).json(f"{tmp_path}/in")
    for n in (1, 2):
        S.fold_in_stream(stream, keys, f"{tmp_path}/t", f"{tmp_path}/c").awaitTermination(60)
        out = {(r.doc, r.page_no): r.text for r in spark.read.parquet(S.version_path(f"{tmp_path}/t", n)).collect()}
        assert out["blank", 2] == "read later" and len(out) == pages.count()
        spark.createDataFrame([("blank", 6, "six")], schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    assert out["blank", 6] == "six"


def test_incoming_files(spark, tmp_path):
    from folioforge.streaming import late_text as S

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("hello")
    q = S.incoming_files(spark, f"{tmp_path}/in").select("length").writeStream.format("memory").queryName("files").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination(60)
    assert [r.length for r in spark.table("files").collect()] == [5]
