"""Whole runs over layouts and over files."""

from test_readers import docx

from folioforge.__main__ import main
from folioforge.operators import lifecycle, reports
from folioforge.plans import reduce as run
from folioforge.schemas import PAGE_LAYOUT
from folioforge.settings import Settings

PAGE = dict(zip(("x0", "y0", "x1", "y1"), (0.0, 0.0, 600.0, 840.0), strict=True))


def at(x, y, w=10.0, **more):
    return {"x0": x, "y0": y, "x1": x + w, "y1": y + w} | more


def layouts(spark):
    prose = [f"Head of all\nParagraph {c} with words\nmore of {c}\nyet {c * 3}\nstill {c}\nPage {i}" for i, c in enumerate("abcdef")]
    lines = [at(10.0 * i, 0.0, ops=["l"]) for i in range(4)]
    rows = [(1, prose[0], [], [], [], [], None), (2, prose[1], [], [at(0.0, 0.0, 300.0)], [], [], None), (3, " 7 ", [], [PAGE], [], [], None), (4, None, None, None, None, None, "broken")]
    rows += [(5, "2 x", [at(20.0, 20.0, text="cell")], [], lines, [at(0.0, 0.0, 100.0, rows=[["k", "v"], ["1", "2"]]), at(300.0, 300.0, 9.0, rows=[["one"]])], None)]
    bars = [at(100.0 + 30 * i, 300.0, 60.0, ops=["re"]) for i in range(5)]
    rows += [(6, "few words", [at(110.0 + 30 * i, 310.0, text="9 %") for i in range(5)] + [at(5.0, 5.0, text="Caption line")], [], bars, [], None), (7, "few", [], [], bars * 12, [], None)]
    rows += [(8, prose[2], [], [], [], [], None), (9, prose[3], [], [], [], [], None), (10, prose[4], [], [], [], [], None), (11, prose[5], [], [], [], [], None)]
    return spark.createDataFrame([("d.pdf", n, PAGE, t, b, i, d, tb, e) for n, t, b, i, d, tb, e in rows], PAGE_LAYOUT)


def test_plain_settings(spark):
    out = run.reduce_pages(layouts(spark))
    pages = {r.page_no: r for r in out.pages.collect()}
    assert sorted(n for n, r in pages.items() if r.visual) == [2, 3, 7]
    assert [n for n, r in sorted(pages.items()) if r.scanned] == [3]
    assert pages[4].text == "" and pages[4].marker == "--- p.4 | no text ---" and pages[5].text == "2 x" and pages[3].text == ""
    r = out.results.first()
    assert (r.pages, r.images_saved, r.scanned_pages, r.needs_ocr) == (11, 3, 1, True)
    assert {k.key for k in out.keys.collect()} == {"Head of all", "Page #"}
    text = out.markdown.first().markdown
    assert "Head of all" not in text and "--- p.2 | see p002.png ---" in text and text.startswith("# d.pdf\npages: 11\n")
    assert {x.name for x in out.pictures.collect()} == {"p002.png", "p003.png", "p007.png"}
    assert '"page":3' in out.reports.first().report and "Page #" in out.manifest.first().manifest and out.notes.first().pages == 11 and out.totals.first().scans_unread == 1


def test_tables_and_figures(spark):
    late = spark.createDataFrame([("d.pdf", 3, "read by other means")], "doc string, page_no int, text string")
    out = run.reduce_pages(layouts(spark), Settings(extract_tables=True, chart_regions=True), late)
    pages = {r.page_no: r for r in out.pages.collect()}
    assert pages[5].text == "|k|v|\n|---|---|\n|1|2|" and (pages[5].tables, pages[5].tables_rejected) == (1, 1)
    assert "[figure: p006_f1.png]" in pages[6].text and "Caption line" in pages[6].text and not pages[7].visual
    assert pages[3].text == "read by other means" and pages[3].ocr and pages[3].scanned
    r = out.results.first()
    assert not r.needs_ocr and r.tables_found == 1 and "1 pages read by OCR" in r.message
    assert "p006_f1.png" in {x.name for x in out.pictures.collect()}


def test_text_only_keeps_no_pictures(spark):
    out = run.reduce_pages(layouts(spark), Settings.of_request(text_only=True))
    assert out.pictures.count() == 0 and out.results.first().scanned_pages == 1


def test_files(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.docx").write_bytes(docx())
    (tmp_path / "in" / "bad.odt").write_bytes(b"nothing")
    (tmp_path / "in" / "a.txt").write_bytes("curly “quotes”\r\nand  spaces ".encode())
    got = {r.doc: r for r in run.reduce_files(spark, str(tmp_path / "in")).collect()}
    assert got["a.txt"].markdown == '# a.txt\n\ncurly "quotes"\nand spaces\n' and got["a.txt"].message == "plain text, ~6 tokens"
    assert got["a.docx"].message.startswith("11 blocks, 1 tables, ~") and not got["bad.odt"].ok
    assert main([str(tmp_path / "in"), "-o", str(tmp_path / "out")]) == 1
    said = capsys.readouterr()
    assert "a.txt: plain text" in said.out and "Could not read bad.odt" in said.err and "1 failed" in said.out
    assert len({r.folder for r in spark.read.parquet(str(tmp_path / "out")).collect()}) == 2
    (tmp_path / "in" / "p.pdf").write_bytes(b"pages")
    (tmp_path / "in" / "s.png").write_bytes(b"dots")
    assert main([str(tmp_path / "in"), "-q"]) == 1
    said = capsys.readouterr()
    assert said.out == "" and "Could not read p.pdf: reading paged formats takes a reader" in said.err and "s.png" not in said.err
    pages = lambda suffix, content: [{"page_no": 1, "page_rect": PAGE, "text": "“Some” text"}, {"page_no": 2, "error": "torn"}]
    assert main([str(tmp_path / "in"), "-t", "50", "--dpi", "72", "--tables", "--figures", "--keep-headers", "--raw-punctuation"], pages) == 1
    assert "p.pdf: 2 pages, 0 images" in capsys.readouterr().out
    assert main(["--formats"]) == 0 and ".docx" in capsys.readouterr().out


def test_failures_are_results(spark):
    rows = [("bad.pdf", None, None, None, None, None, None, None, "ValueError: needs a password"), ("d.pdf", 12, PAGE, "", [], [], [], [], "torn")]
    out = run.reduce_pages(layouts(spark).unionByName(spark.createDataFrame(rows, PAGE_LAYOUT)))
    found = {r.doc: r for r in out.results.collect()}
    assert not found["bad.pdf"].ok and found["bad.pdf"].message == "Could not read bad.pdf: ValueError: needs a password" and found["bad.pdf"].pages == 0
    assert found["d.pdf"].ok and found["d.pdf"].pages == 12 and found["d.pdf"].warnings == ["page 4: broken", "page 12: torn"]
    assert out.totals.first().failures == 1
    assert "  - page 4: broken" in {r.doc: r.manifest for r in out.manifest.collect()}["d.pdf"]
    assert '"page 12: torn"' in {r.doc: r.report for r in out.reports.collect()}["d.pdf"]
    queue = spark.createDataFrame([("bad.pdf",), ("d.pdf",), ("new.pdf",)], "name string")
    assert {r.name: r.state for r in lifecycle.queue_results(queue, out.results).collect()} == {"bad.pdf": "failed", "d.pdf": "done", "new.pdf": "waiting"}
    assert reports.cancelled(queue.withColumnRenamed("name", "doc")).first().message == "Cancelled."


def test_cancel_and_progress(spark):
    with run.cancellable(spark, "run-1"):
        assert "run-1" in spark.getTags()
    assert "run-1" not in spark.getTags() and run.progress(spark) == (0, 0)
