"""Readers and sinks over files that the tests write."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from folioforge.operators import grids
from folioforge.sources import adapters, office, plain, sinks

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
O = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0"'


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/") + ".xml", text)
    return out.getvalue()


def p(text, style=None, more=""):
    return f'<w:p><w:pPr>{f"<w:pStyle w:val={chr(34)}{style}{chr(34)}/>" if style else ""}{more}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'


def tbl(*rows):
    return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{c}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"


STYLES = f"""<w:styles {W}><w:style w:styleId="N1"><w:name w:val="heading 2"/></w:style><w:style w:styleId="Obsah"><w:name w:val="TOC 1"/></w:style><w:style><w:name w:val="heading 1"/></w:style>
<w:style w:styleId="Out"><w:name w:val="Chapter"/><w:pPr><w:outlineLvl w:val="0"/></w:pPr></w:style><w:style w:styleId="TH"><w:name w:val="toc heading"/><w:pPr><w:outlineLvl w:val="0"/></w:pPr></w:style><w:style w:styleId="Deep"><w:name w:val="heading 9"/></w:style></w:styles>"""
BODY = (
    p("Rivers", "N1") + p("skipped 3", "Obsah") + p(" ") + p("Top", "Title") + p("chap", "Out") + p("plain", "TH") + p("deep", "Deep") + p("item", None, "<w:numPr/>")
    + "<w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/><w:t>c</w:t></w:r></w:p>" + tbl([p("k"), p("v")], [p("1") + p("2"), p("")]) + tbl([p(""), p("")]) + tbl([p("x" * 301) + p("inner", "N1"), p("y")])
)


def docx(body=BODY, styles=STYLES):
    return zipped(word__document=f"<w:document {W}><w:body>{body}</w:body></w:document>", **({"word__styles": styles} if styles else {}))


def test_word():
    got = office.blocks_of(".docx", docx())
    assert got == [
        ("heading", "Rivers", 2, None), ("heading", "Top", 1, None), ("heading", "chap", 1, None), ("body", "plain", None, None), ("heading", "deep", 6, None), ("list", "item", None, None),
        ("body", "a b\nc", None, None), ("table", None, None, [["k", "v"], ["12", ""]]), ("body", "x" * 301, None, None), ("heading", "inner", 2, None), ("body", "y", None, None),
    ]
    assert office.blocks_of(".docx", docx(p("t", "N1"), None)) == [("body", "t", None, None)]
    assert office.blocks_of(".docx", docx(p("t", "N1"), "<broken")) == [("body", "t", None, None)]


def test_open_document():
    body = """<text:h text:outline-level="9">Head<text:s text:c="3"/>line</text:h><text:p>one<text:tab/>two<text:line-break/>three <text:span>four</text:span> five</text:p><text:p/>
    <text:section><text:list><text:list-item><text:p>first</text:p></text:list-item></text:list></text:section>
    <table:table><table:table-row><table:table-cell><text:p>a</text:p></table:table-cell><table:table-cell/></table:table-row></table:table><table:table><table:table-row/></table:table>"""
    got = office.blocks_of(".odt", zipped(content=f"<office:document {O}><office:body><office:text>{body}</office:text></office:body></office:document>"))
    assert got == [("heading", "Head line", 6, None), ("body", "one two\nthree four five", None, None), ("list", "first", None, None), ("table", None, None, [["a", ""]])]


def test_read_office(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx())
    (tmp_path / "bad.DOCX").write_bytes(b"no zip")
    (tmp_path / "x.txt").write_text("x")
    blocks = office.read_office(spark, str(tmp_path))
    rows = blocks.collect()
    assert {r.doc_id for r in rows if r.error} == {"bad.DOCX"} and sum(r.doc_id == "a.docx" for r in rows) == 11
    made = grids.blocks_markdown(blocks.where("error IS NULL").withColumnRenamed("doc_id", "doc")).first().markdown
    assert made.startswith("## Rivers\n\n# Top\n\n# chap\n\nplain\n\n###### deep\n\n- item\n\na b\nc\n\n|k|v|\n|---|---|\n|12||\n\nxxx")
    with pytest.raises(ValueError, match="not a Word"):
        office.blocks_of(".pdf", b"")


def test_read_plain(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é\r\nb\rc".encode() + b"\xff!")
    (tmp_path / "b.MD").write_bytes(b"\r")
    (tmp_path / "none.txt").write_bytes(b"")
    (tmp_path / "none.bin").write_bytes(b"")
    assert {r.doc: r.raw for r in plain.read_plain(spark, str(tmp_path)).collect()} == {"a.txt": "é\nb\nc\ufffd!", "b.MD": "\n", "none.txt": ""}


def test_adapters(spark):
    files = spark.createDataFrame([("/x/a.pdf", b"12"), ("/x/b.pdf", b""), ("/x/c.PNG", b"0")], "path string, content binary")
    with pytest.raises(adapters.AdapterMissing):
        adapters.page_layouts(files)
    with pytest.raises(adapters.AdapterMissing):
        adapters.recognised(files)

    def reader(suffix, content):
        return [{"page_no": i + 1, "text": chr(c)} for i, c in enumerate(content)] if suffix == ".pdf" else 1 / 0

    got = sorted((r.doc_id, r.page_no or 0, r.text, r.error) for r in adapters.page_layouts(files, reader).collect())
    assert got == [("a.pdf", 1, "1", None), ("a.pdf", 2, "2", None), ("b.pdf", 0, None, "no pages"), ("c.PNG", 0, None, "ZeroDivisionError: division by zero")]
    pictures = spark.createDataFrame([("d", 1, b"abc"), ("d", 2, b""), ("d", 3, None)], "doc string, page_no int, picture binary")
    assert [r.text for r in adapters.recognised(pictures, lambda x: x.decode().upper() if x else 1 / 0).orderBy("page_no").collect()] == ["ABC", None, None]
    one = adapters.image_layout(files.where("path LIKE '%PNG'")).first()
    assert one.doc_id == "c.PNG" and one.text == "" and one.images == [one.page_rect]


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([("a", "x.md", "X"), ("b", "y.md", "Y")], "folder string, name string, markdown string")
    sinks.write_documents(docs, str(tmp_path / "out"))
    sinks.write_documents(docs.where("folder = 'b'").withColumn("markdown", F.lit("Z")), str(tmp_path / "out"))
    assert sorted((r.folder, r.markdown) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", "X"), ("b", "Z")]
    assert sinks.joined_text(docs).first().text == "X\n\nY"
    z = sinks.archives(spark.createDataFrame([("d", "b.txt", "2"), ("d", "a.txt", "1")], "doc string, name string, text string")).first()
    with zipfile.ZipFile(io.BytesIO(z.archive)) as f:
        assert [(n, f.read(n)) for n in f.namelist()] == [("a.txt", b"1"), ("b.txt", b"2")]


def test_outputs(spark, tmp_path):
    at = str(tmp_path / "out")
    assert sinks.outputs(spark, at).count() == 0
    docs = spark.createDataFrame([("a b", "x.md", "X"), ("b", "y.md", "Y"), ("c=d", "z.md", "ZZ")], "folder string, name string, markdown string")
    sinks.write_documents(docs, at)
    assert sorted(tuple(r) for r in sinks.outputs(spark, at).collect()) == [("a b", "x.md", 1), ("b", "y.md", 1), ("c=d", "z.md", 2)]
    assert sinks.output(spark, at, "b").first().markdown == "Y"
    assert sinks.drop_output(spark, at, "c=d") and not sinks.drop_output(spark, at, "c=d")
    assert sinks.drop_stale(spark, at, docs.where("folder = 'b'")) == 1 and [r.folder for r in sinks.outputs(spark, at).collect()] == ["b"]
    assert sinks.clear_outputs(spark, at) and sinks.outputs(spark, at).count() == 0


def test_tables_in_tables():
    """Cells of a grid in a grid are its text; a long cell turns the grid around it into its blocks, and so does depth."""
    inner = tbl([p("in"), p("ner")])
    assert office.blocks_of(".docx", docx(tbl([p("a") + inner, p("b")]))) == [("table", None, None, [["ainner", "b"]])]
    assert office.blocks_of(".docx", docx(tbl([p("y" * 301) + inner, p("b")]))) == [("body", "y" * 301, None, None), ("table", None, None, [["in", "ner"]]), ("body", "b", None, None)]
