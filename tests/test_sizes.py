"""What larger tables brought up: each of these failed, or cost far more, before."""

import hashlib
import random
import re

import pyarrow as pa
from conftest import SF
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import grids, layout
from folioforge.operators import pages as P
from folioforge.operators import regions as R
from folioforge.plans import page_queries, run_queries
from folioforge.settings import Settings
from folioforge.sources import sinks


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sizes_of_long_documents(spark, tmp_path):
    rows = [(i, "s", "x" * (2_000_000 if i == 30 else 1)) for i in range(1, 31)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    value = page_queries.ALL["human_size"][0](spark, str(tmp_path)).where("page_no = 30").first().value
    assert value == "5550.4 MB"


def test_ties_of_sizes_are_even(spark):
    rows = spark.createDataFrame([(1, 5 << 18), (2, 7 << 18), (3, 9 << 18)], "i int, v long")
    assert [r.x for r in rows.select("i", T.human_size(F.col("v")).alias("x")).orderBy("i").collect()] == ["1.2 MB", "1.8 MB", "2.2 MB"]


def test_blanks_and_what_nfkc_may_change(spark):
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    d = spark.createDataFrame([(c,) for c in every[:0x3100] + every[0x3100::97]], "c string")
    assert d.where(F.col("c").rlike(T._MAY_CHANGE) != F.col("c").rlike(T.NFKC_MAY_CHANGE)).count() == 0
    assert {r.c for r in d.where(F.col("c").rlike(T.BLANK)).collect()} == set(T._BLANKS)


def test_strip_of_short_and_long_texts(spark):
    texts = ["", " ", "\u3000\x1c a \u2028 b\x85\n", " \u00a0é ", "\t" + "a " * (1 << 19) + "b\u2003 ", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, v string")
    want = ["", "", "a \u2028 b", "é", "a " * (1 << 19) + "b", None]
    assert [r.x for r in rows.select("i", T.strip(F.col("v")).alias("x")).orderBy("i").collect()] == want


def test_nfkc_gives_back_only_what_it_changes():
    many = ["½", None, "č", "plain"] * 100
    assert T._nfkc.func(pa.array(many, pa.string())).to_pylist() == ["1\u20442", None, None, None] * 100
    assert T._nfkc.func(pa.array([], pa.string())).to_pylist() == []


def test_edge_lines_split_a_page_once(spark):
    pages = spark.createDataFrame([("d", n, "\n".join(f"l{i}" for i in range(n))) for n in (1, 2, 4, 7)] + [("d", 0, " "), ("d", 9, None)], "doc string, page_no int, text string")
    found = {(r.page_no, r.line_no, r.line) for r in P.edge_lines(pages).collect()}
    assert found == {(n, i, f"l{i}") for n in (1, 2, 4, 7) for i in range(n) if i < 3 or i >= n - 3}
    assert plan(P.edge_lines(pages)).count("split(") == 1


def test_strip_by_lines_joins_no_pages(spark):
    pages = spark.createDataFrame([("d", 1, "head\n7"), ("d", 2, "head\n\nbody"), ("e", 1, "head"), ("e", 2, None)], "doc string, page_no int, text string")
    keys = spark.createDataFrame([("d", "head"), ("d", "head")], "doc string, key string")
    out = P.stripped_by_lines(pages, keys)
    assert {tuple(r) for r in out.collect()} == {("d", 1, ""), ("d", 2, "body"), ("e", 1, "head"), ("e", 2, "")}
    assert len(re.findall(r"\bJoin\b", plan(out))) == 1


def test_runs_read_their_documents_once(spark):
    for name in ("run_notes", "manifest"):
        files = run_queries.ALL[name][0](spark, SF).inputFiles()
        assert files and not any("documents.parquet" in f for f in files)


def test_regions_of_pages_together_are_those_of_each():
    rng = random.Random(3)
    texts = ["12 %", "a b c d e f g", "one\n\n two words", "", None, "x\n y z\nlong line of many words here"]

    def rect(w, h, far=30.0):
        x, y = rng.uniform(-far, w), rng.uniform(-far, h)
        return {"x0": x, "y0": y, "x1": x + rng.uniform(-2, w / 3), "y1": y + rng.uniform(-2, h / 3)}

    rows = [{"page_rect": None, "boxes": None, "blocks": None, "tables": None}]
    for i in range(1500):
        w, h = rng.choice([(240.0, 280.0), (600.0, 840.0), (7.0, 900.0), (0.0, 10.0)])
        n = 50 if i % 300 == 0 else rng.randrange(9)
        boxes = [rect(w, h) for _ in range(n)] if i % 7 else [{k: float(round(v / 10) * 10) for k, v in rect(w, h).items()} for _ in range(n)]
        x, y = rng.choice([(0.0, 0.0), (3.5, -7.25)])
        rows.append({"page_rect": {"x0": x, "y0": y, "x1": x + w, "y1": y + h}, "boxes": boxes, "blocks": [rect(w, h) | {"text": rng.choice(texts)} for _ in range(rng.randrange(6))], "tables": [rect(w, h) for _ in range(rng.randrange(2))] if i % 5 else None})
    side = pa.struct([(c, pa.float64()) for c in ("x0", "y0", "x1", "y1")])
    block = pa.struct([*side, ("text", pa.string())])
    batch = pa.RecordBatch.from_pylist(rows, pa.schema([("page_rect", side), ("boxes", pa.list_(side)), ("blocks", pa.list_(block)), ("tables", pa.list_(side))]))
    corners = lambda a: [(r["x0"], r["y0"], r["x1"], r["y1"]) for r in a or ()]
    s = Settings(chart_regions=True, chart_min_paths=1)
    for part in (batch, batch.slice(700, 400), batch.slice(0, 0)):
        want = [R.regions_of(*corners([r["page_rect"]]), corners(r["boxes"])) if r["page_rect"] else [] for r in part.to_pylist()]
        assert [corners(x) for x in R.figures_of(part, None).to_pylist()] == want
        want = [R.charts_of(*corners([r["page_rect"]]), corners(r["boxes"]), list(zip(corners(r["blocks"]), [b["text"] for b in r["blocks"]])), corners(r["tables"]), s) if r["page_rect"] else [] for r in part.to_pylist()]
        assert [corners(x) for x in R.figures_of(part, s).to_pylist()] == want
        assert part.num_rows < 9 or sum(map(len, want)) > 20


def test_parts_of_a_page_are_computed_once(spark):
    texts = spark.createDataFrame([("a b\nc",)], "v string").select(T.words_per_line(F.col("v")).alias("x"))
    assert texts.first().x == 1.5 and plan(texts).count("split(") == 2  # the lines of the text, the words of a line
    rows = spark.createDataFrame([([["a", None], ["|", "c", "d"]],), ([[" "], ["x"]],)], "rows array<array<string>>")
    grid = rows.select(grids.markdown_grid(F.col("rows")).alias("x"))
    assert [r.x for r in grid.collect()] == ["|a|||\n|---|---|---|\n|\\||c|d|", "|Col1|\n|---|\n| |\n|x|"]
    assert plan(grid).count("array_max") == 1


def test_coverage_is_one_shuffle(spark):
    rect = "struct<x0:double,y0:double,x1:double,y1:double>"
    page, full, half, dot = (0.0, 0.0, 320.0, 320.0), (0.0, 0.0, 320.0, 320.0), (0.0, 0.0, 320.0, 155.0), (0.0, 0.0, 1.0, 1.0)
    corner = (315.0, -5.0, 400.0, 319.0)
    rows = [(1, full, page), (1, half, page), (2, half, page), (2, corner, page), (3, dot, page), (4, full, None), (5, full, (5.0, 5.0, 5.0, 9.0)), (None, half, page)]
    out = layout.coverage_of_boxes(spark.createDataFrame(rows, f"page_id long, box {rect}, page_rect {rect}"), ["page_id"])
    assert {tuple(r) for r in out.collect()} == {(1, 1.0), (2, 0.515625), (None, 0.5)}
    assert len(re.findall(r"\bAggregate\b", plan(out))) == 1


def test_digests_of_joined_texts_by_pieces(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["en", "de", None, "é"]), f"f{rng.randrange(3)}", f"{i:04d}", rng.choice([None, "", "é" * rng.randrange(90), "text " * rng.randrange(40)])) for i in range(300)]
    rows += [("one", None, "1", "alone"), ("none", "f", "2", None), ("none", "f", "3", None)]
    docs = spark.createDataFrame(rows, "lang string, folder string, name string, markdown string")
    want = {}
    for lang, folder, name, text in sorted(rows, key=lambda r: (r[1] or "", r[2])):
        want.setdefault(lang, []).extend([] if text is None else [text])
    want = {k: hashlib.md5("\n\n".join(v).encode()).hexdigest() for k, v in want.items()}
    for piece in (1 << 30, 3000, 700):
        assert {r.lang: r.text for r in sinks.joined_digests(docs, "lang", piece=piece).collect()} == want
