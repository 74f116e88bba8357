"""Coverage, grids, assembly and regions against the definitions written out."""

import random

import pytest
from pyspark.sql import functions as F

from folioforge.operators import assembly, grids, layout, regions
from folioforge.schemas import RECT
from folioforge.settings import Settings

PAGE = (10.0, 20.0, 610.0, 860.0)


def brute_coverage(page, boxes, smallest=0.004):
    cells, w, h = set(), page[2] - page[0], page[3] - page[1]
    for b in boxes:
        x0, y0, x1, y1 = max(b[0], page[0]), max(b[1], page[1]), min(b[2], page[2]), min(b[3], page[3])
        if x0 >= x1 or y0 >= y1 or (x1 - x0) * (y1 - y0) / (w * h) < smallest:
            continue
        at = lambda v, low, size: int((v - low) / size * 32)
        cells |= {(r, c) for r in range(at(y0, page[1], h), min(32, at(y1, page[1], h) + 1)) for c in range(at(x0, page[0], w), min(32, at(x1, page[0], w) + 1))}
    return len(cells) / 1024


def random_boxes(r, n):
    out = []
    for _ in range(n):
        x, y = r.uniform(-50, 620), r.uniform(-50, 880)
        out.append((x, y, x + r.uniform(-5, 200), y + r.uniform(-5, 200)))
    return out


def test_coverage(spark):
    r = random.Random(1)
    pages = [(i, PAGE, random_boxes(r, i % 7)) for i in range(60)] + [(60, PAGE, [PAGE]), (61, (0.0, 0.0, 0.0, 9.0), [PAGE]), (62, PAGE, None)]
    df = spark.createDataFrame(pages, f"i int, page {RECT}, images array<{RECT}>")
    got = {x.i: x.c for x in df.select("i", layout.coverage(F.col("images"), F.col("page")).alias("c")).collect()}
    assert got == {i: 0.0 if i == 61 else brute_coverage(p, b or []) for i, p, b in pages}
    rows = df.select("i", F.col("page").alias("page_rect"), F.explode("images").alias("box"))
    assert {x.i: x.coverage for x in layout.coverage_of_boxes(rows, ["i"]).collect()} == {i: c for i, c in got.items() if c}


def brute_table(rows, s=Settings()):
    if len(rows) < 2 or max(map(len, rows)) < 2:
        return False
    filled = [n for row in rows for c in row if (n := len((c or "").strip()))]
    if not filled or sum(filled) / len(filled) > s.table_max_mean_cell or max(filled) > s.table_max_cell:
        return False
    width = max(map(len, rows))
    thin = sum(sum(bool((row[i] or "").strip()) for row in rows if i < len(row)) / len(rows) < 0.5 for i in range(width))
    return thin / width < s.table_max_thin_columns


def brute_grid(rows):
    width = max(map(len, rows))
    full = [[(c or "").replace("|", "\\|").replace("\n", " ") for c in row] + [""] * (width - len(row)) for row in rows]
    if not any((c or "").strip() for c in rows[0]):
        full = [[f"Col{i + 1}" for i in range(width)], *full]
    return "\n".join("|" + "|".join(c) + "|" for c in [full[0], ["---"] * width, *full[1:]])


def test_grids(spark):
    r = random.Random(2)
    cell = lambda: r.choice([None, "", " ", "a", "b|c", "two\nlines", "x" * 130, "y" * 601, "7"])
    tables = [[[cell() for _ in range(r.randint(1, 4))] for _ in range(r.randint(1, 5))] for _ in range(300)] + [[], [["a", "b"], ["c", "d"]], [["", ""], ["1", "2"]]]
    df = spark.createDataFrame(list(enumerate(tables)), "i int, rows array<array<string>>")
    got = {x.i: x for x in df.select("i", grids.is_table(F.col("rows")).alias("t"), F.when(F.size("rows") > 0, grids.markdown_grid(F.col("rows"))).alias("g")).collect()}
    for i, rows in enumerate(tables):
        assert got[i].t == brute_table(rows), rows
        assert got[i].g == (brute_grid(rows) if rows else None)


def brute_regions(page, boxes):
    columns, rows, filled = int((page[2] - page[0]) / 10), int((page[3] - page[1]) / 10), set()
    for b in boxes:
        filled |= {(r, c) for r in range(max(0, int((b[1] - page[1]) / 10)), min(rows - 1, int((b[3] - page[1]) / 10)) + 1) for c in range(max(0, int((b[0] - page[0]) / 10)), min(columns - 1, int((b[2] - page[0]) / 10)) + 1)}
    found = []
    while filled:
        group, work = set(), [filled.pop()]
        while work:
            r, c = work.pop()
            group.add((r, c))
            near = {(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & filled
            filled -= near
            work += near
        top, bottom, left, right = (f(x[k] for x in group) for k, f in ((0, min), (0, max), (1, min), (1, max)))
        found.append((page[0] + left * 10, page[1] + top * 10, min(page[2], page[0] + (right + 1) * 10), min(page[3], page[1] + (bottom + 1) * 10)))
    return sorted(found, key=lambda g: (g[1], g[0], g[3], g[2]))


def test_regions():
    r = random.Random(3)
    for _ in range(60):
        boxes = [(x := r.uniform(0, 580), y := r.uniform(0, 800), x + r.uniform(1, 60), y + r.uniform(1, 60)) for _ in range(r.randint(0, 14))]
        page = (0.0, 0.0, 600.0, 840.0)
        assert regions.regions_of(page, boxes) == brute_regions(page, boxes)


def test_charts():
    page, s = (0.0, 0.0, 600.0, 840.0), Settings(chart_regions=True)
    bars = [(100.0 + 30 * i, 300.0 - 5 * i, 120.0 + 30 * i, 400.0) for i in range(8)]
    labels = [((100.0 + 30 * i, 404.0, 120.0 + 30 * i, 410.0), f"{i} %") for i in range(8)]
    (chart,) = regions.charts_of(page, bars, labels, [], s)
    assert chart == (82.0, 242.0, 358.0, 428.0)
    assert regions.charts_of(page, bars, labels, [(90.0, 300.0, 200.0, 320.0)], s) == []  # over a table
    assert regions.charts_of(page, bars, [(b, "these are sentences that go on") for b, _ in labels], [], s) == []
    assert regions.charts_of(page, bars[:2], labels, [], s) == [] and regions.charts_of(page, bars, [], [], s) == []
    assert regions.charts_of(page, [(0.0, 0.0, 599.0, 839.0)] * 3, labels, [], s) == []  # nearly the whole page
    apart = [(x, y - 260, z, w - 260) for x, y, z, w in bars]
    both = regions.charts_of(page, bars + apart, labels + [((x, y - 260, z, w - 260), t) for (x, y, z, w), t in labels], [], s)
    assert len(both) == 2
    close = [(x, y - 180, z, w - 180) for x, y, z, w in bars]
    assert len(regions.charts_of(page, bars + close, labels + [((x, y - 180, z, w - 180), t) for (x, y, z, w), t in labels], [], s)) == 1  # margins meet


def test_chart_regions_on_tables(spark):
    box = dict(zip(("x0", "y0", "x1", "y1"), (100.0, 100.0, 300.0, 300.0), strict=True))
    page = dict(zip(("x0", "y0", "x1", "y1"), (0.0, 0.0, 600.0, 840.0), strict=True))
    schema = f"doc string, page_no int, page_rect {RECT}, boxes array<{RECT}>, blocks array<struct<x0:double,y0:double,x1:double,y1:double,text:string>>, tables array<{RECT}>"
    df = spark.createDataFrame([("d", 1, page, [box] * 3, [box | {"text": "5 %"}], []), ("d", 2, page, None, None, None)], schema)
    got = {r.page_no: len(r.figures) for r in regions.chart_regions(df, Settings(chart_regions=True)).collect()}
    assert got == {1: 1, 2: 0}


@pytest.mark.parametrize(("options", "want"), [
    ({}, "caption words in a full sentence\n\n[figure: p003_f1.png]\n\n\n|k|v|\n|---|---|\n|1|2|\n\nend\n\n[figure: p003_f2.png]\n"),
])
def test_assembled(spark, options, want):
    at = lambda x, y, w=10.0: {"x0": x, "y0": y, "x1": x + w, "y1": y + w}
    blocks = [at(5.0, 5.0) | {"text": "caption words in a full sentence"}, at(20.0, 20.0) | {"text": "3 %"}, at(30.0, 30.0) | {"text": "4 %"}, at(205.0, 5.0) | {"text": "1 2"}, at(205.0, 25.0) | {"text": "more"}, at(1.0, 500.0) | {"text": " "}, at(1.0, 600.0) | {"text": "end"}]
    tables = [at(200.0, 0.0, 100.0) | {"rows": [["k", "v"], ["1", "2"]]}, at(400.0, 0.0, 50.0) | {"rows": [["box"]]}]
    rect = "struct<x0:double,y0:double,x1:double,y1:double>"
    schema = f"doc string, page_no int, page_count int, text string, blocks array<struct<x0:double,y0:double,x1:double,y1:double,text:string>>, tables array<struct<x0:double,y0:double,x1:double,y1:double,rows:array<array<string>>>>, figures array<{rect}>"
    df = spark.createDataFrame([("d", 3, 9, "as it was", blocks, tables, [at(0.0, 0.0, 100.0), at(0.0, 300.0, 100.0)]), ("d", 4, 9, "as it was", blocks, tables[1:], []), ("d", 5, 9, "t", None, [], [])], schema)
    got = {r.page_no: r for r in assembly.assembled(df, Settings(extract_tables=True)).collect()}
    assert got[3].text == want and (got[3].tables_kept, got[3].tables_rejected) == (1, 1)
    assert got[4].text == "as it was" and got[5].text == "t"
