"""Queries over page geometry, grids and office blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import assembly, grids, layout, regions
from ..settings import Settings
from . import inputs as I

ALL: dict = {}


def query(sql: str | None = None):
    def keep(f):
        ALL[f.__name__] = (f, sql)
        return f

    return keep


_CELLS = f"""
  b AS ({I.BOXES}),
  k AS (SELECT page_id, least(31, greatest(0, CAST(trunc(x0 / 600 * 32) AS INTEGER))) AS c0, least(31, greatest(0, CAST(trunc(x1 / 600 * 32) AS INTEGER))) AS c1,
               least(31, greatest(0, CAST(trunc(y0 / 840 * 32) AS INTEGER))) AS r0, least(31, greatest(0, CAST(trunc(y1 / 840 * 32) AS INTEGER))) AS r1
        FROM b WHERE x1 > x0 AND y1 > y0 AND (x1 - x0) * (y1 - y0) / 504000.0::DOUBLE >= 0.004::DOUBLE),
  v AS (SELECT page_id, count(DISTINCT r * 32 + c) / 1024.0::DOUBLE AS coverage FROM k, unnest(range(r0, r1 + 1)) AS x(r), unnest(range(c0, c1 + 1)) AS y(c) GROUP BY page_id)"""


@query(f"WITH {_CELLS} SELECT page_id, coverage FROM v")
def raster_coverage(spark, sf_dir):
    return layout.coverage_of_boxes(I.boxes(spark, sf_dir), ["page_id"])


def _pages(spark, sf_dir):
    """Boxes as arrays, with made-up counts of characters and paths."""
    pages = I.boxes(spark, sf_dir).groupBy("page_id").agg(F.collect_list("box").alias("images"), F.first("page_rect").alias("page_rect"), F.count(F.lit(1)).alias("n"))
    return pages.withColumn("coverage", layout.coverage(F.col("images"), F.col("page_rect"))).withColumn("chars", F.col("page_id") % 900).withColumn("paths", F.col("page_id") % 110)


_FACTS = f"WITH {_CELLS}, p AS (SELECT DISTINCT b.page_id, coalesce(coverage, 0.0::DOUBLE) AS coverage, b.page_id % 900 AS chars, b.page_id % 110 AS paths FROM b LEFT JOIN v ON b.page_id = v.page_id)"


@query(f"{_FACTS} SELECT page_id, coverage >= 0.2::DOUBLE AS whole, coverage < 0.2::DOUBLE AND chars <= 400 AND paths >= 60 AS vector, FALSE AS text_only FROM p")
def visual_pages(spark, sf_dir):
    s = Settings(image_threshold=0.2)
    p = _pages(spark, sf_dir).withColumn("whole", layout.is_whole_page(F.col("coverage"), s))
    return p.select("page_id", "whole", (~F.col("whole") & layout.is_vector_heavy(F.col("chars"), F.col("paths"), s)).alias("vector"), layout.is_whole_page(F.col("coverage"), Settings.of_request(100)).alias("text_only"))


@query(f"{_FACTS} SELECT page_id, chars % 50 <= 24 AND coverage >= 0.8::DOUBLE AS scanned FROM p")
def scanned_pages(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", layout.is_scanned(F.col("chars") % 50, F.col("coverage")).alias("scanned"))


def _drawings(spark, sf_dir):
    ops = F.array(*map(F.lit, ("l", "re", "c", "qu")))
    some = F.slice(ops, (F.col("l_linenumber") % 4 + 1).cast("int"), (F.col("l_partkey") % 3).cast("int"))
    li = I.table(spark, sf_dir, "lineitem").withColumn("d", F.struct(some.alias("ops")))
    return li.groupBy(F.col("l_orderkey").alias("page_id")).agg(F.collect_list("d").alias("drawings"))


@query("""WITH d AS (SELECT l_orderkey AS page_id, list_slice(['l', 're', 'c', 'qu'], l_linenumber % 4 + 1, l_linenumber % 4 + l_partkey % 3) AS ops FROM lineitem),
 n AS (SELECT page_id, CAST(sum(len(list_filter(ops, lambda o: o IN ('l', 're')))) AS INTEGER) AS lines FROM d GROUP BY page_id)
 SELECT page_id, lines, lines >= 4 AS wants_tables FROM n""")
def line_like_count(spark, sf_dir):
    tables, _ = layout.wants(F.col("drawings"), F.array(), Settings(extract_tables=True))
    return _drawings(spark, sf_dir).select("page_id", layout.line_like(F.col("drawings")).alias("lines"), tables.alias("wants_tables"))


@query(f"""SELECT page_id, count(*) FILTER (WHERE x0 < x1 AND y0 < y1) AS n, coalesce(sum((x1 - x0) * (y1 - y0)) FILTER (WHERE x0 < x1 AND y0 < y1), 0.0::DOUBLE) AS area
 FROM (SELECT page_id, greatest(x0, 100) AS x0, greatest(y0, 100) AS y0, least(x1, 400) AS x1, least(y1, 500) AS y1 FROM ({I.BOXES})) GROUP BY page_id""")
def clipped_boxes(spark, sf_dir):
    page = G.rect(F.lit(100), F.lit(100), F.lit(400), F.lit(500))
    b = I.boxes(spark, sf_dir).groupBy("page_id").agg(layout.drawing_boxes(F.collect_list("box"), page).alias("boxes"))
    return b.select("page_id", F.size("boxes").cast("long").alias("n"), F.aggregate("boxes", F.lit(0.0), lambda a, x: a + G.area(x)).alias("area"))


@query(f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY x0, y0, x1, y1) AS i FROM ({I.BOXES})),
 p AS (SELECT a.page_id, a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1 AS meets, b.x0 <= (a.x0 + a.x1) / 2 AND (a.x0 + a.x1) / 2 < b.x1 AND b.y0 <= (a.y0 + a.y1) / 2 AND (a.y0 + a.y1) / 2 < b.y1 AS holds
       FROM n a JOIN n b ON a.page_id = b.page_id AND a.i < b.i)
 SELECT page_id, count(*) FILTER (meets) AS meets, count(*) FILTER (holds) AS holds FROM p GROUP BY page_id""")
def overlapping_boxes(spark, sf_dir):
    b = I.boxes(spark, sf_dir).groupBy("page_id").agg(F.array_sort(F.collect_list("box")).alias("boxes"))
    one = b.select("page_id", "boxes", F.posexplode("boxes").alias("i", "a"))
    pairs = one.select("page_id", "a", F.explode(F.slice("boxes", F.col("i") + 2, F.size("boxes"))).alias("b"))
    return pairs.groupBy("page_id").agg(F.count_if(G.intersects(F.col("a"), F.col("b"))).alias("meets"), F.count_if(G.contains_point(F.col("b"), G.centre_x(F.col("a")), G.centre_y(F.col("a")))).alias("holds"))


@query(f"""WITH RECURSIVE b AS ({I.SMALL_BOXES}),
 k AS (SELECT DISTINCT page_id, r, c FROM b, unnest(range(y0 // 10, least(27, y1 // 10) + 1)) AS x(r), unnest(range(x0 // 10, least(23, x1 // 10) + 1)) AS y(c)),
 reach AS (SELECT page_id, r, c, r AS r2, c AS c2 FROM k UNION SELECT t.page_id, t.r, t.c, k.r, k.c FROM reach t JOIN k ON k.page_id = t.page_id AND abs(k.r - t.r2) <= 1 AND abs(k.c - t.c2) <= 1),
 g AS (SELECT page_id, r, c, min(r2 * 100 + c2) AS id FROM reach GROUP BY page_id, r, c),
 f AS (SELECT page_id, id, min(c) * 10.0::DOUBLE AS x0, min(r) * 10.0::DOUBLE AS y0, least(240, (max(c) + 1) * 10)::DOUBLE AS x1, least(280, (max(r) + 1) * 10)::DOUBLE AS y1 FROM g GROUP BY page_id, id)
 SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY y0, x0, y1, x1) - 1 AS INTEGER) AS region, x0, y0, x1, y1 FROM f""")
def drawn_regions(spark, sf_dir):
    return regions.drawn_regions(I.small_boxes(spark, sf_dir), ("page_id",))


@query()
def chart_regions(spark, sf_dir):
    """Charts depend on the order of merging; tests compare them with the definition. One row per page."""
    label = F.transform("boxes", lambda b: F.struct(b.x0.alias("x0"), b.y0.alias("y0"), b.x1.alias("x1"), b.y1.alias("y1"), F.lit("12 %").alias("text")))
    p = I.small_boxes(spark, sf_dir).withColumn("blocks", label).withColumn("tables", F.slice("boxes", 1, 1))
    return regions.chart_regions(p, Settings(chart_regions=True, chart_min_paths=1), ("page_id",)).select("page_id", F.size("figures").alias("charts"))


_GRIDS = f"""g AS ({I.GRID_ROWS}), c AS (SELECT grid_id, row_no, i, trim(coalesce([c1, c2, c3][i], '')) AS cell FROM g, unnest(range(1, 4)) AS u(i)),
 m AS (SELECT grid_id, max(row_no) AS n, avg(length(cell)) FILTER (cell <> '') AS mean, max(length(cell)) AS longest FROM c GROUP BY grid_id),
 t AS (SELECT grid_id, count(*) FILTER (share < 0.5) AS thin FROM (SELECT grid_id, i, avg(CASE WHEN cell <> '' THEN 1.0 ELSE 0.0 END) AS share FROM c GROUP BY grid_id, i) GROUP BY grid_id)"""


@query(f"WITH {_GRIDS} SELECT m.grid_id, CAST(thin AS INTEGER) AS thin, n >= 2 AND mean IS NOT NULL AND mean <= 120 AND longest <= 600 AND thin / 3.0 < 0.5 AS is_table FROM m JOIN t ON m.grid_id = t.grid_id")
def table_gate(spark, sf_dir):
    return I.grid_rows(spark, sf_dir).select("grid_id", grids.thin_columns(F.col("rows")).alias("thin"), grids.is_table(F.col("rows")).alias("is_table"))


_ROW = "concat('|', replace(replace(coalesce(c1, ''), '|', chr(92) || '|'), chr(10), ' '), '|', replace(coalesce(c2, ''), '|', chr(92) || '|'), '|', replace(coalesce(c3, ''), '|', chr(92) || '|'), '|')"


@query(f"SELECT grid_id, md5(concat(any_value({_ROW}) FILTER (row_no = 1), chr(10), '|---|---|---|', coalesce(chr(10) || string_agg({_ROW}, chr(10) ORDER BY row_no) FILTER (row_no > 1), ''))) AS grid FROM ({I.GRID_ROWS}) GROUP BY grid_id")
def markdown_grid(spark, sf_dir):
    return I.grid_rows(spark, sf_dir).select("grid_id", F.md5(grids.markdown_grid(F.col("rows")).cast("binary")).alias("grid"))


@query("""SELECT n_regionkey AS grid_id, concat('|Col1|Col2|', chr(10), '|---|---|', chr(10), '| ||', chr(10), string_agg(concat('|', n_name, '|', n_nationkey, '|'), chr(10) ORDER BY n_nationkey)) AS grid FROM nation GROUP BY n_regionkey""")
def markdown_grid_blank_head(spark, sf_dir):
    n = I.table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("grid_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.array(x.n_name, x.n_nationkey.cast("string"))).alias("rows"))
    return n.select("grid_id", grids.markdown_grid(F.concat(F.array(F.array(F.lit(" "))), F.col("rows"))).alias("grid"))


_NATIONS = "(SELECT concat(any_value(head), chr(10), '|---|---|', chr(10), string_agg(line, chr(10) ORDER BY k) FILTER (k > 0)) FROM (SELECT n_nationkey AS k, concat('|', n_nationkey, '|', n_name, '|') AS line, (SELECT concat('|', n_nationkey, '|', n_name, '|') FROM nation WHERE n_nationkey = 0) AS head FROM nation))"
_BLOCKS = rf"""
 d AS (SELECT * FROM documents),
 l AS (SELECT doc_id, i - 1 AS block_no, string_split(text, chr(10))[i] AS text FROM d, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)),
 k AS (SELECT doc_id AS doc, block_no, CASE WHEN block_no = 0 THEN 'heading' WHEN block_no % 4 = 0 THEN 'list' ELSE 'body' END AS kind, text, 1 + doc_id % 6 AS level FROM l
       UNION ALL SELECT doc_id, 1073741824, 'table', NULL, 0 FROM d WHERE doc_id % 3 = 0),
 p AS (SELECT doc, block_no, CASE kind WHEN 'heading' THEN concat(repeat('#', level), ' ', text) WHEN 'list' THEN concat('- ', text) WHEN 'table' THEN {_NATIONS} ELSE text END AS part FROM k)"""


@query(rf"WITH {_BLOCKS} SELECT doc, md5(string_agg(part, chr(10) || chr(10) ORDER BY block_no)) AS markdown FROM p WHERE {I.sql_strip('part')} <> '' GROUP BY doc")
def blocks_markdown(spark, sf_dir):
    return grids.blocks_markdown(I.office_blocks(spark, sf_dir)).select("doc", F.md5(F.col("markdown").cast("binary")).alias("markdown"))


@query(f"WITH {_BLOCKS} SELECT doc, kind, count(*) AS n FROM k GROUP BY doc, kind")
def block_kind_counts(spark, sf_dir):
    return grids.kind_counts(I.office_blocks(spark, sf_dir))


def _assembly_pages(spark, sf_dir):
    """Blocks, tables and figures on pages of 600 by 840, from line items in a fixed order."""
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    li = I.table(spark, sf_dir, "lineitem")
    x0, y0 = (p * 37) % 500, (s * 53) % 700
    block = F.struct(x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), (x0 + 40).cast("double").alias("x1"), (y0 + 20).cast("double").alias("y1"), F.when(p % 4 == 0, F.concat(F.lit("a longer line of words "), p)).otherwise(F.concat(F.lit("w"), p)).alias("text"))
    area = G.rect(x0 - 60, y0 - 60, x0 + 120, y0 + 120)
    cells = F.array(F.array(F.lit("k"), F.lit("v")), F.array(p.cast("string"), F.when(s % 3 != 0, s.cast("string"))))
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", block.alias("block"), area.alias("area"), cells.alias("cells"))
    d = li.groupBy(F.col("l_orderkey").alias("page_no")).agg(F.array_sort(F.collect_list(row)).alias("r"))
    table = lambda x: F.struct(x.area.x0.alias("x0"), x.area.y0.alias("y0"), x.area.x1.alias("x1"), x.area.y1.alias("y1"), x.cells.alias("rows"))
    return d.select(
        F.lit("d").alias("doc"), "page_no", F.lit(99_999).alias("page_count"), F.lit("plain").alias("text"), F.transform("r", lambda x: x.block).alias("blocks"),
        F.transform(F.filter("r", lambda x: x.l_linenumber % 3 == 1), table).alias("tables"), F.transform(F.filter("r", lambda x: x.l_linenumber % 3 == 2), lambda x: x.area).alias("figures"),
    )


@query("""WITH li AS (SELECT l_orderkey AS page, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS b,
   ((l_partkey * 37) % 500)::DOUBLE AS x, ((l_suppkey * 53) % 700)::DOUBLE AS y FROM lineitem),
 bl AS (SELECT page, b, x + 20 AS cx, y + 10 AS cy, CASE WHEN p % 4 = 0 THEN concat('a longer line of words ', p) ELSE concat('w', p) END AS text, p % 4 = 0 AS sentences FROM li),
 tb AS (SELECT page, row_number() OVER (PARTITION BY page ORDER BY b) - 1 AS t, x, y, concat(chr(10), '|k|v|', chr(10), '|---|---|', chr(10), '|', p, '|', CASE WHEN s % 3 <> 0 THEN CAST(s AS VARCHAR) ELSE '' END, '|', chr(10)) AS grid FROM li WHERE n % 3 = 1),
 fg AS (SELECT page, row_number() OVER (PARTITION BY page ORDER BY b) - 1 AS f, x, y FROM li WHERE n % 3 = 2),
 h AS (SELECT page, b, text, sentences, (SELECT min(f) FROM fg WHERE fg.page = bl.page AND cx >= fg.x - 60 AND cx < fg.x + 120 AND cy >= fg.y - 60 AND cy < fg.y + 120) AS f,
   (SELECT min(t) FROM tb WHERE tb.page = bl.page AND cx >= tb.x - 60 AND cx < tb.x + 120 AND cy >= tb.y - 60 AND cy < tb.y + 120) AS t FROM bl),
 a AS (SELECT *, CASE WHEN f IS NOT NULL THEN sentences ELSE t IS NULL END AS stays, CASE WHEN f IS NULL THEN t END AS g FROM h),
 shown AS (SELECT page, f, min(b) AS b FROM a WHERE f IS NOT NULL AND NOT stays GROUP BY page, f),
 placed AS (SELECT page, g AS t, min(b) AS b FROM a WHERE g IS NOT NULL GROUP BY page, g),
 parts AS (SELECT page, 0 AS k, b AS o, text AS part FROM a WHERE stays
   UNION ALL SELECT fg.page, CASE WHEN s.b IS NULL THEN 2 ELSE 0 END, coalesce(s.b, fg.f), concat(chr(10), '[figure: p', lpad(CAST(fg.page AS VARCHAR), 5, '0'), '_f', fg.f + 1, '.png]', chr(10)) FROM fg LEFT JOIN shown s ON s.page = fg.page AND s.f = fg.f
   UNION ALL SELECT tb.page, CASE WHEN pl.b IS NULL THEN 1 ELSE 0 END, coalesce(pl.b, tb.t), grid FROM tb LEFT JOIN placed pl ON pl.page = tb.page AND pl.t = tb.t),
 w AS (SELECT page, string_agg(part, chr(10) ORDER BY k, o) AS text FROM parts GROUP BY page)
 SELECT w.page AS page_no, CASE WHEN w.page IN (SELECT page FROM tb UNION SELECT page FROM fg) THEN w.text ELSE 'plain' END AS text, CAST((SELECT count(*) FROM tb WHERE tb.page = w.page) AS INTEGER) AS tables_kept FROM w""")
def assemble_page(spark, sf_dir):
    return assembly.assembled(_assembly_pages(spark, sf_dir), Settings(extract_tables=True, table_max_thin_columns=2.0)).select("page_no", "text", "tables_kept")


@query("""SELECT page_no, name, 144 AS dpi, x0 FROM (
 SELECT l_orderkey AS page_no, concat('p', lpad(CAST(l_orderkey AS VARCHAR), 5, '0'), '.png') AS name, NULL::DOUBLE AS x0 FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY l_orderkey
 UNION ALL SELECT l_orderkey, concat('p', lpad(CAST(l_orderkey AS VARCHAR), 5, '0'), '_f', row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey), '.png'), ((l_partkey * 37) % 500 - 60)::DOUBLE FROM lineitem WHERE l_orderkey % 3 <> 0 AND l_linenumber % 3 = 2)""")
def render_plan(spark, sf_dir):
    return layout.render_plan(_assembly_pages(spark, sf_dir).withColumn("visual", F.col("page_no") % 3 == 0)).select("page_no", "name", "dpi", F.col("clip.x0").alias("x0"))
