"""Inputs of the named queries, derived from the test tables alike in Spark and in SQL.

A document is a source of documents, or a conversation; its pages are its rows in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..settings import Settings

NATURAL = Settings(repeat_ratio=0.06)
#: Ids of a slice, within which the pages of a document are numbered by one task.
SLICE = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are numbered by slices of SLICE ids, so that a source with a large part of all rows is spread over tasks:
    the slices of a source are counted and summed up, and rows are numbered within their slice only."""
    d = table(spark, sf_dir, "documents").withColumn("_slice", F.floor(F.col("doc_id") / SLICE))
    of = Window.partitionBy("source")
    counts = d.groupBy("source", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(of.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slices = counts.select(F.col("source").alias("_source"), F.col("_slice").alias("_of"), before.alias("_before"), F.sum("_n").over(of).alias("page_count"))
    numbered = d.withColumn("_at", F.row_number().over(Window.partitionBy("source", "_slice").orderBy("doc_id")))
    same = F.col("source").eqNullSafe(F.col("_source")) & F.col("_slice").eqNullSafe(F.col("_of"))
    return numbered.join(slices, same).select(F.col("source").alias("doc"), (F.col("_before") + F.col("_at")).cast("int").alias("page_no"), "page_count", F.col("text").alias("raw"))


def furnished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a running header, a lone year, and a footer with the page's number."""
    raw = F.concat(F.lit("Regional Monitor "), F.col("doc"), F.lit("\n"), F.col("raw"), F.lit("\n2024\nPage "), F.col("page_no"), F.lit(" of "), F.col("page_count"))
    return paged(spark, sf_dir).withColumn("raw", raw)


def doubled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Furnished, with the header a second time on some pages of documents with an odd digit at the end."""
    again = F.when((F.col("page_no") % 7 == 0) & (F.substring("doc", -1, 1).isin("1", "3", "5", "7", "9")), F.concat(F.lit("\nRegional Monitor "), F.col("doc"))).otherwise("")
    return furnished(spark, sf_dir).withColumn("raw", F.concat("raw", again))


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With typographic quotes, dashes, hyphen breaks, runs of spaces and line ends, tabs, and carriage returns."""
    r = F.col("raw")
    for old, new in DIRT:
        r = F.replace(r, F.lit(old), F.lit(new))
    return paged(spark, sf_dir).withColumn("raw", F.concat(F.lit("“"), r, F.lit("”…  ")))


DIRT = [(". ", ".  \t \n\n\n\n"), ("tion ", "tion-\n"), (", ", " — "), ("the\n", "the\r\n")]
NUMBERS = ["7", "page 7", "7 of 90", "7/90", "2024", "- 7 -", "12345", "p. 7"]


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate page number as the last line of each page."""
    line = F.element_at(F.array(*map(F.lit, NUMBERS)), (F.col("page_no") % 8 + 1).cast("int"))
    return paged(spark, sf_dir).withColumn("raw", F.concat("raw", F.lit("\n"), line)).withColumn("line", line)


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short documents: a conversation's turns as pages, each with the same first line."""
    c = table(spark, sf_dir, "conversations")
    n = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))  # joined again, not a window: the turns of a very long talk need not meet in a task
    return c.join(n, c.conv_id.eqNullSafe(n.conv_id)).drop(n.conv_id).select(F.concat(F.lit("conv"), F.col("conv_id")).alias("doc"), (F.col("turn") + 1).cast("int").alias("page_no"), F.col("n").alias("page_count"), F.concat(F.lit("Transcript of a talk\n"), "text").alias("raw"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, box, page_rect): boxes on pages of 600 by 840; some pages are full."""
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    x0, y0 = (p * 37) % 500, (s * 53) % 700
    x1, y1 = F.least(F.lit(600), x0 + 5 + (p * 13 + n * 71) % 300), F.least(F.lit(840), y0 + 5 + (s * 29 + n * 97) % 300)
    some = table(spark, sf_dir, "lineitem")
    full = some.where("l_orderkey % 100 = 0").select(F.col("l_orderkey").alias("page_id")).distinct()
    page = G.rect(F.lit(0), F.lit(0), F.lit(600), F.lit(840))
    return some.select(F.col("l_orderkey").alias("page_id"), G.rect(x0, y0, x1, y1).alias("box")).unionByName(full.withColumn("box", page)).withColumn("page_rect", page)


def small_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, page_rect, boxes): pages with drawings of 5 to 44 points."""
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    x0, y0 = (p * 37) % 200, (s * 53) % 240
    box = G.rect(x0, y0, x0 + 5 + (p * 13 + n * 71) % 40, y0 + 5 + (s * 29 + n * 97) % 40)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), box.alias("box"))
    return rows.groupBy("page_id").agg(F.collect_list("box").alias("boxes")).withColumn("page_rect", G.rect(F.lit(0), F.lit(0), F.lit(240), F.lit(280)))


def grid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grid_id, rows): grids of three columns with blank and missing cells, some with a long cell."""
    li = table(spark, sf_dir, "lineitem")
    c1 = F.when((F.col("l_linenumber") + F.col("l_partkey")) % 3 == 0, "").otherwise(F.col("l_returnflag"))
    c2 = F.when(F.col("l_suppkey") % 2 != 0, F.col("l_partkey").cast("string"))
    c3 = F.when(F.col("l_orderkey") % 140 == 0, F.repeat(F.lit("x|y "), F.col("l_linenumber") * 40)).otherwise(F.col("l_suppkey").cast("string"))
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.array(c1, c2, c3).alias("cells"))
    return li.groupBy(F.col("l_orderkey").alias("grid_id")).agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r.cells).alias("rows"))


def office_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, block_no, kind, text, level, rows): a document's lines as heading, list items and body, the nations as a table at its end."""
    d = table(spark, sf_dir, "documents")
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_no", "text"))
    kind = F.when(F.col("block_no") == 0, "heading").when(F.col("block_no") % 4 == 0, "list").otherwise("body")
    none = F.lit(None).cast("array<array<string>>")
    text = lines.select(F.col("doc_id").alias("doc"), "block_no", kind.alias("kind"), "text", (1 + F.col("doc_id") % 6).cast("int").alias("level"), none.alias("rows"))
    n = table(spark, sf_dir, "nation").groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.array(x.n_nationkey.cast("string"), x.n_name)).alias("rows"))
    grid = d.where("doc_id % 3 = 0").select("doc_id").crossJoin(F.broadcast(n)).select(F.col("doc_id").alias("doc"), F.lit(1 << 30).alias("block_no"), F.lit("table").alias("kind"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("level"), "rows")
    return text.unionByName(grid)


SUFFIXES = [".pdf", ".docx", ".odt", ".txt", ".md", ".PNG", ".doc", ".html", ".epub", ".JPEG"]


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, name, size): names that cycle through suffixes, known and not; some come twice."""
    d = table(spark, sf_dir, "documents")
    ending = F.element_at(F.array(*map(F.lit, SUFFIXES)), (F.col("doc_id") % 10 + 1).cast("int"))
    return d.select(F.col("doc_id").alias("seq"), F.concat(F.lit("file"), F.floor(F.col("doc_id") / 7) % 40, ending).alias("name"), (F.col("n_chars") % 3).alias("size"))


def supplied(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("page_no") % 10 == 0, "  ").otherwise(F.replace("raw", F.lit("e"), F.lit("E")))
    return furnished(spark, sf_dir).where("page_no % 5 = 0").select("doc", "page_no", text.alias("text"))


def facts(pages: DataFrame) -> DataFrame:
    """Page facts that the layout would give, by the page's number."""
    n = F.col("page_no")
    return pages.withColumns({"visual": n % 4 == 0, "scanned": n % 9 == 0, "ocr": n % 18 == 0, "tables": (n % 3).cast("int"), "tables_rejected": (n % 2).cast("int"), "figures_saved": F.when(n % 4 != 0, n % 2).otherwise(0).cast("int")})


# The same in SQL.

PAGED = "SELECT source AS doc, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS page_no, count(*) OVER (PARTITION BY source) AS page_count, text AS raw FROM documents"
FURNISHED = f"SELECT doc, page_no, page_count, concat('Regional Monitor ', doc, chr(10), raw, chr(10), '2024', chr(10), 'Page ', page_no, ' of ', page_count) AS raw FROM ({PAGED})"
DOUBLED = f"SELECT doc, page_no, page_count, concat(raw, CASE WHEN page_no % 7 = 0 AND right(doc, 1) IN ('1', '3', '5', '7', '9') THEN concat(chr(10), 'Regional Monitor ', doc) ELSE '' END) AS raw FROM ({FURNISHED})"
_r = "raw"
for _old, _new in DIRT:
    _r = f"replace({_r}, '{_old}', '{_new}')"
DIRTY = f"SELECT doc, page_no, page_count, concat('“', {_r}, '”…  ') AS raw FROM ({PAGED})"
_pick = "CASE page_no % 8 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(NUMBERS)) + " END"
NUMBERED = f"SELECT doc, page_no, page_count, concat(raw, chr(10), {_pick}) AS raw, {_pick} AS line FROM ({PAGED})"
CONVERSATIONS = "SELECT concat('conv', conv_id) AS doc, CAST(turn + 1 AS INTEGER) AS page_no, count(*) OVER (PARTITION BY conv_id) AS page_count, concat('Transcript of a talk', chr(10), text) AS raw FROM conversations"
BOXES = """SELECT l_orderkey AS page_id, CAST((l_partkey * 37) % 500 AS DOUBLE) AS x0, CAST((l_suppkey * 53) % 700 AS DOUBLE) AS y0,
 CAST(least(600, (l_partkey * 37) % 500 + 5 + (l_partkey * 13 + l_linenumber * 71) % 300) AS DOUBLE) AS x1,
 CAST(least(840, (l_suppkey * 53) % 700 + 5 + (l_suppkey * 29 + l_linenumber * 97) % 300) AS DOUBLE) AS y1 FROM lineitem
 UNION ALL SELECT DISTINCT l_orderkey, 0.0::DOUBLE, 0.0::DOUBLE, 600.0::DOUBLE, 840.0::DOUBLE FROM lineitem WHERE l_orderkey % 100 = 0"""
SMALL_BOXES = """SELECT l_orderkey AS page_id, (l_partkey * 37) % 200 AS x0, (l_suppkey * 53) % 240 AS y0,
 (l_partkey * 37) % 200 + 5 + (l_partkey * 13 + l_linenumber * 71) % 40 AS x1, (l_suppkey * 53) % 240 + 5 + (l_suppkey * 29 + l_linenumber * 97) % 40 AS y1
 FROM lineitem"""
GRID_ROWS = """SELECT l_orderkey AS grid_id, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS row_no,
 CASE WHEN (l_linenumber + l_partkey) % 3 = 0 THEN '' ELSE l_returnflag END AS c1, CASE WHEN l_suppkey % 2 = 0 THEN NULL ELSE CAST(l_partkey AS VARCHAR) END AS c2,
 CASE WHEN l_orderkey % 140 = 0 THEN repeat('x|y ', l_linenumber * 40) ELSE CAST(l_suppkey AS VARCHAR) END AS c3 FROM lineitem"""
_ending = "CASE doc_id % 10 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(SUFFIXES)) + " END"
FILES = f"SELECT doc_id AS seq, concat('file', (doc_id // 7) % 40, {_ending}) AS name, n_chars % 3 AS size FROM documents"
SUPPLIED = f"SELECT doc, page_no, CASE WHEN page_no % 10 = 0 THEN '  ' ELSE replace(raw, 'e', 'E') END AS text FROM ({FURNISHED}) WHERE page_no % 5 = 0"


def sql_newlines(x: str) -> str:
    return rf"regexp_replace({x}, '\r\n?', chr(10), 'g')"


def sql_punctuation(x: str) -> str:
    return f"replace(translate({x}, '“”— ', '\"\"- '), '…', '...')"


def sql_dehyphenate(x: str) -> str:
    return rf"regexp_replace({x}, '([A-Za-zÀ-ÖØ-öø-ÿ])-\n([a-zà-öø-ÿ])', '\1\2', 'g')"


def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+\z', '', 'g')"


def sql_whitespace(x: str) -> str:
    x = rf"regexp_replace({x}, '(?m)[ \t]+$', '', 'g')"
    return sql_strip(rf"regexp_replace(regexp_replace({x}, '[ \t]{{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


def sql_clean(x: str) -> str:
    return sql_whitespace(sql_dehyphenate(sql_punctuation(sql_newlines(x))))


def sql_key(x: str) -> str:
    return rf"regexp_replace({x}, '\d+', '#', 'g')"


PAGE_NUMBER = r"(?i)^\s*(?:page\s+)?\d{1,4}(?:\s*[/|of]{1,2}\s*\d{1,4})?\s*$"


def sql_lines(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, chr(10)), lambda x: {sql_strip('x')}), lambda x: x <> '')"


def sql_tokens(x: str) -> str:
    return f"CAST(round_even({x} / 4.0, 0) AS BIGINT)"


def sql_cleaned(pages: str) -> str:
    return f"SELECT doc, page_no, page_count, raw, {sql_clean('raw')} AS text FROM ({pages})"


def sql_boilerplate(pages: str, ratio: float = 0.5) -> str:
    """(doc, key), from pages (doc, page_no, text): each line in a row, as far from the expression form as it goes."""
    return rf"""
    (WITH p AS ({pages}), l AS (SELECT doc, page_no, {sql_lines('text')} AS a FROM p),
     e AS (SELECT doc, page_no, {sql_key('a[i]')} AS key, i <= 3 OR i > len(a) - 3 AS edge FROM l, unnest(range(1, len(a) + 1)) AS u(i)),
     c AS (SELECT doc, page_no, key, count(*) AS n, max(edge) AS edge FROM e GROUP BY ALL),
     s AS (SELECT doc, count(*) AS pages FROM p GROUP BY doc)
     SELECT c.doc, key FROM c JOIN s ON c.doc = s.doc
     WHERE length(key) BETWEEN 2 AND 100 AND length(regexp_replace(key, '[^\p{{L}}]', '', 'g')) >= 3 AND pages >= 4
     GROUP BY c.doc, key, pages HAVING max(n) = 1 AND count(*) FILTER (edge) >= greatest(3, CAST(floor(pages * {ratio}::DOUBLE) AS BIGINT)))"""


def sql_stripped(pages: str, keys: str) -> str:
    """pages with text rid of keys and page numbers."""
    gone = f"list_contains(coalesce(k.keys, []), {sql_key(sql_strip('x'))}) OR regexp_matches({sql_strip('x')}, '{PAGE_NUMBER}')"
    kept = f"array_to_string(list_filter(string_split(text, chr(10)), lambda x: {sql_strip('x')} = '' OR NOT ({gone})), chr(10))"
    joined = rf"regexp_replace({kept}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"(SELECT p.doc, page_no, page_count, raw, {sql_strip(joined)} AS text FROM ({pages}) p LEFT JOIN (SELECT doc, list(key) AS keys FROM {keys} GROUP BY doc) k ON p.doc = k.doc)"


def sql_reduced(pages: str) -> str:
    return sql_stripped(sql_cleaned(pages), sql_boilerplate(sql_cleaned(pages)))


def layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page layouts: every ninth page is a scan, every fourth has a picture of a good part of the page; every 25th failed."""
    page, part = G.rect(F.lit(0), F.lit(0), F.lit(600), F.lit(840)), G.rect(F.lit(30), F.lit(30), F.lit(400), F.lit(400))
    n = F.col("page_no")
    images = F.when(n % 9 == 0, F.array(page)).when(n % 4 == 0, F.array(part)).otherwise(F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>"))
    empty = lambda kind: F.array().cast(kind)
    rect = "x0:double,y0:double,x1:double,y1:double"
    return furnished(spark, sf_dir).select(
        F.col("doc").alias("doc_id"), n.cast("int").alias("page_no"), page.alias("page_rect"), F.when(n % 9 == 0, "fig 1").otherwise(F.col("raw")).alias("text"), empty(f"array<struct<{rect},text:string>>").alias("blocks"), images.alias("images"),
        empty(f"array<struct<{rect},ops:array<string>>>").alias("drawings"), empty(f"array<struct<{rect},rows:array<array<string>>>>").alias("tables"), F.when(n % 25 == 0, "damaged").alias("error"),
    )


LAYOUTS = f"""SELECT doc, page_no, page_count, CASE WHEN page_no % 25 = 0 THEN '' WHEN page_no % 18 = 0 THEN 'Recognised words of this page' WHEN page_no % 9 = 0 THEN 'fig 1' ELSE raw END AS raw,
 (page_no % 9 = 0 OR page_no % 4 = 0) AND page_no % 25 <> 0 AS visual, page_no % 9 = 0 AND page_no % 25 <> 0 AS scanned, page_no % 18 = 0 AND page_no % 25 <> 0 AS ocr FROM ({FURNISHED})"""
