"""Page text with grids and figures in the place of the blocks they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..settings import DEFAULT, Settings
from . import grids


def first_holding(areas: Column, block: Column) -> Column:
    """Index (from 0) of the first area that holds the block's centre, else -1."""
    x, y = G.centre_x(block), G.centre_y(block)
    return F.coalesce(F.array_position(F.transform(areas, lambda a: G.contains_point(a, x, y)), True) - 1, F.lit(-1)).cast("int")


def assembled(pages: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """pages (doc, page_no, page_count, text, blocks, tables, figures) with text, tables_kept, tables_rejected.

    Page-local, on arrays: a block whose centre lies in a figure gives way to the figure's marker, unless it reads
    like sentences; otherwise one in a table gives way to the table's grid. The first block of each puts it there;
    what no block placed follows at the end. Pages with neither keep their text.
    """
    good = F.filter("tables", lambda t: grids.is_table(t.rows, settings)) if settings.extract_tables else F.filter("tables", lambda t: F.lit(False))
    rejected = F.size("tables") - F.size("_good") if settings.extract_tables else F.lit(0)
    label = T.page_label(F.col("page_no"), F.col("page_count"))
    marker = lambda i: F.concat(F.lit("\n[figure: "), label, F.lit("_f"), (i + 1).cast("string"), F.lit(".png]\n"))
    p = pages.withColumn("_good", good).withColumn("_grids", F.transform("_good", lambda t: grids.fenced(grids.markdown_grid(t.rows))))
    blocks = F.filter(F.coalesce("blocks", F.array()), lambda b: T.strip(F.coalesce(b.text, F.lit(""))) != "")
    sentences = lambda b: T.words_per_line(b.text) > settings.chart_max_words_per_line
    held = F.transform(blocks, lambda b: F.struct(b.text.alias("text"), first_holding(F.col("figures"), b).alias("figure"), first_holding(F.col("_good"), b).alias("grid")))
    as_text = lambda b: F.when(b.figure >= 0, sentences(b)).otherwise(b.grid < 0)
    name = lambda b: F.when(b.figure >= 0, F.concat(F.lit("f"), b.figure.cast("string"))).otherwise(F.concat(F.lit("g"), b.grid.cast("string")))
    target = lambda b: F.when(as_text(b), F.lit("")).otherwise(name(b))
    seen = F.transform(held, lambda b: F.struct(b.text.alias("text"), b.figure.alias("figure"), b.grid.alias("grid"), target(b).alias("target")))
    p = p.withColumn("_seen", seen).withColumn("_targets", F.col("_seen.target"))

    def part(b: Column, i: Column) -> Column:
        placed = F.when(b.figure >= 0, marker(b.figure)).otherwise(F.element_at("_grids", b.grid + 1))
        return F.when(b.target == "", b.text).when(F.array_position("_targets", b.target) == i + 1, placed)

    rest_grids = F.transform("_grids", lambda g, i: F.when(~F.array_contains("_targets", F.concat(F.lit("g"), i.cast("string"))), g))
    rest_figures = F.transform("figures", lambda f, i: F.when(~F.array_contains("_targets", F.concat(F.lit("f"), i.cast("string"))), marker(i)))
    parts = F.concat(F.transform("_seen", part), rest_grids, rest_figures)
    whole = F.array_join(F.filter(parts, lambda x: x.isNotNull()), "\n")
    plain = (F.size("_good") == 0) & (F.size("figures") == 0)
    out = p.withColumn("text", F.when(plain, F.col("text")).otherwise(whole)).withColumn("tables_kept", F.size("_good")).withColumn("tables_rejected", rejected)
    return out.drop("_good", "_grids", "_seen", "_targets")
