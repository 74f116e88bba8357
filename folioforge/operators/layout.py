"""What pages look like: image coverage, pages to keep as pictures, scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..settings import COVERAGE_GRID, DEFAULT, Settings


def covered_range(box: Column, page: Column, settings: Settings = DEFAULT) -> tuple[Column, Column, Column, Column, Column]:
    """Whether the box is large enough to count, and its first and last row and first and last column on the grid over
    the page, edges included."""
    b, grid = G.clip(box, page), float(COVERAGE_GRID)
    width, height = page.x1 - page.x0, page.y1 - page.y0
    at = lambda v, low, size: F.least(F.lit(COVERAGE_GRID - 1), F.greatest(F.lit(0), ((v - low) / size * grid).cast("int")))
    small = G.is_empty(b) | (G.area(b) / (width * height) < settings.min_image_fraction)
    return ~G.is_empty(page) & ~small, at(b.y0, page.y0, height), at(b.y1, page.y0, height), at(b.x0, page.x0, width), at(b.x1, page.x0, width)


def covered(box: Column, page: Column, settings: Settings = DEFAULT) -> tuple[Column, Column, Column]:
    """The rows of the grid over the page that the box covers (an array), its first and its last column, edges included;
    no rows if the box is too small."""
    counts, top, bottom, first, last = covered_range(box, page, settings)
    rows = F.when(counts, F.sequence(top, bottom)).otherwise(F.array().cast("array<int>"))
    return rows, first, last


def coverage_cells(box: Column, page: Column, settings: Settings = DEFAULT) -> Column:
    """Cells of the grid over the page that the box covers (row * 32 + column)."""
    rows, first, last = covered(box, page, settings)
    return F.flatten(F.transform(rows, lambda r: F.transform(F.sequence(first, last), lambda c: r * COVERAGE_GRID + c)))


def coverage(images: Column, page: Column, settings: Settings = DEFAULT) -> Column:
    """Share of the page that an array of boxes covers. Page-local: no explode, no shuffle."""
    cells = F.array_distinct(F.flatten(F.transform(F.coalesce(images, F.array()), lambda b: coverage_cells(b, page, settings))))
    return F.size(cells) / F.lit(float(COVERAGE_GRID**2))


def coverage_of_boxes(boxes: DataFrame, keys: list[str], settings: Settings = DEFAULT) -> DataFrame:
    """Coverage by page of boxes in rows (keys, box, page_rect). The grid is a bitmap in a few words, as many rows of the
    grid as fit in each; boxes are united before the one shuffle, so that a page sends one row from each task."""
    names = ["_counts", "_top", "_bottom", "_first", "_last"]
    held = 64 // COVERAGE_GRID
    placed = boxes.select(*keys, *(c.alias(n) for c, n in zip(covered_range(F.col("box"), F.col("page_rect"), settings), names, strict=True))).where("_counts")
    placed = placed.withColumn("_columns", F.expr("shiftleft(2L, _last) - shiftleft(1L, _first)"))
    on = lambda row: F.when(F.lit(row).between(F.col("_top"), F.col("_bottom")), F.shiftleft("_columns", row % held * COVERAGE_GRID)).otherwise(F.lit(0).cast("long"))
    words = [reduce(Column.bitwiseOR, map(on, range(r, r + held))) for r in range(0, COVERAGE_GRID, held)]
    united = placed.groupBy(*keys).agg(*(F.bit_or(w).alias(f"_w{i}") for i, w in enumerate(words)))
    filled = reduce(Column.__add__, (F.bit_count(f"_w{i}") for i in range(len(words))))
    return united.select(*keys, (filled / F.lit(float(COVERAGE_GRID**2))).alias("coverage"))


def line_like(drawings: Column) -> Column:
    """Number of drawn lines and rectangles."""
    return F.size(F.filter(F.flatten(F.transform(drawings, lambda d: d.ops)), lambda o: o.isin("l", "re")))


def is_whole_page(share: Column, settings: Settings = DEFAULT) -> Column:
    return share >= settings.image_threshold if settings.renders else F.lit(False)


def is_vector_heavy(chars: Column, paths: Column, settings: Settings = DEFAULT) -> Column:
    """A chart in vectors: little text, many paths. Not asked where charts are cut out or nothing is rendered."""
    if settings.chart_regions or not settings.renders:
        return F.lit(False)
    return (chars <= settings.vector_max_chars) & (paths >= settings.vector_min_paths)


def is_scanned(chars: Column, share: Column, settings: Settings = DEFAULT) -> Column:
    """A picture without text; chars as extracted, before any recognition."""
    return (chars <= settings.scan_max_chars) & (share >= settings.scan_min_coverage)


def wants(drawings: Column, boxes: Column, settings: Settings = DEFAULT) -> tuple[Column, Column]:
    """Whether tables, and whether charts, are looked for on a page."""
    tables = F.lit(settings.extract_tables) & (line_like(drawings) >= settings.table_min_lines)
    return tables, F.lit(settings.chart_regions) & (F.size(boxes) > 0)


def drawing_boxes(drawings: Column, page: Column) -> Column:
    """Drawings clipped to the page, those outside or without area dropped."""
    return F.filter(F.transform(drawings, lambda d: G.clip(d, page)), lambda b: ~G.is_empty(b))


def render_plan(pages: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(doc, page_no, name, clip, dpi) of the pictures to draw: a whole page, or each of its figures."""
    label = T.page_label(F.col("page_no"), F.col("page_count"))
    whole = pages.where("visual").select("doc", "page_no", F.concat(label, F.lit(".png")).alias("name"), F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>").alias("clip"))
    cut = pages.where("NOT visual").select("doc", "page_no", label.alias("label"), F.posexplode("figures").alias("n", "clip"))
    parts = cut.select("doc", "page_no", F.concat("label", F.lit("_f"), (F.col("n") + 1).cast("string"), F.lit(".png")).alias("name"), "clip")
    return whole.unionByName(parts).withColumn("dpi", F.lit(settings.dpi))
