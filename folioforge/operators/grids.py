"""Grids of cells: judging them, and writing them and other blocks as markdown. All on array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound, strip
from ..settings import DEFAULT, Settings


def width(rows: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))


def _cell(row: Column, at: Column) -> Column:
    return strip(F.coalesce(F.when(at < F.size(row), F.element_at(row, at + 1)), F.lit("")))


def filled_lengths(rows: Column) -> Column:
    return F.filter(F.transform(F.flatten(rows), lambda c: F.length(strip(F.coalesce(c, F.lit(""))))), lambda n: n > 0)


def thin_columns(rows: Column) -> Column:
    """Number of columns that are filled in fewer than half of the rows."""
    def thin(at: Column) -> Column:
        carried = F.size(F.filter(rows, lambda r: _cell(r, at) != ""))
        return carried / F.size(rows) < 0.5

    return F.size(F.filter(F.sequence(F.lit(0), width(rows) - 1), thin))


def is_table(rows: Column, settings: Settings = DEFAULT) -> Column:
    """A table, or a box of prose: two rows and columns, short cells, columns that mostly carry something."""
    def short(lengths: Column) -> Column:
        mean = F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x) / F.size(lengths)
        return (F.size(lengths) > 0) & (mean <= settings.table_max_mean_cell) & (F.array_max(lengths) <= settings.table_max_cell)

    shape = (F.size(rows) >= 2) & (width(rows) >= 2)
    cells = bound(filled_lengths(rows), short)
    return F.when(~F.coalesce(shape, F.lit(False)), F.lit(False)).when(~F.coalesce(cells, F.lit(False)), F.lit(False)).otherwise(thin_columns(rows) / width(rows) < settings.table_max_thin_columns)


def any_filled(rows: Column) -> Column:
    return F.exists(F.flatten(rows), lambda c: F.coalesce(c, F.lit("")) != "")


def escape_cell(cell: Column) -> Column:
    return F.replace(F.replace(F.coalesce(cell, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def markdown_grid(rows: Column) -> Column:
    """A markdown table; the first row is its head, unless it is blank: then columns are numbered and all rows stay."""
    line = lambda cells: F.concat(F.lit("|"), F.array_join(F.transform(cells, escape_cell), "|"), F.lit("|"))

    def made(n: Column) -> Column:
        pad = lambda r: F.concat(r, F.array_repeat(F.lit(""), n - F.size(r)))
        has_head = F.exists(F.element_at(rows, 1), lambda c: strip(F.coalesce(c, F.lit(""))) != "")
        numbered = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("Col"), i.cast("string")))
        rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("---"), n), "|"), F.lit("|"))

        def joined(head: Column) -> Column:
            body = F.when(head, F.slice(rows, F.lit(2), F.greatest(F.lit(0), F.size(rows) - 1))).otherwise(rows)
            first = F.when(head, pad(F.element_at(rows, 1))).otherwise(numbered)
            return F.array_join(F.concat(F.array(line(first), rule), F.transform(body, lambda r: line(pad(r)))), "\n")

        return bound(has_head, joined)

    return bound(width(rows), made)


def fenced(grid: Column) -> Column:
    """A blank line on each side, without which a grid reads as prose."""
    return F.concat(F.lit("\n"), strip(F.replace(grid, F.lit("<br>"), F.lit(" "))), F.lit("\n"))


def block_markdown(kind: Column, text: Column, level: Column, rows: Column) -> Column:
    return (
        F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text))
        .when(kind == "list", F.concat(F.lit("- "), text))
        .when((kind == "table") & (F.size(rows) > 0), markdown_grid(rows))
        .otherwise(text)
    )


def blocks_markdown(blocks: DataFrame) -> DataFrame:
    """(doc, markdown) of blocks (doc, block_no, kind, text, level, rows), blank ones left out."""
    part = block_markdown(F.col("kind"), F.coalesce("text", F.lit("")), F.col("level"), F.col("rows"))
    parts = blocks.select("doc", "block_no", part.alias("part")).where(strip(F.col("part")) != "")
    return parts.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "part"))), lambda x: x.part), "\n\n").alias("markdown"))


def kind_counts(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("doc", "kind").agg(F.count(F.lit(1)).alias("n"))
