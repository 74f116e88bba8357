"""Whole runs: layouts of pages, or bodies of text, to everything that a reduction gives."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import assembly, grids, layout, lifecycle, regions, reports
from ..operators import pages as P
from ..schemas import PAGE_LAYOUT
from ..settings import DEFAULT, Settings
from ..staging import staged, unstaged
from ..sources import adapters, office, plain


@dataclass
class Reduction:
    """What a run of pages gives, each as a DataFrame. Pages and keys are staged tables; the rest is computed when asked for."""

    pages: DataFrame
    keys: DataFrame
    settings: Settings
    problems: DataFrame

    @property
    def stats(self) -> DataFrame:
        return reports.page_stats(self.pages)

    @property
    def results(self) -> DataFrame:
        return reports.with_failures(reports.doc_results(self.pages), self.problems)

    @property
    def markdown(self) -> DataFrame:
        return P.document_markdown(self.pages, self.settings)

    @property
    def manifest(self) -> DataFrame:
        return reports.manifest(self.results, self.keys, self.settings)

    @property
    def reports(self) -> DataFrame:
        return reports.report_json(self.results, self.stats)

    @property
    def notes(self) -> DataFrame:
        return reports.run_notes(self.results, self.stats, self.keys)

    @property
    def pictures(self) -> DataFrame:
        return layout.render_plan(self.pages, self.settings)

    @property
    def totals(self) -> DataFrame:
        return reports.batch_totals(self.results)


def reduce_pages(layouts: DataFrame, settings: Settings = DEFAULT, supplied: DataFrame | None = None, normaliser=T.nfkc) -> Reduction:
    """A run over page layouts (see schemas.PAGE_LAYOUT), one row per page; a page with an error is empty but counts, and
    warns. A row without page_no is a document that can't be read: it has a failed result and no pages.

    Scans are told by the text as extracted, vector graphics by the text after recognition. Layouts are staged, so that
    files are parsed once, and so are the cleaned pages, which both the running lines and the stripped pages are made of.
    """
    none = F.array()
    layouts = staged(layouts, "layouts")
    problems = layouts.where("error IS NOT NULL OR page_no IS NULL").select(F.col("doc_id").alias("doc"), "page_no", F.coalesce("error", F.lit("no pages")).alias("error"))
    layouts = layouts.where("page_no IS NOT NULL")
    d = layouts.withColumn("doc", F.col("doc_id")).join(layouts.groupBy(F.col("doc_id").alias("doc")).agg(F.count(F.lit(1)).alias("page_count")), "doc")
    failed = F.col("error").isNotNull()
    for c in ("images", "drawings", "blocks", "tables"):
        kind = dict(layouts.dtypes)[c]
        d = d.withColumn(c, F.when(failed, none.cast(kind)).otherwise(F.coalesce(F.col(c), none.cast(kind))))
    d = d.withColumn("text", F.when(failed, F.lit("")).otherwise(F.coalesce("text", F.lit("")))).withColumn("coverage", layout.coverage(F.col("images"), F.col("page_rect"), settings))
    d = d.withColumn("whole", layout.is_whole_page(F.col("coverage"), settings) & ~failed)
    d = d.withColumn("boxes", F.when(F.col("whole"), F.array().cast(regions.RECTS)).otherwise(layout.drawing_boxes(F.col("drawings"), F.col("page_rect"))))
    wanted = layout.line_like(F.col("drawings")) >= settings.table_min_lines if settings.extract_tables else F.lit(False)
    d = d.withColumn("tables", F.when(wanted, F.col("tables")).otherwise(none.cast(dict(layouts.dtypes)["tables"])))
    if settings.chart_regions:
        kept = F.transform(F.filter("tables", lambda t: grids.is_table(t.rows, settings)), lambda t: F.struct(t.x0.alias("x0"), t.y0.alias("y0"), t.x1.alias("x1"), t.y1.alias("y1")))
        found = regions.chart_regions(d.select("doc", "page_no", "page_rect", "boxes", "blocks", kept.alias("tables")), settings)
        d = d.join(found, ["doc", "page_no"])
    else:
        d = d.withColumn("figures", F.array().cast(regions.RECTS))
    d = assembly.assembled(d, settings).withColumn("raw", F.col("text"))
    d = d.withColumn("scanned", layout.is_scanned(F.length(T.strip(F.col("raw"))), F.col("coverage"), settings) & ~failed)
    d = lifecycle.with_supplied(d, supplied) if supplied is not None else d.withColumn("ocr", F.lit(False))
    vector = layout.is_vector_heavy(F.length(T.strip(F.col("raw"))), F.size("drawings"), settings) & ~failed
    d = d.withColumn("visual", F.col("whole") | vector).withColumn("figures_saved", F.when(F.col("visual"), 0).otherwise(F.size("figures"))).drop("tables").withColumnRenamed("tables_kept", "tables")
    clean = staged(P.cleaned(d, settings, normaliser), "clean")
    keys = staged(P.boilerplate(clean, settings), "keys")
    pages = staged(P.marked(P.stripped(clean, keys, settings)), "pages")
    unstaged(clean)
    return Reduction(pages, keys, settings, problems)


def reduce_bodies(bodies: DataFrame, settings: Settings = DEFAULT, normaliser=T.nfkc) -> DataFrame:
    """bodies (doc, raw, note) without pages: (doc, ok, message, chars_in, chars_out, tokens_in, tokens_out, saving, markdown)."""
    d = bodies.withColumn("body", T.clean_text(F.coalesce("raw", F.lit("")), settings, normaliser)).withColumn("chars_in", F.length(F.coalesce("raw", F.lit("")))).withColumn("chars_out", F.length("body"))
    d = d.withColumns({"tokens_in": T.tokens(F.col("chars_in")), "tokens_out": T.tokens(F.col("chars_out")), "saving": T.saving(F.col("chars_in"), F.col("chars_out"))})
    message = F.concat("note", F.lit(", ~"), T.grouped(F.col("tokens_out")), F.lit(" tokens"))
    return d.select("doc", F.lit(True).alias("ok"), message.alias("message"), "chars_in", "chars_out", "tokens_in", "tokens_out", "saving", P.unpaged_markdown(F.col("doc"), F.col("body")).alias("markdown"))


def office_bodies(blocks: DataFrame) -> DataFrame:
    """Blocks (doc, block_no, kind, ...) as bodies; the note counts blocks and tables."""
    n = blocks.groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "table").alias("t"))
    note = F.concat_ws(", ", F.concat(F.col("n").cast("string"), F.lit(" blocks")), F.when(F.col("t") > 0, F.concat(F.col("t").cast("string"), F.lit(" tables"))))
    return n.join(grids.blocks_markdown(blocks), "doc", "left").select("doc", F.coalesce("markdown", F.lit("")).alias("raw"), note.alias("note"))


def reduce_paged(spark: SparkSession, path: str, settings: Settings = DEFAULT, reader: Callable[[str, bytes], list[dict]] | None = None) -> DataFrame:
    """The paged files and pictures under a path, as reduce_files gives them. Without a reader for them, every paged file is a failed result."""
    files = spark.read.format("binaryFile").load(path)
    suffix = T.suffix(F.col("path"))
    pictures = adapters.image_layout(files.where(suffix.isin(*lifecycle.FORMATS["image"])))
    paged = files.where(suffix.isin(*lifecycle.FORMATS["paged"]))
    if reader is None:
        read = paged.select(T.file_name(F.col("path")).alias("doc_id"), F.lit("reading paged formats takes a reader").alias("error"))
    else:
        read = adapters.page_layouts(paged, reader)
    layouts = spark.createDataFrame([], PAGE_LAYOUT).unionByName(pictures, allowMissingColumns=True).unionByName(read, allowMissingColumns=True)
    run = reduce_pages(layouts, settings)
    return run.results.join(run.markdown, "doc", "left").select("doc", "ok", "message", "chars_in", "chars_out", "tokens_in", "tokens_out", "saving", "markdown", "needs_ocr", "scanned_pages")


def reduce_files(spark: SparkSession, path: str, settings: Settings = DEFAULT) -> DataFrame:
    """The text and office files under a path, as reduce_bodies gives them; files that can't be read come with ok false."""
    blocks = office.read_office(spark, path).withColumnRenamed("doc_id", "doc")
    failed = blocks.where("error IS NOT NULL").select("doc", F.lit(False).alias("ok"), F.concat(F.lit("Could not read "), "doc", F.lit(": "), "error").alias("message"))
    texts = plain.read_plain(spark, path).withColumn("note", F.lit("plain text"))
    done = reduce_bodies(texts.unionByName(office_bodies(blocks.where("error IS NULL"))), settings)
    return done.unionByName(failed, allowMissingColumns=True)


@contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs that run inside can be ended from elsewhere, by spark.interruptTag(tag)."""
    spark.addTag(tag)
    try:
        yield
    finally:
        spark.removeTag(tag)


def progress(spark: SparkSession) -> tuple[int, int]:
    """Tasks done and in all, of the stages that run now."""
    tracker = spark.sparkContext.statusTracker()
    stages = [s for s in map(tracker.getStageInfo, tracker.getActiveStageIds()) if s]
    return sum(s.numCompletedTasks for s in stages), sum(s.numTasks for s in stages)
