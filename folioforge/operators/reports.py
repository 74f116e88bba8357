"""Figures of pages, documents and batches, and the texts that report them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..settings import DEFAULT, Settings


def page_stats(pages: DataFrame) -> DataFrame:
    """(doc, page_no, chars, visual, blank, image_name, scanned, ocr, tables) of marked pages."""
    return pages.select("doc", "page_no", F.length("text").cast("long").alias("chars"), "visual", (F.col("text") == "").alias("blank"), "image_name", "scanned", "ocr", "tables")


def message(pages: Column, images: Column, tables: Column, ocr: Column, tokens: Column) -> Column:
    n = lambda v, what: F.concat(v.cast("string"), F.lit(what))
    return F.concat_ws(", ", n(pages, " pages"), n(images, " images"), F.when(tables > 0, n(tables, " tables")), F.when(ocr > 0, n(ocr, " pages read by OCR")), F.concat(F.lit("~"), T.grouped(tokens), F.lit(" tokens")))


def doc_results(pages: DataFrame) -> DataFrame:
    """By document, from pages (doc, page_no, raw, text, visual, scanned, ocr, tables, tables_rejected, figures_saved)."""
    count = lambda c: F.count_if(F.col(c)).alias
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    images = F.count_if(F.col("visual")) + F.coalesce(F.sum("figures_saved"), F.lit(0))
    d = pages.groupBy("doc").agg(
        F.count(F.lit(1)).alias("pages"), images.cast("long").alias("images_saved"), F.sum(F.length("raw")).alias("chars_in"), F.sum(F.length("text")).alias("chars_out"),
        total("tables").alias("tables_found"), total("tables_rejected").alias("tables_rejected"), count("scanned")("scanned_pages"), count("ocr")("ocr_pages"),
    )
    d = d.withColumns({"tokens_in": T.tokens(F.col("chars_in")), "tokens_out": T.tokens(F.col("chars_out")), "saving": T.saving(F.col("chars_in"), F.col("chars_out"))})
    d = d.withColumn("needs_ocr", (F.col("scanned_pages") > 0) & (F.col("ocr_pages") == 0)).withColumn("ocr_remaining", F.col("scanned_pages") - F.col("ocr_pages") > 0)
    return d.withColumn("message", message(F.col("pages"), F.col("images_saved"), F.col("tables_found"), F.col("ocr_pages"), F.col("tokens_out"))).withColumn("ok", F.lit(True))


def with_failures(results: DataFrame, problems: DataFrame) -> DataFrame:
    """results of the documents that were read, with their warnings, and a failed result for each that was not.

    problems (doc, page_no, error): with a page it is a warning of its document, without one the document itself failed.
    """
    said = F.concat(F.lit("page "), F.col("page_no").cast("string"), F.lit(": "), F.col("error"))
    pages = problems.where("page_no IS NOT NULL").groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_no", said.alias("said")))), lambda x: x.said).alias("warnings"))
    lost = problems.where("page_no IS NULL").groupBy("doc").agg(F.min("error").alias("error"))
    lost = lost.select("doc", F.lit(False).alias("ok"), failed_message(F.col("doc"), F.col("error")).alias("message"))
    none = F.array().cast("array<string>")
    read = results.join(lost.select("doc"), "doc", "left_anti").join(pages, "doc", "left").withColumn("warnings", F.coalesce("warnings", none))
    nothing = {c: F.lit(0).cast(kind) for c, kind in results.dtypes if kind in ("bigint", "int", "double")}
    gone = lost.withColumns(nothing | {"needs_ocr": F.lit(False), "ocr_remaining": F.lit(False), "warnings": none})
    return read.unionByName(gone.select(*read.columns))


def cancelled(docs: DataFrame) -> DataFrame:
    """Results (doc, ok, message) of documents whose run was ended before they were read."""
    return docs.select("doc", F.lit(False).alias("ok"), F.lit("Cancelled.").alias("message"))


def failed_message(doc: Column, error: Column) -> Column:
    return F.concat(F.lit("Could not read "), doc, F.lit(": "), error)


def warning(d: DataFrame) -> Column:
    return F.when(F.col("needs_ocr"), F.concat(F.col("scanned_pages").cast("string"), F.lit(" of "), F.col("pages").cast("string"), F.lit(" pages are pictures without text; recognise them to read them.")))


def warnings_of(d: DataFrame) -> Column:
    """The warnings of a document's pages, where there are any, and that of its scans."""
    scans = F.array_compact(F.array(warning(d)))
    return F.concat(F.col("warnings"), scans) if "warnings" in d.columns else scans


def manifest(results: DataFrame, keys: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(doc, manifest) of results and boilerplate keys; lines without a figure are left out."""
    few = keys.groupBy("doc").agg(F.array_sort(F.collect_set("key")).alias("_keys"))
    d = results.join(few, "doc", "left")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    col, n = F.col, lambda c: T.grouped(F.col(c))
    listed = lambda title, a: F.when(F.size(a) > 0, F.concat(F.lit(f"\n{title}\n"), F.array_join(F.transform(a, lambda x: F.concat(F.lit("  - "), x)), "\n")))
    lines = [
        text("source: ", col("doc")), text("pages: ", col("pages")), text("images: ", col("images_saved"), f" at {settings.dpi} dpi"),
        text("image threshold: ", T.percent(F.lit(settings.image_threshold)), " of page area"),
        text("characters: ", n("chars_in"), " extracted -> ", n("chars_out"), " kept"), text("estimated tokens: ", n("tokens_in"), " -> ", n("tokens_out")),
        text("reduction: ", T.percent(col("saving"), 1)),
    ]
    if settings.extract_tables:
        lines += [text("tables kept as grids: ", col("tables_found")), F.when(col("tables_rejected") > 0, text("grids judged not to be tables: ", col("tables_rejected")))]
    read = F.when(col("ocr_pages") > 0, text(", read by OCR: ", col("ocr_pages"))).otherwise("")
    lines += [F.when(col("scanned_pages") > 0, text("pages with no text layer: ", col("scanned_pages"), read)), listed("running lines removed (# for any number):", col("_keys")), listed("warnings:", warnings_of(d))]
    return d.select("doc", F.concat(F.concat_ws("\n", *lines), F.lit("\n")).alias("manifest"))


def report_json(results: DataFrame, stats: DataFrame) -> DataFrame:
    """(doc, report): the figures of each document as JSON, with its scans that have a picture and are unread."""
    scans = stats.where("scanned AND NOT ocr AND image_name IS NOT NULL").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(F.col("page_no").alias("page"), F.concat("doc", F.lit("/"), "image_name").alias("image")))).alias("scans"))
    none = F.array().cast("array<struct<page:int,image:string>>")
    d = results.join(scans, "doc", "left").withColumn("scans", F.coalesce(F.col("scans").cast("array<struct<page:int,image:string>>"), none))
    fields = F.struct(
        "ok", "message", "pages", F.col("images_saved").alias("images"), F.col("tables_found").alias("tables"), F.col("scanned_pages").alias("scanned"), "needs_ocr",
        "tokens_in", "tokens_out", F.round("saving", 4).alias("saving"), F.slice(warnings_of(d), 1, 5).alias("warnings"), "scans",
    )
    return d.select("doc", F.to_json(fields).alias("report"))


def run_notes(results: DataFrame, stats: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc, boilerplate, chars, chars_in, pages, images, tables, scanned, ocr_pages): what a later fold-in needs."""
    chars = stats.groupBy("doc").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("page_no", "chars")))).alias("chars"))
    few = keys.groupBy("doc").agg(F.array_sort(F.collect_set("key")).alias("boilerplate"))
    d = results.join(chars, "doc").join(few, "doc", "left")
    return d.select("doc", F.coalesce("boilerplate", F.array().cast("array<string>")).alias("boilerplate"), "chars", "chars_in", "pages", F.col("images_saved").alias("images"), F.col("tables_found").alias("tables"), F.col("scanned_pages").alias("scanned"), "ocr_pages")


def batch_totals(results: DataFrame) -> DataFrame:
    """One row: documents, failures, tokens before and after, tokens saved, unread scans."""
    t = results.agg(F.count(F.lit(1)).alias("documents"), F.count_if(~F.col("ok")).alias("failures"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.coalesce(F.sum(F.when(F.col("needs_ocr"), F.col("scanned_pages"))), F.lit(0)).alias("scans_unread"))
    return t.withColumn("tokens_saved", F.col("tokens_in") - F.col("tokens_out"))
