"""python -m folioforge FOLDER [-o OUT]: reduces the files of a folder."""

import argparse
import dataclasses
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import lifecycle, reports
from .plans.reduce import reduce_files, reduce_paged
from .settings import Settings
from .sources import sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="folioforge")
    p.add_argument("folder", nargs="?")
    p.add_argument("-o", "--out", help="folder for the results")
    p.add_argument("-t", "--threshold", type=float, default=5.0, help="percentage of a page that pictures cover, from which it is kept as one")
    p.add_argument("--dpi", type=float, default=144, help="resolution of pages kept as pictures")
    for flag, what in (("text-only", "keep no pages as pictures"), ("tables", "tables as grids"), ("figures", "charts as pictures, without their labels"), ("ocr", "pages without text are to be recognised"), ("keep-headers", "keep running lines and page numbers"), ("raw-punctuation", "keep typographic characters"), ("formats", "list what can be read"), ("quiet", "say nothing but failures")):
        p.add_argument(*(["-q"] if flag == "quiet" else []), f"--{flag}", action="store_true", help=what)
    p.add_argument("--ocr-lang", default="eng")
    return p


def settings_of(a: argparse.Namespace) -> Settings:
    chosen = Settings.of_request(a.threshold, a.dpi, a.text_only, a.tables, a.figures)
    return dataclasses.replace(chosen, normalise_punctuation=not a.raw_punctuation, strip_repeated_lines=not a.keep_headers, drop_page_numbers=not a.keep_headers, ocr=a.ocr, ocr_language=a.ocr_lang, output_dir=a.out)


def main(argv: list[str] | None = None, reader: Callable[[str, bytes], list[dict]] | None = None) -> int:
    p = parser()
    a = p.parse_args(argv)
    if a.formats:
        print(*sorted(s for v in lifecycle.FORMATS.values() for s in v), sep="\n")
        return 0
    if not a.folder:
        p.error("a folder is needed")
    spark, settings = SparkSession.builder.getOrCreate(), settings_of(a)
    texts = reduce_files(spark, a.folder, settings).withColumn("needs_ocr", F.lit(False)).withColumn("scanned_pages", F.lit(0).cast("long"))
    done = texts.unionByName(reduce_paged(spark, a.folder, settings, reader)).cache()
    if a.out:
        named = done.where("ok").withColumn("seq", F.xxhash64("doc")).withColumn("name", F.col("doc"))
        sinks.write_documents(lifecycle.output_folders(named).select("folder", "name", "markdown"), a.out)
    for r in done.select("doc", "ok", "message").orderBy("doc").toLocalIterator():
        if not (a.quiet and r.ok):
            print(f"{r.doc}: {r.message}", file=sys.stdout if r.ok else sys.stderr)
    t = reports.batch_totals(done).first()
    if not a.quiet:
        print(f"total: ~{t.tokens_out or 0:,} tokens, ~{t.tokens_saved or 0:,} removed, {t.failures} failed")
    return int(t.failures > 0)


if __name__ == "__main__":
    sys.exit(main())
