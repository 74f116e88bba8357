"""Queries over runs: results, reports, later recognition, jobs, folders, the queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lifecycle as L
from ..operators import pages as P
from ..operators import reports as R
from ..schemas import PAGE_LAYOUT
from ..settings import MODES, Settings
from ..sources import sinks
from . import inputs as I
from .page_queries import _LABEL, _MARKED, kept_keys, marked
from .reduce import reduce_bodies as run_bodies
from .reduce import reduce_pages

ALL: dict = {}


def query(sql: str | None = None):
    def keep(f):
        ALL[f.__name__] = (f, sql)
        return f

    return keep


_IMAGE = f"CASE WHEN page_no % 4 = 0 THEN concat({_LABEL}, '.png') END"
_FACTS = f"SELECT *, page_no % 4 = 0 AS visual, page_no % 9 = 0 AS scanned, page_no % 18 = 0 AS ocr, CAST(page_no % 3 AS INTEGER) AS tables, CAST(page_no % 2 AS INTEGER) AS tables_rejected, CASE WHEN page_no % 4 <> 0 THEN page_no % 2 ELSE 0 END AS figures_saved, {_IMAGE} AS image_name FROM ({_MARKED})"
_COUNTS = f"""SELECT doc, count(*) AS pages, CAST(count(*) FILTER (visual) + sum(figures_saved) AS BIGINT) AS images_saved, CAST(sum(length(raw)) AS BIGINT) AS chars_in, CAST(sum(length(text)) AS BIGINT) AS chars_out,
 CAST(sum(tables) AS BIGINT) AS tables_found, CAST(sum(tables_rejected) AS BIGINT) AS tables_rejected, count(*) FILTER (scanned) AS scanned_pages, count(*) FILTER (ocr) AS ocr_pages FROM ({_FACTS}) GROUP BY doc"""
_RESULTS = f"""SELECT *, CASE WHEN tokens_in <= 0 THEN 0.0 ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - tokens_out::DOUBLE / tokens_in) END AS saving, scanned_pages > 0 AND ocr_pages = 0 AS needs_ocr, scanned_pages - ocr_pages > 0 AS ocr_remaining, TRUE AS ok,
 concat_ws(', ', concat(pages, ' pages'), concat(images_saved, ' images'), CASE WHEN tables_found > 0 THEN concat(tables_found, ' tables') END, CASE WHEN ocr_pages > 0 THEN concat(ocr_pages, ' pages read by OCR') END, concat('~', format('{{:,}}', tokens_out), ' tokens')) AS message
 FROM (SELECT *, {I.sql_tokens('chars_in')} AS tokens_in, {I.sql_tokens('chars_out')} AS tokens_out FROM ({_COUNTS}))"""


@query(f"SELECT doc, page_no, length(text) AS chars, visual, text = '' AS blank, image_name, scanned, ocr, tables FROM ({_FACTS})")
def page_stats(spark, sf_dir):
    return R.page_stats(marked(spark, sf_dir))


@query(_RESULTS)
def doc_results(spark, sf_dir):
    return R.doc_results(marked(spark, sf_dir))


@query(f"SELECT doc, message FROM ({_RESULTS})")
def result_message(spark, sf_dir):
    return R.doc_results(marked(spark, sf_dir)).select("doc", "message")


@query(f"SELECT doc, needs_ocr FROM ({_RESULTS})")
def needs_ocr_engine(spark, sf_dir):
    return R.doc_results(marked(spark, sf_dir)).select("doc", "needs_ocr")


@query(f"SELECT doc, ocr_remaining FROM ({_RESULTS})")
def needs_ocr_remaining(spark, sf_dir):
    return R.doc_results(marked(spark, sf_dir)).select("doc", "ocr_remaining")


_KEYS = I.sql_boilerplate(I.sql_cleaned(I.FURNISHED))
_WARNING = "CASE WHEN needs_ocr THEN concat(scanned_pages, ' of ', pages, ' pages are pictures without text; recognise them to read them.') END"


@query(f"""SELECT r.doc, concat(concat_ws(chr(10), concat('source: ', r.doc), concat('pages: ', pages), concat('images: ', images_saved, ' at 144 dpi'), 'image threshold: 5% of page area',
 concat('characters: ', format('{{:,}}', chars_in), ' extracted -> ', format('{{:,}}', chars_out), ' kept'), concat('estimated tokens: ', format('{{:,}}', tokens_in), ' -> ', format('{{:,}}', tokens_out)),
 concat('reduction: ', printf('%.1f', round_even(saving * 100.0, 1)), '%'), concat('tables kept as grids: ', tables_found), CASE WHEN tables_rejected > 0 THEN concat('grids judged not to be tables: ', tables_rejected) END,
 CASE WHEN scanned_pages > 0 THEN concat('pages with no text layer: ', scanned_pages, CASE WHEN ocr_pages > 0 THEN concat(', read by OCR: ', ocr_pages) ELSE '' END) END,
 CASE WHEN k.keys IS NOT NULL THEN concat(chr(10), 'running lines removed (# for any number):', chr(10), k.keys) END,
 CASE WHEN needs_ocr THEN concat(chr(10), 'warnings:', chr(10), '  - ', {_WARNING}) END), chr(10)) AS manifest
 FROM ({_RESULTS}) r LEFT JOIN (SELECT doc, string_agg(concat('  - ', key), chr(10) ORDER BY key) AS keys FROM {_KEYS} GROUP BY doc) k ON r.doc = k.doc""")
def manifest(spark, sf_dir):
    clean, keys = kept_keys(spark, sf_dir)
    return R.manifest(R.doc_results(marked(spark, sf_dir, P.stripped(clean, keys))), keys, Settings(extract_tables=True))


@query(f"""SELECT doc, ok, message, pages, images_saved AS images, needs_ocr, tokens_out, list_count(scans) AS scans, scans[1] AS first_scan FROM ({_RESULTS}) r LEFT JOIN
 (SELECT doc AS d, list(concat(doc, '/', image_name) ORDER BY page_no) AS scans FROM ({_FACTS}) WHERE scanned AND NOT ocr AND image_name IS NOT NULL GROUP BY doc) s ON r.doc = s.d""".replace("list_count(scans)", "CAST(coalesce(len(scans), 0) AS INTEGER)"))
def report_json(spark, sf_dir):
    """The report, read back."""
    pages = marked(spark, sf_dir)
    made = R.report_json(R.doc_results(pages), R.page_stats(pages))
    schema = "ok boolean, message string, pages long, images long, needs_ocr boolean, tokens_out long, scans array<struct<page:int,image:string>>"
    r = made.select("doc", F.from_json("report", schema).alias("r")).select("doc", "r.*")
    return r.withColumn("first_scan", F.get("scans", 0)["image"]).withColumn("scans", F.size("scans"))


@query(f"""SELECT n.doc, n.page_no, n.chars, k.keys, r.chars_in, r.scanned_pages AS scanned FROM (SELECT doc, page_no, length(text) AS chars FROM ({_FACTS})) n JOIN ({_RESULTS}) r ON n.doc = r.doc
 LEFT JOIN (SELECT doc, string_agg(key, '+' ORDER BY key) AS keys FROM {_KEYS} GROUP BY doc) k ON n.doc = k.doc""")
def run_notes(spark, sf_dir):
    clean, keys = kept_keys(spark, sf_dir)
    pages = marked(spark, sf_dir, P.stripped(clean, keys))
    notes = R.run_notes(R.doc_results(pages), R.page_stats(pages), keys)
    return notes.select("doc", F.explode("chars").alias("page_no", "chars"), F.array_join("boilerplate", "+").alias("keys"), "chars_in", "scanned")


@query(f"SELECT count(*) AS documents, 0::BIGINT AS failures, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, CAST(coalesce(sum(scanned_pages) FILTER (needs_ocr), 0) AS BIGINT) AS scans_unread, CAST(sum(tokens_in) - sum(tokens_out) AS BIGINT) AS tokens_saved FROM ({_RESULTS})")
def batch_totals(spark, sf_dir):
    return R.batch_totals(R.doc_results(marked(spark, sf_dir)))


@query(f"SELECT p.doc, p.page_no, CASE WHEN trim(coalesce(s.text, '')) <> '' THEN md5(s.text) ELSE md5(p.raw) END AS raw, trim(coalesce(s.text, '')) <> '' AS ocr FROM ({I.FURNISHED}) p LEFT JOIN ({I.SUPPLIED}) s ON p.doc = s.doc AND p.page_no = s.page_no")
def supplied_override(spark, sf_dir):
    return L.with_supplied(I.furnished(spark, sf_dir), I.supplied(spark, sf_dir)).select("doc", "page_no", F.md5(F.col("raw").cast("binary")).alias("raw"), "ocr")


_NEW = I.sql_stripped(f"SELECT doc, page_no, 0 AS page_count, text AS raw, {I.sql_clean('text')} AS text FROM ({I.SUPPLIED})", _KEYS)


@query(f"SELECT f.doc, f.page_no, md5(CASE WHEN n.text <> '' THEN n.text ELSE f.text END) AS text, coalesce(n.text <> '', FALSE) AS ocr FROM {I.sql_reduced(I.FURNISHED)} f LEFT JOIN {_NEW} n ON f.doc = n.doc AND f.page_no = n.page_no")
def ocr_fold_in(spark, sf_dir):
    clean, keys = kept_keys(spark, sf_dir)
    finished = P.stripped(clean, keys).select("doc", "page_no", "text", F.lit(False).alias("ocr"))
    done = L.fold_in(finished, keys, I.supplied(spark, sf_dir), normaliser=None)
    return done.select("doc", "page_no", F.md5(F.col("text").cast("binary")).alias("text"), "ocr")


@query(f"SELECT doc, page_no FROM ({I.PAGED}) WHERE page_no % 9 = 0 AND page_no % 5 <> 0")
def unread_scans(spark, sf_dir):
    return L.unread_scans(I.facts(I.paged(spark, sf_dir)), I.supplied(spark, sf_dir)).select("doc", "page_no")


_MODES = list(MODES.values())


@query(f"SELECT DISTINCT source AS doc, [{', '.join(map(str, _MODES))}][CAST(right(source, 1) AS INTEGER) % 4 + 1]::DOUBLE AS image_threshold, CAST(right(source, 1) AS INTEGER) % 2 = 0 AS extract_tables, count(*) OVER (PARTITION BY source) AS pages FROM documents")
def per_job_settings(spark, sf_dir):
    d = I.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("doc")).agg(F.count(F.lit(1)).alias("pages"))
    n = F.substring("doc", -1, 1).cast("int")
    settings = d.select("doc", F.element_at(F.array(*map(F.lit, _MODES)), n % 4 + 1).alias("image_threshold"), (n % 2 == 0).alias("extract_tables"))
    return d.join(settings, "doc")


@query("SELECT lang, CASE WHEN count(DISTINCT source) = 1 THEN min(source) END AS source, CASE WHEN count(DISTINCT lang) = 1 THEN min(lang) END AS same FROM documents GROUP BY lang")
def shared_setting(spark, sf_dir):
    return I.table(spark, sf_dir, "documents").groupBy("lang").agg(L.shared(F.col("source")).alias("source"), L.shared(F.col("lang")).alias("same"))


@query("SELECT CASE WHEN doc_id % 3 = 0 THEN 'done' ELSE 'queued' END AS state, count(*) AS n FROM documents GROUP BY 1")
def queue_states(spark, sf_dir):
    return L.states(I.table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 3 == 0, "done").otherwise("queued").alias("state")))


_SUFFIX = r"lower(regexp_extract(name, '[^/.](\.[^./]*)$', 1))"
_ALL = ", ".join(f"'{s}'" for v in L.FORMATS.values() for s in v)


@query(f"SELECT seq, name, size FROM (SELECT *, row_number() OVER (PARTITION BY name, size ORDER BY seq) AS n FROM ({I.FILES}) WHERE {_SUFFIX} IN ({_ALL})) WHERE n = 1")
def dedupe_queue(spark, sf_dir):
    return L.queued(I.files(spark, sf_dir))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{k}')" for k, v in L.FORMATS.items() for s in v) + ") AS f(suffix, kind)")
def formats(spark, sf_dir):
    return L.formats(spark)


@query(f"SELECT name, CASE WHEN {_SUFFIX} IN ('.docx', '.odt') THEN 'office' WHEN {_SUFFIX} IN ('.txt', '.md', '.markdown') THEN 'plain' ELSE 'paged' END AS reader, {_SUFFIX} IN ({_ALL}) AS readable FROM ({I.FILES})")
def suffix_dispatch(spark, sf_dir):
    return I.files(spark, sf_dir).select("name", L.reader_of(F.col("name")).alias("reader"), L.is_readable(F.col("name")).alias("readable"))


@query(f"SELECT DISTINCT {_SUFFIX} AS suffix FROM ({I.FILES}) WHERE {_SUFFIX} NOT IN ({_ALL})")
def suffix_gap(spark, sf_dir):
    return I.files(spark, sf_dir).select(T.suffix(F.col("name")).alias("suffix")).exceptAll(I.files(spark, sf_dir).select(T.suffix(F.col("name")).alias("suffix")).where(F.col("suffix").isin(*(s for v in L.FORMATS.values() for s in v)))).distinct()


_STEM = r"regexp_replace(name, '\.[^.]*$', '')"


@query(rf"""SELECT seq, name, CASE WHEN name = first_value(name) OVER (PARTITION BY {_STEM} ORDER BY seq) THEN concat({_STEM}, '_reduced') ELSE concat({_STEM}, '_', regexp_extract(name, '\.([^.]*)$', 1), '_reduced') END AS folder FROM ({I.FILES})""")
def output_folders(spark, sf_dir):
    return L.output_folders(I.files(spark, sf_dir).select("seq", "name"))


@query("SELECT lang, md5(string_agg(text, chr(10) || chr(10) ORDER BY source, lpad(CAST(doc_id AS VARCHAR), 9, '0'))) AS text FROM documents GROUP BY lang")
def joined_text(spark, sf_dir):
    d = I.table(spark, sf_dir, "documents").select("lang", F.col("source").alias("folder"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("name"), F.col("text").alias("markdown"))
    return sinks.joined_digests(d, "lang")


_SAID = ["AdapterMissing: none", "BadZipFile: File is not a zip file", "ValueError: needs a Password", "PATH_NOT_FOUND", "ExecutorLostFailure", "something else"]
_MESSAGE = "concat(event_type, ': ', [" + ", ".join(f"'{x}'" for x in _SAID) + "][event_id % 6 + 1])"


@query("SELECT event_id, CASE " + " ".join(f"WHEN regexp_matches(m, '{words}') THEN '{name}'" for name, words in T.CAUSES) + f" ELSE 'unknown' END AS cause FROM (SELECT event_id, {_MESSAGE} AS m FROM events)")
def failure_cause(spark, sf_dir):
    said = F.concat("event_type", F.lit(": "), F.element_at(F.array(*map(F.lit, _SAID)), (F.col("event_id") % 6 + 1).cast("int")))
    return I.table(spark, sf_dir, "events").select("event_id", T.failure_cause(said).alias("cause"))


_BROKEN = f"SELECT doc, count(*) AS pages, max(doc LIKE '%3') AS lost FROM ({I.PAGED}) GROUP BY doc"


@query(f"""SELECT doc, NOT lost AS ok, CASE WHEN lost THEN 0 ELSE pages END AS pages, CASE WHEN lost THEN concat('Could not read ', doc, ': no pages') END AS failure,
 CASE WHEN lost THEN '' ELSE (SELECT coalesce(string_agg(concat('page ', p.page_no, ': broken'), '+' ORDER BY p.page_no), '') FROM ({I.PAGED}) p WHERE p.doc = b.doc AND p.page_no % 5 = 2) END AS warnings FROM ({_BROKEN}) b""")
def failed_documents(spark, sf_dir):
    """Runs in which some files can't be read at all, and some pages of others."""
    pages = I.paged(spark, sf_dir)
    lost = F.col("doc").endswith("3")
    read = pages.where(~lost).select(F.col("doc").alias("doc_id"), F.col("page_no").cast("int").alias("page_no"), F.col("raw").alias("text"), F.when(F.col("page_no") % 5 == 2, F.lit("broken")).alias("error"))
    gone = pages.where(lost).select(F.col("doc").alias("doc_id")).distinct().withColumn("error", F.lit("no pages"))
    layouts = spark.createDataFrame([], PAGE_LAYOUT).unionByName(read, allowMissingColumns=True).unionByName(gone, allowMissingColumns=True)
    found = reduce_pages(layouts, Settings(strip_repeated_lines=False)).results
    return found.select("doc", "ok", "pages", F.when(~F.col("ok"), F.col("message")).alias("failure"), F.array_join("warnings", "+").alias("warnings"))


@query(f"SELECT DISTINCT doc FROM ({I.PAGED}) WHERE right(doc, 1) IN ('0', '5')")
def stale_jobs(spark, sf_dir):
    jobs = I.table(spark, sf_dir, "documents").select(F.col("source").alias("doc")).distinct()
    made = lambda t: jobs.select("doc", F.struct(t.alias("image_threshold")).alias("settings"))
    changed = F.when(F.substring("doc", -1, 1).isin("0", "5"), 0.2).otherwise(0.05)
    return L.stale(made(changed), made(F.lit(0.05))).select("doc")


@query(rf"SELECT name, concat('optimised_', regexp_replace(name, '(?i)\.pdf$', ''), '.md') AS delivered FROM ({I.FILES})")
def delivery_names(spark, sf_dir):
    return I.files(spark, sf_dir).select("name", sinks.delivery_name(F.col("name")).alias("delivered"))


_RUN = f"""SELECT r.doc, count(*) AS pages, count(*) FILTER (visual) AS images_saved, CAST(sum(length(r.raw)) AS BIGINT) AS chars_in, CAST(sum(length(text)) AS BIGINT) AS chars_out, count(*) FILTER (scanned) AS scanned_pages, count(*) FILTER (ocr) AS ocr_pages
 FROM {I.sql_reduced(I.LAYOUTS)} r JOIN (SELECT doc, page_no AS n, visual, scanned, ocr, raw AS own FROM ({I.LAYOUTS})) f ON r.doc = f.doc AND r.page_no = f.n GROUP BY r.doc"""


@query(_RUN)
def reduce_layouts(spark, sf_dir):
    """A whole run, from layouts of pages to results."""
    pages = I.layouts(spark, sf_dir)
    late = pages.where("page_no % 18 = 0 AND page_no % 25 <> 0").select(F.col("doc_id").alias("doc"), "page_no", F.lit("Recognised words of this page").alias("text"))
    return reduce_pages(pages, supplied=late).results.select("doc", "pages", "images_saved", "chars_in", "chars_out", "scanned_pages", "ocr_pages")


@query(f"""SELECT doc, concat('plain text, ~', format('{{:,}}', tokens_out), ' tokens') AS message, saving FROM (SELECT *, CASE WHEN tokens_in <= 0 THEN 0.0 ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - tokens_out::DOUBLE / tokens_in) END AS saving FROM
 (SELECT doc, {I.sql_tokens('length(raw)')} AS tokens_in, {I.sql_tokens('length(text)')} AS tokens_out FROM (SELECT concat(doc, '.', page_no) AS doc, raw, text FROM ({I.sql_cleaned(I.DIRTY)}))))""")
def reduce_bodies(spark, sf_dir):
    bodies = I.dirty(spark, sf_dir).select(F.concat("doc", F.lit("."), "page_no").alias("doc"), "raw", F.lit("plain text").alias("note"))
    return run_bodies(bodies).select("doc", "message", "saving")
