"""Queries over text and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import pages as P
from ..settings import Settings
from ..staging import staged
from . import inputs as I

ALL: dict = {}


def query(sql: str | None = None):
    def keep(f):
        ALL[f.__name__] = (f, sql)
        return f

    return keep


def column(name: str, source, sql_source: str, spark_column, sql_column: str, text: bool = False) -> None:
    """A query of one function of raw, by page: its digest if it is a text."""
    value = (lambda c: F.md5(c.cast("binary"))) if text else (lambda c: c)
    made = f"md5({sql_column})" if text else sql_column

    def run(spark, sf_dir):
        return source(spark, sf_dir).select("doc", "page_no", value(spark_column(F.col("raw"))).alias("value"))

    ALL[name] = (run, f"SELECT doc, page_no, {made} AS value FROM ({sql_source})")


column("clean_newlines", I.dirty, I.DIRTY, T.unify_newlines, I.sql_newlines("raw"), True)
column("clean_nfkc", I.paged, I.PAGED, T.nfkc, "raw", True)
column("clean_punct", I.dirty, I.DIRTY, T.plain_punctuation, I.sql_punctuation("raw"), True)
column("clean_dehyphenate", I.dirty, I.DIRTY, T.dehyphenate, I.sql_dehyphenate("raw"), True)
column("clean_whitespace", I.dirty, I.DIRTY, lambda c: T.collapse_whitespace(T.plain_punctuation(T.unify_newlines(c))), I.sql_whitespace(I.sql_punctuation(I.sql_newlines("raw"))), True)
column("clean_text", I.dirty, I.DIRTY, T.clean_text, I.sql_clean("raw"), True)
column("clean_text_native", I.dirty, I.DIRTY, lambda c: T.clean_text(c, normaliser=None), I.sql_clean("raw"), True)
column("token_estimate", I.paged, I.PAGED, lambda c: T.tokens(F.length(c)), I.sql_tokens("length(raw)"))
column("words_per_line", I.paged, I.PAGED, T.words_per_line, rf"coalesce(list_sum(list_transform({I.sql_lines('raw')}, lambda y: len(string_split_regex(y, '\s+'))))::DOUBLE / len({I.sql_lines('raw')}), 0.0)")
column("human_size", I.paged, I.PAGED, lambda c: T.human_size(F.length(c).cast("long") * F.col("page_no") * 97), "CASE WHEN length(raw) * page_no * 97 / 1024.0 < 1024 THEN concat(CAST(floor(length(raw) * page_no * 97 / 1024.0::DOUBLE + 0.5) AS BIGINT), ' KB') ELSE concat(printf('%.1f', length(raw) * page_no * 97 / 1024.0::DOUBLE / 1024.0::DOUBLE), ' MB') END")
column("shorten", I.paged, I.PAGED, T.shorten, "CASE WHEN length(raw) > 40 THEN concat(left(raw, 37), '...') ELSE raw END")


@query(f"SELECT doc, page_no, line, regexp_matches(line, '{I.PAGE_NUMBER}') AS is_number FROM ({I.NUMBERED})")
def page_number_lines(spark, sf_dir):
    return I.numbered(spark, sf_dir).select("doc", "page_no", "line", T.is_page_number(F.col("line")).alias("is_number"))


_LINES = f"SELECT doc, page_no, {I.sql_lines('text')} AS a FROM ({I.sql_cleaned(I.FURNISHED)})"


def _furnished(spark, sf_dir):
    return P.cleaned(I.furnished(spark, sf_dir))


@query(f"SELECT doc, page_no, CAST(i - 1 AS INTEGER) AS line_no, {I.sql_key('a[i]')} AS key FROM ({_LINES}), unnest(range(1, len(a) + 1)) AS u(i)")
def line_keys(spark, sf_dir):
    return P.line_rows(_furnished(spark, sf_dir)).select("doc", "page_no", "line_no", T.line_key(F.col("line")).alias("key"))


@query(f"SELECT doc, page_no, CAST(i - 1 AS INTEGER) AS line_no, a[i] AS line FROM ({_LINES}), unnest(range(1, len(a) + 1)) AS u(i) WHERE i <= 3 OR i > len(a) - 3")
def edge_lines(spark, sf_dir):
    return P.edge_lines(_furnished(spark, sf_dir))


@query(f"SELECT * FROM {I.sql_boilerplate(I.sql_cleaned(I.PAGED), 0.06)}")
def boilerplate_natural(spark, sf_dir):
    return P.boilerplate(P.cleaned(I.paged(spark, sf_dir)), I.NATURAL)


@query(f"SELECT * FROM {I.sql_boilerplate(I.sql_cleaned(I.FURNISHED))}")
def boilerplate_injected(spark, sf_dir):
    return P.boilerplate(_furnished(spark, sf_dir))


@query(f"SELECT * FROM {I.sql_boilerplate(I.sql_cleaned(I.DOUBLED))}")
def boilerplate_doubled(spark, sf_dir):
    return P.boilerplate(P.cleaned(I.doubled(spark, sf_dir)))


@query(f"SELECT * FROM {I.sql_boilerplate(I.sql_cleaned(I.CONVERSATIONS))}")
def boilerplate_short_documents(spark, sf_dir):
    return P.boilerplate(P.cleaned(I.conversations(spark, sf_dir)))


@query(f"SELECT DISTINCT doc, {I.sql_key('x')} AS key FROM (SELECT doc, page_no, unnest({I.sql_lines('text')}) AS x FROM ({I.sql_cleaned(I.DOUBLED)})) GROUP BY doc, page_no, {I.sql_key('x')} HAVING count(*) > 1")
def boilerplate_disqualified(spark, sf_dir):
    return P.disqualified(P.cleaned(I.doubled(spark, sf_dir)))


@query(f"SELECT doc, page_no, md5(text) AS text FROM {I.sql_reduced(I.FURNISHED)}")
def strip_boilerplate(spark, sf_dir):
    return P.reduced(I.furnished(spark, sf_dir)).select("doc", "page_no", F.md5(F.col("text").cast("binary")).alias("text"))


@query(f"SELECT doc, page_no, md5(text) AS text FROM {I.sql_reduced(I.NUMBERED)}")
def strip_by_lines(spark, sf_dir):
    pages = staged(P.cleaned(I.numbered(spark, sf_dir)), "clean")
    return P.stripped_by_lines(pages, P.boilerplate(pages)).select("doc", "page_no", F.md5(F.col("text").cast("binary")).alias("text"))


_KEYS = "(SELECT DISTINCT doc, 'the #' AS key FROM (" + I.NUMBERED + "))"


@query(f"SELECT doc, page_no, md5(text) AS text FROM {I.sql_stripped(I.sql_cleaned(I.NUMBERED), _KEYS)}")
def prepare_page_text(spark, sf_dir):
    text = P.prepare_page_text(F.col("raw"), F.array(F.lit("the #")))
    return I.numbered(spark, sf_dir).select("doc", "page_no", F.md5(text.cast("binary")).alias("text"))


_SAVED = """count(*) AS pages, CAST(sum(length(raw)) AS BIGINT) AS chars_in, CAST(sum(length(text)) AS BIGINT) AS chars_out"""
_TOKENS = f"{I.sql_tokens('chars_in')} AS tokens_in, {I.sql_tokens('chars_out')} AS tokens_out"


def sql_savings(pages: str) -> str:
    return f"SELECT *, CASE WHEN tokens_in <= 0 THEN 0.0 ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - tokens_out::DOUBLE / tokens_in) END AS saving FROM (SELECT *, {_TOKENS} FROM (SELECT doc, {_SAVED} FROM {pages} GROUP BY doc))"


@query(sql_savings(I.sql_reduced(I.FURNISHED)))
def savings_by_doc(spark, sf_dir):
    return P.savings(P.reduced(I.furnished(spark, sf_dir), normaliser=None))


@query(sql_savings(I.sql_reduced(I.CONVERSATIONS)))
def savings_short_documents(spark, sf_dir):
    return P.savings(P.reduced(I.conversations(spark, sf_dir)))


_LABEL = "concat('p', lpad(CAST(page_no AS VARCHAR), CAST(greatest(3, length(CAST(page_count AS VARCHAR))) AS INTEGER), '0'))"
_MARKED = f"SELECT *, concat('--- p.', page_no, CASE WHEN page_no % 4 = 0 THEN concat(' | see ', {_LABEL}, '.png') ELSE '' END, CASE WHEN text = '' THEN ' | no text' ELSE '' END, ' ---') AS marker FROM (SELECT doc, page_no, page_count, raw, CASE WHEN page_no % 6 = 0 THEN '' ELSE text END AS text FROM {I.sql_reduced(I.FURNISHED)})"


def kept_keys(spark, sf_dir):
    """The furnished pages, cleaned, and their running lines, each as a table: for queries that need the lines as well."""
    clean = staged(P.cleaned(I.furnished(spark, sf_dir), normaliser=None), "clean")
    return clean, staged(P.boilerplate(clean), "keys")


def marked(spark, sf_dir, reduced=None):
    reduced = P.reduced(I.furnished(spark, sf_dir), normaliser=None) if reduced is None else reduced
    pages = reduced.withColumn("text", F.when(F.col("page_no") % 6 == 0, "").otherwise(F.col("text")))
    return P.marked(I.facts(pages))


@query(f"SELECT doc, page_no, marker FROM ({_MARKED})")
def page_markers(spark, sf_dir):
    return marked(spark, sf_dir).select("doc", "page_no", "marker")


def sql_header(note: bool) -> str:
    return "concat('# ', doc, chr(10), 'pages: ', page_count, chr(10), CASE WHEN doc LIKE '%3' THEN concat('title: On ', doc, chr(10)) ELSE '' END" + (f", '{P.NOTE.replace(chr(39), chr(39) * 2)}', chr(10)" if note else "") + ")"


def titled(pages):
    return pages.withColumn("title", F.when(F.col("doc").endswith("3"), F.concat(F.lit(" On "), F.col("doc"))))


@query(f"SELECT DISTINCT doc, {sql_header(True)} AS header, {sql_header(False)} AS text_only FROM ({I.PAGED})")
def doc_header(spark, sf_dir):
    made = lambda s: P.header(F.col("doc"), F.col("page_count"), F.col("title"), s)
    return titled(I.paged(spark, sf_dir)).select("doc", made(Settings()).alias("header"), made(Settings.of_request(text_only=True)).alias("text_only")).distinct()


@query(rf"""SELECT doc, md5(concat(regexp_replace(concat(any_value({sql_header(True)}), chr(10), string_agg(concat(marker, chr(10), CASE WHEN text = '' THEN '' ELSE concat(chr(10), text) END), chr(10) ORDER BY page_no)), '\s+\z', ''), chr(10))) AS markdown FROM ({_MARKED}) GROUP BY doc""")
def document_markdown(spark, sf_dir):
    return P.document_markdown(titled(marked(spark, sf_dir))).select("doc", F.md5(F.col("markdown").cast("binary")).alias("markdown"))


@query(f"SELECT concat('d', doc_id) AS doc, md5(concat('# d', doc_id, chr(10), chr(10), {I.sql_clean('text')}, chr(10))) AS markdown FROM documents")
def unpaged_markdown(spark, sf_dir):
    name = F.concat(F.lit("d"), F.col("doc_id"))
    return I.table(spark, sf_dir, "documents").select(name.alias("doc"), F.md5(P.unpaged_markdown(name, T.clean_text(F.col("text"))).cast("binary")).alias("markdown"))
