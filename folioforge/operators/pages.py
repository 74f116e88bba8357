"""Pages of documents: running headers and footers, cleaned text, markers, markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..settings import DEFAULT, Settings
from ..staging import staged

NOTE = "note: where a marker names a picture, the page's graphics are kept beside this file under that name."


def cleaned(pages: DataFrame, settings: Settings = DEFAULT, normaliser=T.nfkc) -> DataFrame:
    """pages (doc, page_no, raw) with text, cleaned."""
    return pages.withColumn("text", T.clean_text(F.coalesce("raw", F.lit("")), settings, normaliser))


def line_rows(pages: DataFrame) -> DataFrame:
    """(doc, page_no, line_no, line): the lines that are not blank, numbered from 0."""
    return pages.select("doc", "page_no", F.posexplode(T.full_lines(F.col("text"))).alias("line_no", "line"))


def edge_lines(pages: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(doc, page_no, line_no, line) of the first and last few lines of each page."""
    n = settings.repeat_scan_lines

    def edges(lines: Column) -> Column:
        """Cut from the page's array: a filter of exploded lines would count the page's lines again for each."""
        after = F.greatest(F.lit(n), F.size(lines) - n)
        at = lambda part, start: F.transform(part, lambda x, i: F.struct((i + start).cast("int").alias("line_no"), x.alias("line")))
        return F.concat(at(F.slice(lines, 1, n), F.lit(0)), at(F.slice(lines, after + 1, F.lit(n)), after))

    return pages.select("doc", "page_no", F.inline(T.bound(T.full_lines(F.col("text")), edges)))


def furniture_counts(pages: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(doc, key, total, on_pages, at_edges): lines with the key, pages with it, pages with it among the first or last few.

    Keys are reduced within the page's row, so that one aggregation, partial before its shuffle, does it.
    """
    n = settings.repeat_scan_lines
    keys = F.transform(T.full_lines(F.col("text")), T.line_key)
    edges = F.when(F.size("keys") == 0, F.col("keys")).otherwise(F.concat(F.slice("keys", 1, n), F.slice("keys", F.greatest(F.lit(1), F.size("keys") - n + 1), F.lit(n))))
    tagged = lambda a, what: F.transform(a, lambda k: F.struct(k.alias("key"), *(F.lit(int(w == what)).alias(w) for w in ("total", "on_pages", "at_edges"))))
    rows = pages.select("doc", keys.alias("keys"))
    each = rows.select("doc", F.explode(F.concat(tagged(F.col("keys"), "total"), tagged(F.array_distinct("keys"), "on_pages"), tagged(F.array_distinct(edges), "at_edges"))).alias("k"))
    return each.groupBy("doc", F.col("k.key").alias("key")).agg(*(F.sum(f"k.{w}").alias(w) for w in ("total", "on_pages", "at_edges")))


def disqualified(pages: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(doc, key) of lines that stand more than once on some page: prose."""
    return furniture_counts(pages, settings).where("total > on_pages").select("doc", "key")


def boilerplate(pages: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(doc, key) of the running headers and footers of documents of four pages or more, blank pages counted.

    A document has at most 2 * repeat_scan_lines / repeat_ratio of them, as each needs its share of the pages' edges.
    """
    if not settings.strip_repeated_lines:
        return pages.select("doc", F.lit("").alias("key")).where(F.lit(False))
    sizes = pages.groupBy("doc").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 4")
    often = furniture_counts(pages, settings).where((F.col("total") == F.col("on_pages")) & (F.col("at_edges") >= 3) & T.can_be_furniture(F.col("key")))
    floor = F.greatest(F.lit(3), F.floor(F.col("_n") * F.lit(settings.repeat_ratio)).cast("int"))
    return often.join(sizes, "doc").where(F.col("at_edges") >= floor).select("doc", "key")


def strip_lines(text: Column, keys: Column, settings: Settings = DEFAULT) -> Column:
    """The text without lines whose key is among keys (an array, null for none) and without page numbers."""
    keys = F.coalesce(keys, F.array().cast("array<string>"))

    def stays(line: Column) -> Column:
        def kept(bare: Column) -> Column:
            gone = F.array_contains(keys, T.line_key(bare))
            return (bare == "") | ~(gone | T.is_page_number(bare) if settings.drop_page_numbers else gone)

        return T.bound(T.strip(line), kept)

    out = T.strip(T.collapse_newlines(F.array_join(F.filter(F.split(text, "\n"), stays), "\n")))
    return out if settings.drop_page_numbers else F.when(F.size(keys) == 0, text).otherwise(out)


def few_keys(keys: DataFrame) -> DataFrame:
    """(doc, _keys). Dealt by an exchange of its own, so that its size is known when the join with the pages is chosen:
    Spark broadcasts it if it is small, and else splits what a document with very many pages would give to one task."""
    return keys.groupBy("doc").agg(F.collect_set("key").alias("_keys")).repartition("doc")


def stripped(pages: DataFrame, keys: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """pages with text rid of the boilerplate keys (doc, key) of their document; page-local once the few keys are joined."""
    few = few_keys(keys)
    return pages.join(few, "doc", "left").withColumn("text", strip_lines(F.col("text"), F.col("_keys"), settings)).drop("_keys")


def stripped_by_lines(pages: DataFrame, keys: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(doc, page_no, text): what stripped() gives, by a join of all lines; the twin that tests compare with.

    Lines that go are nulls and not left out, so that a page without any other line needs no join with the pages."""
    lines = pages.select("doc", "page_no", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "line"))
    lines = lines.withColumn("bare", T.strip(F.col("line"))).withColumn("key", T.line_key(F.col("bare")))
    gone = keys.select("doc", "key").distinct().withColumn("gone", F.lit(True))
    stays = F.col("gone").isNull()
    if settings.drop_page_numbers:
        stays = (F.col("bare") == "") | (stays & ~T.is_page_number(F.col("bare")))
    kept = lines.join(gone, ["doc", "key"], "left").select("doc", "page_no", F.when(stays, F.struct("n", "line")).alias("kept"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("kept")), lambda x: x.line), "\n")
    return kept.groupBy("doc", "page_no").agg(T.strip(T.collapse_newlines(text)).alias("text"))


def reduced(pages: DataFrame, settings: Settings = DEFAULT, normaliser=T.nfkc) -> DataFrame:
    """pages (doc, page_no, raw, ...) cleaned and rid of running lines and page numbers."""
    clean = staged(cleaned(pages, settings, normaliser), "clean")  # read twice: for the running lines, and to be rid of them
    return stripped(clean, boilerplate(clean, settings), settings)


def prepare_page_text(raw: Column, keys: Column, settings: Settings = DEFAULT, normaliser=T.nfkc) -> Column:
    """One page's text by known boilerplate keys, as when a page is read later than the others."""
    return strip_lines(T.clean_text(raw, settings, normaliser), keys, settings)


def savings(pages: DataFrame) -> DataFrame:
    """By document: characters and estimated tokens before (raw) and after (text), and the share saved."""
    sums = pages.groupBy("doc").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length(F.coalesce("raw", F.lit("")))).alias("chars_in"), F.sum(F.length("text")).alias("chars_out"))
    return sums.withColumns({"tokens_in": T.tokens(F.col("chars_in")), "tokens_out": T.tokens(F.col("chars_out")), "saving": T.saving(F.col("chars_in"), F.col("chars_out"))})


def header(name: Column, page_count: Column, title: Column, settings: Settings = DEFAULT) -> Column:
    lines = [F.concat(F.lit("# "), name), F.concat(F.lit("pages: "), page_count.cast("string")), F.when(T.strip(title) != "", F.concat(F.lit("title: "), T.strip(title)))]
    if settings.renders:
        lines.append(F.lit(NOTE))
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n"))


def marked(pages: DataFrame) -> DataFrame:
    """pages (doc, page_no, page_count, text, visual) with image_name, blank and marker."""
    name = F.when(F.col("visual"), F.concat(T.page_label(F.col("page_no"), F.col("page_count")), F.lit(".png")))
    named = pages.withColumn("image_name", name).withColumn("blank", F.col("text") == "")
    return named.withColumn("marker", T.page_marker(F.col("page_no"), F.col("image_name"), F.col("blank")))


def document_markdown(pages: DataFrame, settings: Settings = DEFAULT, title: str = "title") -> DataFrame:
    """(doc, markdown) of marked pages: the header, then each page's marker and text."""
    chunk = F.concat(F.col("marker"), F.lit("\n"), F.when(F.col("blank"), F.lit("")).otherwise(F.concat(F.lit("\n"), F.col("text"))))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", chunk.alias("chunk")))), lambda x: x.chunk), "\n")
    titled = F.max(title) if title in pages.columns else F.lit(None).cast("string")
    docs = pages.groupBy("doc").agg(ordered.alias("body"), F.max("page_count").alias("n"), titled.alias("t"))
    whole = F.concat(header(F.col("doc"), F.col("n"), F.col("t"), settings), F.lit("\n"), F.col("body"))
    return docs.select("doc", F.concat(F.regexp_replace(whole, rf"{T.BLANK}+\z", ""), F.lit("\n")).alias("markdown"))


def unpaged_markdown(name: Column, body: Column) -> Column:
    return F.concat(F.lit("# "), name, F.lit("\n\n"), body, F.lit("\n"))
