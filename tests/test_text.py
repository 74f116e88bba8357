"""Text functions: exact strings, and an independent restatement in Python."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.settings import Settings


def over(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


SINGLE = {c: k for k, v in T.SINGLE.items() for c in v} | dict.fromkeys(T.GONE, "") | T.LONGER


def brute_clean(t, s=Settings()):
    t = t.replace("\r\n", "\n").replace("\r", "\n")
    if s.normalise_punctuation:
        t = "".join(SINGLE.get(c, c) for c in unicodedata.normalize("NFKC", t))
    if s.dehyphenate:
        t = re.sub(r"([A-Za-zÀ-ÖØ-öø-ÿ])-\n([a-zà-öø-ÿ])", r"\1\2", t)
    t = "\n".join(line.rstrip(" \t") for line in t.split("\n"))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]{2,}", " ", t)).strip()


TEXTS = [
    "“Rivers’ rise” — a sur-\nvey…", "two  spaces\tand\t\ttabs \t\nnext", "a-\nb-\nc", "Č-\nd x- \ny A-\nB", "ﬁne ﬂow ½ ㎏ ″ ′ ‑ ‐", "soft\u00adhyphen zero\u200bwidth\ufeff", "\u00a0\u2003 edge \u0085\u001f",
    "a\r\nb\rc\r\r\nd", "\n\n\n\nx\n\n\n\n\ny\n\n", "", " ", "e\u0301te\u0301", "x \u0085\ny \u2028z", "• item ▪ item\n– dash − minus", "\u1100\u1161 한", "tail \t",
]


@pytest.mark.parametrize("settings", [Settings(), Settings(normalise_punctuation=False), Settings(dehyphenate=False)])
def test_clean_text(spark, settings):
    assert over(spark, TEXTS, lambda c: T.clean_text(c, settings)) == [brute_clean(t, settings) for t in TEXTS]
    assert over(spark, [None], lambda c: T.clean_text(c, settings)) == [None]


def test_clean_text_is_native_without_nfkc(spark):
    plan = spark.createDataFrame([("x",)], "v string").select(T.clean_text(F.col("v"), normaliser=None))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_page_numbers(spark):
    lines = ["7", "page 7", "Page 12 of 90", "7/90", "2024", "4 ff 9", "- 7 -", "12345", "p. 7", "", "7 of", "٣"]
    assert over(spark, lines, T.is_page_number) == [True, True, True, True, True, True, False, False, False, False, False, True]


def test_keys(spark):
    assert over(spark, ["Page 12 of 345", "x1y22", "٣٤ a", "none"], T.line_key) == ["Page # of #", "x#y#", "# a", "none"]
    assert over(spark, ["ab", "abc", "a1bc", "#", "é è ü", "x" * 101], T.can_be_furniture) == [False, True, True, False, True, False]


def test_tokens_round_half_to_even(spark):
    assert over(spark, [0, 2, 6, 10, 14, 400], T.tokens, "int") == [0, 0, 2, 2, 4, 100]


def test_words_per_line(spark):
    assert over(spark, ["", " \n ", "a b\n\n c d e f ", "one"], T.words_per_line) == [0.0, 0.0, 3.0, 1.0]


def test_names(spark):
    paths = ["/a/b.c/Report.PDF", "x.tar.gz", "noending", ".hidden", "dir.x/none", "a."]
    assert over(spark, paths, T.suffix) == [".pdf", ".gz", "", "", "", "."]
    assert over(spark, paths, T.stem) == ["Report", "x.tar", "noending", ".hidden", "none", "a"]


def test_sizes_and_figures(spark):
    assert over(spark, [0, 511, 512, 1024 * 1023, 1024 * 1024, 3 << 20], T.human_size, "long") == ["0 KB", "0 KB", "1 KB", "1023 KB", "1.0 MB", "3.0 MB"]
    assert over(spark, [0.05, 0.125, 0.126], T.percent, "double") == ["5%", "12%", "13%"]
    assert over(spark, [0, 1234567], T.grouped, "long") == ["0", "1,234,567"]
    assert over(spark, ["x" * 40, "x" * 41], T.shorten) == ["x" * 40, "x" * 37 + "..."]


def test_causes(spark):
    said = ["Bridge.py", "invalid SYNTAX", "no wheel", "net::ERR_FAILED", "cannot allocate", "hm"]
    assert over(spark, said, T.failure_cause) == ["missing_file", "broken_code", "missing_package", "network", "memory", "unknown"]


def test_settings():
    assert Settings().dpi == 144 and Settings(render_zoom=1.7431).dpi == 126
    assert Settings.of_request(100).image_threshold == 1.01 and not Settings.of_request(100).renders
    assert Settings.of_request(20, dpi=9).render_zoom == 0.25 and Settings.of_request(20).image_threshold == 0.2
