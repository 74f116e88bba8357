"""Adapters that need what is not part of this package: paged formats, rendering, recognition.

Each takes a callable for one file or picture and applies it to all; what a callable raises becomes the error of its
row. Without one, asking for it says what is missing.
"""

import importlib.util
import shutil
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text as T
from ..schemas import PAGE_LAYOUT


class AdapterMissing(RuntimeError):
    """No adapter is there for what was asked."""


def can_read_pages() -> bool:
    return importlib.util.find_spec("pymupdf") is not None


def can_recognise() -> bool:
    return shutil.which("tesseract") is not None


def page_layouts(files: DataFrame, reader: Callable[[str, bytes], list[dict]] | None = None) -> DataFrame:
    """files (path, content) as page_layout rows; reader gives one dict a page, with the columns from page_no on."""
    if reader is None:
        raise AdapterMissing("reading paged formats takes a reader: a callable (suffix, bytes) -> list of pages")
    schema = to_arrow_schema(files.sparkSession.createDataFrame([], PAGE_LAYOUT).schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, suffix, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    rows = [{**p, "doc_id": doc} for p in reader(suffix, content)] or [{"doc_id": doc, "error": "no pages"}]
                except Exception as e:  # a file that can't be read is a row, not the end of the run
                    rows = [{"doc_id": doc, "error": f"{type(e).__name__}: {e}"}]
                yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select(T.file_name(F.col("path")).alias("doc"), T.suffix(F.col("path")).alias("suffix"), "content").mapInArrow(read, PAGE_LAYOUT)


def image_layout(files: DataFrame, width: float = 600.0, height: float = 840.0) -> DataFrame:
    """Picture files as documents of one page without text that the picture fills."""
    page = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(width).alias("x1"), F.lit(height).alias("y1"))
    return files.select(T.file_name(F.col("path")).alias("doc_id"), F.lit(1).alias("page_no"), page.alias("page_rect"), F.lit("").alias("text"), F.array(page).alias("images"))


def recognised(pictures: DataFrame, engine: Callable[[bytes], str] | None = None) -> DataFrame:
    """pictures (doc, page_no, picture) with text: what with_supplied and fold_in take; failures are null."""
    if engine is None:
        raise AdapterMissing("recognition takes an engine: a callable bytes -> str")

    def one(picture: bytes) -> str | None:
        try:
            return engine(picture)
        except Exception:  # a picture that can't be read stays unread
            return None

    @F.pandas_udf("string")
    def read(p: pd.Series) -> pd.Series:
        return p.map(one, na_action="ignore")

    column: Column = read("picture")
    return pictures.select("doc", "page_no", column.alias("text"))
