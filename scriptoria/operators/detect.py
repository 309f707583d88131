"""Classification of files by the text on their first pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regex import strip

#: Characters a page needs more than, to count as a page with text.
PAGE_TEXT = 50


def has_text(text: Column) -> Column:
    """True for a page whose stripped text is longer than ``PAGE_TEXT``; false for null."""
    return F.coalesce(F.length(strip(text)) > PAGE_TEXT, F.lit(False))


def detect_type(pages: DataFrame, sample_pages: int = 5, flag: Column | None = None) -> DataFrame:
    """Per document: ``type`` (vector, scan, mixed, unknown), ``confidence``, ``vector_pages``, ``scan_pages``, ``sample_size``, ``total_pages``.

    ``pages`` has ``doc_id``, ``page_num`` (from 0) and ``text``, or give the page
    test as ``flag``.  The first ``sample_pages`` pages are read.  A document with
    none of them is unknown, with confidence 0.
    """
    test = flag if flag is not None else has_text(F.col("text"))
    seen = pages.select("doc_id", "page_num", test.alias("_t"), (F.col("page_num") < sample_pages).alias("_in"))
    per = seen.groupBy("doc_id").agg(
        F.count_if(F.col("_in")).alias("sample_size"), F.count_if(F.col("_in") & F.col("_t")).alias("vector_pages"), F.count("*").alias("total_pages"),
    )
    r = F.try_divide(F.col("vector_pages").cast("double"), F.col("sample_size").cast("double"))
    kind = F.when(r.isNull(), "unknown").when(r >= 0.9, "vector").when(r <= 0.1, "scan").otherwise("mixed")
    sure = F.when(r.isNull(), 0.0).when(r >= 0.9, r).when(r <= 0.1, 1 - r).otherwise(0.5 + F.abs(0.5 - r))
    return per.select("doc_id", kind.alias("type"), sure.alias("confidence"), "vector_pages", (F.col("sample_size") - F.col("vector_pages")).alias("scan_pages"), "sample_size", "total_pages")


def valid_path(path: Column, exists: Column | None = None) -> Column:
    """Error of a file path, null if it is fine: missing file, or not a PDF."""
    missing = F.lit(False) if exists is None else ~exists
    return F.when(path.isNull() | missing, "file not found").when(~F.lower(path).endswith(".pdf"), "not a PDF file")
