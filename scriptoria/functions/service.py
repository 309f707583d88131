"""Scalar helpers of the service layer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Headers whose values are never shown.
SECRET_HEADERS = ["authorization", "x-api-key", "cookie", "openai_api_key", "gemini_api_key", "api-key"]


def mask_headers(headers: Column, mask: str = "***MASKED***") -> Column:
    """Map of headers with the values of secret ones replaced, whatever their case; null stays."""
    return F.transform_values(headers, lambda k, v: F.when(F.lower(k).isin(SECRET_HEADERS), F.lit(mask)).otherwise(v))


def format_uptime(seconds: Column) -> Column:
    """Duration as ``1d 2h 3m 4s``; units of zero are left out, except seconds."""
    s = F.floor(seconds).cast("bigint")
    parts = [(F.floor(s / 86400), "d"), (F.floor(s / 3600) % 24, "h"), (F.floor(s / 60) % 60, "m")]
    shown = [F.when(n > 0, F.concat(n.cast("string"), F.lit(u))) for n, u in parts]
    return F.when(s.isNotNull(), F.concat_ws(" ", *shown, F.concat((s % 60).cast("string"), F.lit("s"))))
