"""Streaming front: new files, first sightings, and alerts on call logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import normalize_text
from ..functions.units import normalize_units
from ..operators.evaluation import alerts


def file_stream(spark: SparkSession, path: str, schema: str, max_files: int = 100) -> DataFrame:
    """Stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def first_seen(rows: DataFrame, key: str, time_col: str, late: str = "30 days") -> DataFrame:
    """Rows whose key wasn't seen within the watermark; state is bounded by it."""
    return rows.withWatermark(time_col, late).dropDuplicatesWithinWatermark([key])


def normalized_stream(blocks: DataFrame) -> DataFrame:
    """Blocks with normalised texts and units; stateless."""
    return blocks.withColumn("text", normalize_units(normalize_text(F.col("text"))))


def start(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what has arrived as Parquet, then stop."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


__all__ = ["alerts", "file_stream", "first_seen", "normalized_stream", "start"]
