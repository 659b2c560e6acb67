"""Streaming forms of the aggregates, an extension: windows with a watermark, and the latest version as state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type; batch and streaming give the same rows."""
    found = events.withWatermark("ts", late) if events.isStreaming else events
    return found.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def session_lengths(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    found = events.withWatermark("ts", late) if events.isStreaming else events
    return found.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("session_start"), "user_id", "n")


def append_new(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Append rows not stored before: a stream's own repeats go by key within the watermark."""
    return stream.dropDuplicatesWithinWatermark(keys).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
