"""Listing volume by day over a stream, with late rows up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def volume_stream(events: DataFrame, at: str = "ts", late: str = "2 days") -> DataFrame:
    """Counts by day and event type of a stream with timestamps in ``at``."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return timed.groupBy(F.window("_at", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("date").alias("day"), "event_type", "n")


def write_available(df: DataFrame, path: str, checkpoint: str) -> None:
    """Writes what the source has now, and stops. Days that the watermark hasn't closed stay in the state."""
    df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
