"""Streams of events: stateless pattern filters and windowed counts with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """Events from Parquet files as they come."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(folder)


def did(events: DataFrame, event_type: str, least: float | None = None) -> DataFrame:
    """User-DID->Event for events of a type: a stateless match, the same on streams and tables."""
    out = events.where(F.col("event_type") == event_type)
    return (out if least is None else out.where(F.col("value") >= least)).select("user_id", "event_id", "ts", "value")


def tumbling_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and users per window and type; events later than the watermark are dropped on streams."""
    per = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return per.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("user_id").alias("users")).select(F.col("window.start").alias("start"), "event_type", "n", "users")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """A user's sessions: events no further apart than the gap."""
    per = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return per.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
