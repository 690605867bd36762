"""Event-time windows over streams; state is bounded by the watermark and late rows beyond it are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sliding_activity(events: DataFrame, key: str, ts: str, value: str, window: str = "2 seconds", hop: str = "500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Rows and sum of ``value`` per key and sliding window; windows without rows do not appear."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    out = timed.groupBy(key, F.window("_ts", window, hop)).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(key, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n", "total")


def speech_sessions(words: DataFrame, key: str, ts: str, pause: str = "400 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Continuous activity per key: a session ends after ``pause`` without a row."""
    timed = words.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    out = timed.groupBy(key, F.session_window("_ts", pause)).agg(F.count("*").alias("n"))
    return out.select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")
