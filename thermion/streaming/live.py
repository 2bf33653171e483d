"""Structured Streaming forms: sessions of late tracks, windowed figures, and re-scoring of touched tasks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def track_sessions(fixes: DataFrame, key: str, time: str, gap: str = "2 hours", late: str = "6 hours") -> DataFrame:
    """(key, start, end, fixes, low, high) of a stream of fixes (key, time, value): a session ends after `gap`; later than `late` is dropped."""
    grouped = fixes.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("s"), key)
    return grouped.agg(F.count("*").alias("fixes"), F.min("value").alias("low"), F.max("value").alias("high")).select(key, "s.start", "s.end", "fixes", "low", "high")


def hourly_figures(fixes: DataFrame, time: str, late: str = "1 hour") -> DataFrame:
    """(start, n, mean) by hour of a stream of (time, value)."""
    grouped = fixes.withWatermark(time, late).groupBy(F.window(time, "1 hour").alias("w"))
    return grouped.agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select("w.start", "n", "mean")


def rescore(uploads: DataFrame, task: str, flights: Callable[[], DataFrame], score: Callable[[DataFrame], DataFrame], to: str, checkpoint: str) -> StreamingQuery:
    """Score anew, in each batch of a stream of uploads, the tasks that it touches, and replace their partitions below `to`."""

    def batch(rows: DataFrame, _: int) -> None:
        touched = rows.select(task).distinct()
        scored = score(flights().join(touched, task, "left_semi"))
        scored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(task).parquet(to)

    return uploads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
