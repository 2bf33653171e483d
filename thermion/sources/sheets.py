"""Sheets: results and events as CSV files in order, stored results by key, and an audit log that only grows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_sheet(rows: DataFrame, path: str, *order: Column) -> None:
    """rows as CSV with a header, in order over all files; the executors write them, as many files as the rows need."""
    rows.orderBy(*order).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_sheet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("enforceSchema", False).csv(path)


def store(rows: DataFrame, path: str, part: str) -> None:
    """Replace the parts of a stored table that rows have, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def stale(wanted: DataFrame, stored: DataFrame, key: str, state: str) -> DataFrame:
    """Of wanted (key, state digest, ...) what is not stored with the same digest: all that has to be worked out again."""
    held = stored.select(F.col(key).alias("_key"), F.col(state).alias("_state"))
    return wanted.join(held, (F.col(key) == F.col("_key")) & (F.col(state) == F.col("_state")), "left_anti")


def append_log(entries: DataFrame, path: str) -> None:
    """Add entries (who, what, ...) with the time they are written."""
    entries.withColumn("written", F.current_timestamp()).write.mode("append").parquet(path)
