"""Rounding as published scores need it, and rounding of results for comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """floor(x * 10^d + 0.5) / 10^d: halves go up, also for negative numbers."""
    scale = 10**digits
    return F.floor(x * scale + 0.5) / scale


def shown(x: Column, digits: int = 6) -> Column:
    return F.round(x, digits)


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zoneless timestamp."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts)


def seconds(ts: Column) -> Column:
    return F.floor(micros(ts) / 1_000_000).cast("long")
