"""Ranks, running and sliding windows, sessions, islands, as-of lookups and resampling.

Every operator is generic over (key columns, time, value) and runs in windows of the key; time is a
long (micro- or milliseconds or seconds), so that ranges are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Keys = list[str]


def competition_rank(df: DataFrame, keys: Keys, by: Column, name: str = "rank") -> DataFrame:
    """1, 2, 2, 4: equal values share a rank."""
    return df.withColumn(name, F.rank().over(W.partitionBy(*keys).orderBy(by)).cast("long"))


def position(df: DataFrame, keys: Keys, *by: Column, name: str = "position") -> DataFrame:
    """1, 2, 3, 4: the place in the list; `by` must be unique within a key."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*by)).cast("long"))


def average_rank(df: DataFrame, keys: Keys, value: str, name: str) -> DataFrame:
    """Ranks in which ties share the mean of their places."""
    ties = F.count("*").over(W.partitionBy(*keys, value))
    return df.withColumn(name, F.rank().over(W.partitionBy(*keys).orderBy(value)) + (ties - 1) / 2)


def trailing_rate(df: DataFrame, keys: Keys, time: str, value: str, rows: int, name: str = "rate") -> DataFrame:
    """Change of value per unit of time since the row `rows` before; null where there is none or time stands still."""
    w = W.partitionBy(*keys).orderBy(time, *_ties(df))
    passed = F.col(time) - F.lag(time, rows).over(w)
    return df.withColumn(name, F.when(passed > 0, (F.col(value) - F.lag(value, rows).over(w)) / passed))


def _ties(df: DataFrame) -> list[str]:
    return [c for c in ("event_id", "fix_index") if c in df.columns]


def ratchet(df: DataFrame, keys: Keys, time: str, value: str) -> DataFrame:
    """Adds `least`, the running minimum, and `gained`, what each row lowered it by."""
    w = W.partitionBy(*keys).orderBy(time, *_ties(df))
    least = F.min(value).over(w.rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("least", least).withColumn("gained", F.coalesce(F.lag("least").over(w) - F.col("least"), F.lit(0.0)))


def rolling_median(df: DataFrame, keys: Keys, time: str, value: str, reach: int, name: str = "median") -> DataFrame:
    """Exact median of the values within `reach` of each row's time, both sides."""
    w = W.partitionBy(*keys).orderBy(time).rangeBetween(-reach, reach)
    return df.withColumn(name, F.percentile(F.col(value), F.lit(0.5)).over(w))


def centred_mean(df: DataFrame, keys: Keys, time: str, value: str, reach: int, name: str = "mean") -> DataFrame:
    return df.withColumn(name, F.avg(value).over(W.partitionBy(*keys).orderBy(time).rangeBetween(-reach, reach)))


def islands(df: DataFrame, keys: Keys, order: list[str], flag: Column) -> DataFrame:
    """Rows where flag holds, with `island`, the number (from 1) of their unbroken run within the key."""
    w = W.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("_on", F.coalesce(flag, F.lit(False)))
    begins = marked.withColumn("_begin", (F.col("_on") & ~F.coalesce(F.lag("_on").over(w), F.lit(False))).cast("long"))
    return begins.withColumn("island", F.sum("_begin").over(w.rowsBetween(W.unboundedPreceding, 0))).filter("_on").drop("_on", "_begin")


def sessions(df: DataFrame, keys: Keys, time: str, gap: int) -> DataFrame:
    """Adds `session` (from 1): a new one begins where more than `gap` has passed since the row before."""
    w = W.partitionBy(*keys).orderBy(time, *_ties(df))
    fresh = F.coalesce(F.col(time) - F.lag(time).over(w) > gap, F.lit(True)).cast("long")
    return df.withColumn("_fresh", fresh).withColumn("session", F.sum("_fresh").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_fresh")


def capped_total(df: DataFrame, keys: Keys, order: list[Column], size: str, target: str) -> DataFrame:
    """Adds `fraction` (0 to 1): how much of each row's size counts when rows are taken in order until `target` is full."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    left = F.col(target) - F.coalesce(F.sum(size).over(w), F.lit(0.0))
    return df.withColumn("fraction", F.when(left <= 0, 0.0).when(F.col(size) <= left, 1.0).otherwise(left / F.col(size)))


def asof_backward(left: DataFrame, right: DataFrame, keys: Keys, time: str, values: list[str], within: int | None = None) -> DataFrame:
    """left with the values of right's last row of the same key at or before its time (within `within`), else null.

    A union read in order of time: one shuffle, no join, whatever the number of rows of a key between two times.
    """
    packed = F.struct(F.col(time).alias("_at"), *values)
    a = left.select(*left.columns, F.lit(1).alias("_side"), F.lit(None).cast(right.select(packed.alias("x")).schema["x"].dataType).alias("_found"))
    missing = [F.lit(None).cast(left.schema[c].dataType).alias(c) if c not in (*keys, time) else F.col(c) for c in left.columns]
    b = right.select(*missing, F.lit(0).alias("_side"), packed.alias("_found"))
    w = W.partitionBy(*keys).orderBy(time, "_side").rowsBetween(W.unboundedPreceding, 0)
    met = a.unionByName(b).withColumn("_found", F.last("_found", ignorenulls=True).over(w)).filter("_side = 1")
    near = F.lit(True) if within is None else F.col(time) - F.col("_found._at") <= within
    return met.select(*left.columns, *[F.when(near, F.col(f"_found.{v}")).alias(v) for v in values])


def asof_forward(left: DataFrame, right: DataFrame, keys: Keys, time: str, values: list[str], within: int | None = None) -> DataFrame:
    """As asof_backward, for right's first row at or after the time."""
    turned = lambda d: d.withColumn(time, -F.col(time))
    return turned(asof_backward(turned(left), turned(right), keys, time, values, within))


def resampled(df: DataFrame, keys: Keys, time: str, value: str, step: int, gap: int) -> DataFrame:
    """(keys, time, value) on the grid of multiples of `step` within each key's span, interpolated; null in gaps longer than `gap`.

    df must have one row a (key, time). Each pair of neighbouring rows makes the grid points between them itself.
    """
    w = W.partitionBy(*keys).orderBy(time)
    pairs = df.select(*keys, F.col(time).alias("t0"), F.col(value).alias("v0"), F.lead(time).over(w).alias("t1"), F.lead(value).over(w).alias("v1"))
    first, last = F.ceil(F.col("t0") / step).cast("long") * step, F.floor((F.coalesce("t1", F.col("t0") + 1) - 1) / step).cast("long") * step
    points = pairs.withColumn(time, F.explode(F.when(first <= last, F.sequence(first, last, F.lit(step).cast("long")))))
    share = (F.col(time) - F.col("t0")) / (F.col("t1") - F.col("t0"))
    lerp = F.when(F.col(time) == F.col("t0"), F.col("v0")).when(F.col("t1") - F.col("t0") <= gap, F.col("v0") + share * (F.col("v1") - F.col("v0")))
    return points.select(*keys, time, lerp.alias(value))


def rate_extremes(df: DataFrame, keys: Keys, time: str, value: str, rows: int, climb: float, sink: float) -> DataFrame:
    """(keys, climb_rate, climb_at, sink_rate, sink_at): each key's strongest rise and fall over `rows` rows.

    An extreme that doesn't pass `climb` (from below) or `sink` (from above) is null; the earliest row wins
    ties; keys of fewer than twice `rows` rows are left out. df must have one row a (key, time).
    """
    rated = trailing_rate(df, keys, time, value, rows, "_rate")
    first = lambda edge, turned: edge(F.when(F.col("_rate").isNotNull(), F.struct(F.col("_rate").alias("rate"), (F.col(time) * turned).alias("at"))))
    found = rated.groupBy(*keys).agg(F.count("*").alias("_n"), first(F.max, -1).alias("_up"), first(F.min, 1).alias("_down")).filter(F.col("_n") >= 2 * rows)
    up, down = F.col("_up.rate") > climb, F.col("_down.rate") < sink
    return found.select(*keys, F.when(up, F.col("_up.rate")).alias("climb_rate"), F.when(up, -F.col("_up.at")).alias("climb_at"), F.when(down, F.col("_down.rate")).alias("sink_rate"), F.when(down, F.col("_down.at")).alias("sink_at"))


def time_to_share_of_peak(df: DataFrame, keys: Keys, time: str, value: str, window: int, share: float) -> DataFrame:
    """(keys, seconds): from a key's first row until its rate over the last `window` first reaches `share` of its greatest.

    The rate of a row looks back to the earliest row within `window`, or to the row before where none is. Keys
    without a rise give null.
    """
    w = W.partitionBy(*keys).orderBy(time)
    back = w.rangeBetween(-window, -1)
    t0, v0 = F.coalesce(F.first(time).over(back), F.lag(time).over(w)), F.coalesce(F.first(value).over(back), F.lag(value).over(w))
    rated = df.select(*keys, time, ((F.col(value) - v0) / (F.col(time) - t0)).alias("_rate"))
    of = W.partitionBy(*keys)
    peaked = rated.withColumn("_peak", F.max("_rate").over(of)).withColumn("_from", F.min(time).over(of))
    reached = F.when((F.col("_peak") > 0) & (F.col("_rate") >= F.col("_peak") * share), F.col(time) - F.col("_from"))
    return peaked.groupBy(*keys).agg(F.min(reached).alias("seconds"))


def final_rate(df: DataFrame, keys: Keys, time: str, value: str, window: int) -> DataFrame:
    """(keys, rate): from the last row at least `window` before a key's end until the end; null where none is so early."""
    ends = df.withColumn("_end", F.max(time).over(W.partitionBy(*keys)))
    before = F.max(F.when(F.col("_end") - F.col(time) >= window, F.struct(F.col(time).alias("t"), F.col(value).alias("v"))))
    met = ends.groupBy(*keys).agg(before.alias("_b"), F.max(F.struct(F.col(time).alias("t"), F.col(value).alias("v"))).alias("_e"))
    return met.select(*keys, ((F.col("_e.v") - F.col("_b.v")) / (F.col("_e.t") - F.col("_b.t"))).alias("rate"))


def smoothed_share(df: DataFrame, keys: Keys, time: str, value: str, half: int, least: float) -> DataFrame:
    """(keys, pct): share of a key's rows with a value whose mean over `half` rows on both sides is at least `least`.

    Nulls (steps without a fix) count neither as rows nor in means.
    """
    w = W.partitionBy(*keys).orderBy(time).rowsBetween(-half, half)
    smooth = df.withColumn("_mean", F.avg(value).over(w)).filter(F.col(value).isNotNull())
    return smooth.groupBy(*keys).agg((F.sum((F.col("_mean") >= least).cast("double")) * 100 / F.count("*")).alias("pct"))


def centred_rate(df: DataFrame, keys: Keys, time: str, value: str, reach: int, most: float, name: str = "rate") -> DataFrame:
    """Adds the rate between the first and the last row within `reach` of each row; rows without one, or with one beyond `most`, go."""
    w = W.partitionBy(*keys).orderBy(time).rangeBetween(-reach, reach)
    rated = df.withColumn(name, (F.last(value).over(w) - F.first(value).over(w)) / F.nullif(F.last(time).over(w) - F.first(time).over(w), F.lit(0)))
    return rated.filter(F.abs(name) <= most)
