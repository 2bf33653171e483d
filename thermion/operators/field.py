"""Field analysis: what a track or a field of tracks is like, by windows and aggregates alone."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def extremes(df: DataFrame, keys: list[str], value: str, *order: str) -> DataFrame:
    """(keys, highest, highest_at, lowest, lowest_at): the extremes, and `order` of the first row that holds each, as structs."""
    up, down = (F.min(F.struct((sign * F.col(value)).alias("v"), *order)) for sign in (-1, 1))
    both = df.groupBy(*keys).agg(up.alias("up"), down.alias("down"))
    return both.select(*keys, (-F.col("up.v")).alias("highest"), F.struct(*(f"up.{c}" for c in order)).alias("highest_at"), F.col("down.v").alias("lowest"), F.struct(*(f"down.{c}" for c in order)).alias("lowest_at"))


def summary(df: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """(keys, n, seconds, highest, gained, interval): rows, time span, highest value, sum of rises and median interval of tracks with one row a time."""
    at = W.partitionBy(*keys).orderBy(time)
    steps = df.withColumns({"_dt": F.col(time) - F.lag(time).over(at), "_dv": F.col(value) - F.lag(value).over(at)})
    return steps.groupBy(*keys).agg(F.count("*").alias("n"), (F.max(time) - F.min(time)).alias("seconds"), F.max(value).alias("highest"), F.coalesce(F.sum(F.greatest("_dv", F.lit(0.0))), F.lit(0.0)).alias("gained"), F.percentile("_dt", 0.5).alias("interval"))


def markers(df: DataFrame, keys: list[str], time: str, step_length: Column, every: float) -> DataFrame:
    """(keys, marker, time): when a track has gone each multiple of `every`, interpolated within the step. step_length: of the step to the row, null at first."""
    at = W.partitionBy(*keys).orderBy(time)
    went = df.withColumn("_step", F.coalesce(step_length, F.lit(0.0))).withColumn("_to", F.sum("_step").over(at.rowsBetween(W.unboundedPreceding, 0)))
    parts = went.select(*keys, F.lag(time).over(at).alias("_t0"), F.col(time).alias("_t1"), F.coalesce(F.lag("_to").over(at), F.lit(0.0)).alias("_from"), "_to")
    lo, hi = F.floor(F.col("_from") / every) + 1, F.floor(F.col("_to") / every)
    each = parts.filter(hi >= lo).select("*", F.explode(F.sequence(lo, hi)).alias("marker"))
    share = (F.col("marker") * every - F.col("_from")) / (F.col("_to") - F.col("_from"))
    return each.select(*keys, "marker", (F.col("_t0") + share * (F.col("_t1") - F.col("_t0"))).alias(time))


def passages(df: DataFrame, keys: list[str], time: str, value: str, level: float) -> DataFrame:
    """(keys, time, up): when a track passes a level between two rows, interpolated."""
    at = W.partitionBy(*keys).orderBy(time)
    both = df.withColumns({"_t0": F.lag(time).over(at), "_v0": F.lag(value).over(at)})
    passed = both.filter((F.col("_v0") >= level) != (F.col(value) >= level))
    share = (level - F.col("_v0")) / (F.col(value) - F.col("_v0"))
    return passed.select(*keys, (F.col("_t0") + share * (F.col(time) - F.col("_t0"))).alias(time), (F.col(value) >= level).alias("up"))


def sustained(df: DataFrame, keys: list[str], time: str, value: str, reach: int) -> DataFrame:
    """(keys, best): the greatest rate over the rows within `reach` after a row; null if no row has others in reach."""
    ahead = W.partitionBy(*keys).orderBy(time).rangeBetween(0, reach)
    passed = F.last(time).over(ahead) - F.col(time)
    rates = df.withColumn("_rate", F.when(passed > 0, (F.last(value).over(ahead) - F.col(value)) / passed))
    return rates.groupBy(*keys).agg(F.max("_rate").alias("best"))


def quality(df: DataFrame, keys: list[str], time: str, value: str, most_rate: float, most_gap: int) -> DataFrame:
    """(keys, jumps, gaps, repeats, findings): rows that change too fast, come too late, or at the same time; and what was found, by name.

    The change that `most_rate` allows is taken in decimals: as a product of doubles, 0.05 times 3 is more than 0.15.
    """
    at = W.partitionBy(*keys).orderBy(time, value)
    dt, dv = F.col(time) - F.lag(time).over(at), F.col(value) - F.lag(value).over(at)
    flags = df.withColumns({"_dt": dt, "_dv": dv})
    whole = dict(df.dtypes)[time] in ("int", "bigint")
    allowed = (F.lit(Decimal(repr(most_rate))) * F.col("_dt").cast("decimal(20,0)")).cast("double") if whole else most_rate * F.col("_dt")
    counted = flags.groupBy(*keys).agg(
        F.count_if((F.col("_dt") > 0) & (F.abs("_dv") > allowed)).alias("jumps"), F.count_if(F.col("_dt") > most_gap).alias("gaps"), F.count_if(F.col("_dt") == 0).alias("repeats")
    )
    return counted.withColumn("findings", F.array_compact(F.array(*(F.when(F.col(c) > 0, c) for c in ("jumps", "gaps", "repeats")))))


def legs(df: DataFrame, keys: list[str], pilot: str, leg: str, seconds: str) -> DataFrame:
    """Adds to each pilot's leg: best (the field's), behind, total (so far), place (in the total, of those who flew it), lost (behind the leader)."""
    on, own = W.partitionBy(*keys, leg), W.partitionBy(*keys, pilot).orderBy(leg)
    timed = df.withColumn("best", F.min(seconds).over(on)).withColumn("total", F.sum(seconds).over(own))
    return timed.withColumns({"behind": F.col(seconds) - F.col("best"), "place": F.rank().over(on.orderBy("total")), "lost": F.col("total") - F.min("total").over(on)})


def best_hour(df: DataFrame, keys: list[str], hour: str, value: str, share: float = 0.2) -> DataFrame:
    """(keys, hour, median, n): the hour of the highest median of those with `share` of the busiest hour's rows; ties to the earlier."""
    each = df.groupBy(*keys, hour).agg(F.percentile(value, 0.5).alias("median"), F.count("*").alias("n"))
    busy = each.withColumn("_most", F.max("n").over(W.partitionBy(*keys))).filter(F.col("n") >= share * F.col("_most"))
    return busy.groupBy(*keys).agg(F.max_by(F.struct(hour, "median", "n"), F.struct("median", -F.col(hour))).alias("_b")).select(*keys, f"_b.{hour}", "_b.median", "_b.n")


def across_tasks(df: DataFrame, keys: list[str], rho: str, n: str) -> DataFrame:
    """(keys, strength, signed, up, down, tasks): correlations of several tasks, weighted by their numbers of pilots; undefined ones don't count."""
    defined = df.filter(F.col(rho).isNotNull() & ~F.isnan(rho))
    mean = lambda x: F.sum(x * F.col(n)) / F.sum(n)
    return defined.groupBy(*keys).agg(mean(F.abs(rho)).alias("strength"), mean(F.col(rho)).alias("signed"), F.count_if(F.col(rho) > 0).alias("up"), F.count_if(F.col(rho) < 0).alias("down"), F.count("*").alias("tasks"))


def listed(df: DataFrame, keys: list[str], withheld: Column, *order: Column) -> DataFrame:
    """Adds `place`: the position in the list, with the withheld below the others."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(F.coalesce(withheld, F.lit(False)), *order)))


def shared_time(left: DataFrame, right: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Rows of left and right (begin, end; right's as begin2, end2) of a key that overlap, with `seconds` of the overlap.

    Both sides are dealt to spans of `width` seconds and meet there; a pair counts in the span where its overlap begins.
    """
    spans = lambda b, e: F.explode(F.sequence(F.floor(F.col(b) / width), F.floor(F.col(e) / width)))
    met = left.withColumn("_span", spans("begin", "end")).join(right.withColumn("_span", spans("begin2", "end2")), [*keys, "_span"])
    start = F.greatest("begin", "begin2")
    return met.filter((F.col("begin") < F.col("end2")) & (F.col("begin2") < F.col("end")) & (F.floor(start / width) == F.col("_span"))).withColumn("seconds", F.least("end", "end2") - start).drop("_span")


def segment_ends(segments, fixes, keys: list[str], index: str, values: list[str]):
    """segments (keys, start, end: fix indices) with the values of both fixes, as start_<value> and end_<value>; null where a fix is missing."""
    side = lambda name: fixes.select(*keys, F.col(index).alias(name), *[F.col(v).alias(f"{name}_{v}") for v in values])
    return segments.join(side("start"), [*keys, "start"], "left").join(side("end"), [*keys, "end"], "left")


def with_manual(tracked, manual, keys: list[str]):
    """Flights with those entered by hand for pilots without a track; `by_hand` tells which. A track wins over an entry."""
    missing = manual.join(tracked.select(*keys), keys, "left_anti")
    return tracked.withColumn("by_hand", F.lit(False)).unionByName(missing.withColumn("by_hand", F.lit(True)), allowMissingColumns=True)


def merged(value, default: float, least: float | None = None, most: float | None = None):
    """A parameter from text: the default where it is missing or no finite number, and kept within its bounds."""
    x = value.try_cast("double")
    out = F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x).otherwise(default)
    out = out if least is None else F.greatest(out, F.lit(float(least)))
    return out if most is None else F.least(out, F.lit(float(most)))


def rising_sum(df, keys: list[str], time: str, value: str, reach: int):
    """(keys, gained): the sum of rises of the mean within `reach` of each row."""
    from .windows import centred_mean

    step = F.col("_mean") - F.lag("_mean").over(W.partitionBy(*keys).orderBy(time))
    steps = centred_mean(df, keys, time, value, reach, "_mean").select(*keys, step.alias("_step"))
    return steps.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("_step") > 0, F.col("_step"))), F.lit(0.0)).alias("gained"))


def nominal_distance(points, keys: list[str], order: str, metres):
    """(keys, metres) from centre to centre of a task's turnpoints; `metres` makes a column of (lat, lon, lat, lon)."""
    w = W.partitionBy(*keys).orderBy(order)
    legs = points.select(*keys, "lat", "lon", F.lag("lat").over(w).alias("_lat"), F.lag("lon").over(w).alias("_lon"))
    leg = F.when(F.col("_lat").isNotNull(), metres(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon"))).otherwise(0.0)
    return legs.groupBy(*keys).agg(F.sum(leg).alias("metres"))


def required_glide(metres, height, target):
    """Metres forward for each metre down to reach a target; null at or below its height."""
    return F.when(height > target, metres / (height - target))
