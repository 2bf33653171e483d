"""Leading: what a track contributes by itself, and the fold of a field's tracks to coefficients.

A track is scanned once, with times from its own start, and keeps a row of sums; a field adds three times of its
own: when its clock begins, when its last pilot was done, and where its deadline or stop cuts that off. So a track
that arrives late costs its own scan and one small fold.

tracks: (keys, t, left_km to the end of the speed section by the course); flights: (keys, section_km, start_t,
ess_t or null, gate: the first gate or null), a row a track that started.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.gap import leading_weight_integral

#: Seconds that the clock runs on in a field that gives nothing to measure by (a fixed value of the formula).
FALLBACK = 3600.0


def contributions(tracks: DataFrame, flights: DataFrame, keys: list[str], order: str = "t") -> DataFrame:
    """(keys, section_km, start_t, ess_t, gate, last_t, best_km, classic, timed, weighed): the part of each flight that needs no field.

    The best distance only falls, and a fall counts with the time of the fix after the one that made it.
    `timed` and `weighed` are sums of the weighted areas with and without their times, which no gate lets
    begin before it opens. Flights without a fix between start and end of the section have no row.
    """
    joined = tracks.join(flights, keys)
    last = joined.groupBy(*keys).agg(F.max("t").alias("last_t"))
    within = joined.filter("t >= start_t and (ess_t is null or t <= ess_t)")
    at = W.partitionBy(*keys).orderBy(order)
    upto = lambda back: F.least(F.col("section_km"), F.coalesce(F.min("left_km").over(at.rowsBetween(W.unboundedPreceding, -back)), F.col("section_km")))
    steps = within.withColumns({"b0": upto(2), "b1": upto(1)})
    fell = F.col("b0") > F.col("b1")
    part = F.when(fell, F.col("b1") * (leading_weight_integral(F.col("b0") / F.col("section_km")) - leading_weight_integral(F.col("b1") / F.col("section_km")))).otherwise(0.0)
    clock = F.greatest(F.col("t"), F.coalesce("gate", F.col("t"))) - F.col("start_t")
    square = F.when(fell, (F.col("t") - F.col("start_t")) * (F.col("b0") * F.col("b0") - F.col("b1") * F.col("b1"))).otherwise(0.0)
    own = steps.groupBy(*keys, "section_km", "start_t", "ess_t", "gate").agg(
        F.least(F.min("left_km"), F.col("section_km")).alias("best_km"), F.sum(square).alias("classic"), F.sum(part * clock).alias("timed"), F.sum(part).alias("weighed")
    )
    return own.join(last, keys)


def coefficients(parts: DataFrame, rules: DataFrame, field: list[str], scoring: str) -> DataFrame:
    """parts with `leading`, the coefficient (least is best), and `until`, the time to which a flight that did not finish is carried.

    rules: (field, deadline, stop), each null where a task has none. HG: the classic areas, with a
    rectangle for a late start; PG: the weighted ones, from the field's clock. Who did not reach the end of the speed
    section is carried at the best distance to the field's last time: the latest landing of such pilots or the last
    arrival, cut off by deadline and stop.
    """
    landed = F.when(F.col("ess_t").isNull(), F.col("last_t"))
    times = parts.groupBy(*field).agg(F.coalesce(F.min("gate"), F.min("start_t")).alias("first_t"), F.greatest(F.max(landed), F.max("ess_t")).alias("done_t"))
    ruled = times.join(rules, field, "left")
    late = F.when(F.col("deadline") > F.col("first_t"), F.col("deadline"))
    until = F.least(F.coalesce("done_t", F.col("first_t") + FALLBACK), F.col("stop"), late)
    known = parts.join(ruled.select(*field, "first_t", until.alias("until")), field)
    s, best, open_ = F.col("section_km"), F.col("best_km"), F.col("ess_t").isNull()
    if scoring == "HG":
        waited = F.greatest(F.col("start_t") - F.col("first_t"), F.lit(0.0)) * s * s
        missing = F.when(open_, best * best * F.greatest(F.col("until") - F.col("start_t"), F.lit(0.0))).otherwise(0.0)
        total = (F.col("classic") + waited + missing) / (1800 * s * s)
    else:
        missing = F.when(open_, best * F.greatest(F.col("until") - F.col("first_t"), F.lit(0.0)) * leading_weight_integral(best / s)).otherwise(0.0)
        total = (F.col("timed") + (F.col("start_t") - F.col("first_t")) * F.col("weighed") + missing) / (1800 * s)
    return known.withColumn("leading", total)
