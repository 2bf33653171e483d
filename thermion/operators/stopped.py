"""Stopped tasks: who is scored for how long, the flight up to there, the glide from there, and what it costs.

Two passes over a field: its starts, cut at the stop, give the window that all are scored for; each pilot's
track is then cut at the end of their own window.

starts: (task, pilot keys, start_t or null: official starts up to the stop); rules: (task, announced seconds, gates
array of seconds or null, goal_alt metres).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import gap

# Fixed values of the sporting code (2026 edition): seconds scored back from the announcement, metres of glide a metre of height, seconds a stopped task must have run.
SCORED_BACK = {"HG": 900.0, "PG": 300.0}
GLIDE = {"HG": 5.0, "PG": 2.5}
LEAST_RUN = 3600.0


def least_run(nominal_time: float, scoring: str) -> float:
    return 0.0 if scoring == "PG" else min(LEAST_RUN, nominal_time / 2)


def windows(starts: DataFrame, rules: DataFrame, scoring: str) -> DataFrame:
    """starts with stop_t, window_t (when the field's window begins; null: nobody started), window_end (the pilot's own end) and goal_alt.

    With one gate the window is from it to the stop, for all. Else all are scored as long as the last to start was
    up to the stop: to their own start and that long; who never started, to the stop.
    """
    of = W.partitionBy("task")  # a field: some hundred pilots
    ruled = starts.join(rules, "task").withColumn("stop_t", F.col("announced") - SCORED_BACK[scoring])
    single = F.coalesce(F.size("gates") == 1, F.lit(False))
    last = F.max("start_t").over(of)
    begun = ruled.withColumn("window_t", F.when(single, F.get("gates", F.lit(0))).otherwise(last))
    own = F.col("start_t") + F.greatest(F.col("stop_t") - F.col("window_t"), F.lit(0.0))
    return begun.withColumn("window_end", F.when(single, F.col("stop_t")).otherwise(F.coalesce(own, F.col("stop_t")))).drop("announced", "gates")


def cut(tracks: DataFrame, windowed: DataFrame, keys: list[str]) -> DataFrame:
    """The fixes of tracks (keys, t, ...) up to each pilot's window_end, with the window's columns and `flying`: whether the track goes on to that end."""
    ends = tracks.groupBy(*keys).agg(F.max("t").alias("_last"))
    known = windowed.join(ends, keys).withColumn("flying", F.col("_last") >= F.col("window_end")).drop("_last")
    return tracks.join(known, keys).filter("not flying or t <= window_end")


def glided(fixes: DataFrame, keys: list[str], scoring: str, since: str) -> DataFrame:
    """(keys, flying, left, bonus, best_t) of cut fixes (keys, t, left metres to goal, alt, `since` seconds, flying, goal_alt).

    The best place from `since` on is the one with the least left; only the last place of a pilot still flying
    also has what its height above goal would glide, at most what is left. Ties go to the earlier fix.
    """
    after = fixes.filter(F.col("t") >= F.col(since))
    last = F.max("t").over(W.partitionBy(*keys))
    glide = F.when(F.col("flying") & (F.col("t") == last), F.least(F.col("left"), GLIDE[scoring] * F.greatest(F.col("alt") - F.col("goal_alt"), F.lit(0.0)))).otherwise(0.0)
    reached = after.withColumn("bonus", glide).withColumn("after", F.col("left") - F.col("bonus"))
    best = reached.groupBy(*keys, "flying").agg(F.min(F.struct("after", "t", "bonus")).alias("best"))
    return best.select(*keys, "flying", F.col("best.after").alias("left"), F.col("best.bonus").alias("bonus"), F.col("best.t").alias("best_t"))


def outcome(flights: DataFrame, windowed: DataFrame, keys: list[str], to_ess_km: DataFrame, nominal_time: float, scoring: str) -> DataFrame:
    """(task, window_seconds, met, stopped_validity, landed): whether a task ran long enough, and its factor.

    flights: (task, keys, distance, ess, flying_at_stop boolean, null: no track, as if landed); to_ess_km: (task, to_ess_km).
    """
    km = F.greatest(F.col("distance"), F.lit(0.0)) / 1000
    landed = (~F.coalesce("flying_at_stop", F.lit(False))).cast("long")
    figures = flights.groupBy("task").agg(
        F.max(km).alias("best"), F.avg(km).alias("mean"), F.coalesce(F.stddev_samp(km), F.lit(0.0)).alias("dev"), F.count("*").alias("launched"), F.sum(landed).alias("landed"), F.sum(F.col("ess").cast("long")).alias("at_ess")
    )
    ran = windowed.groupBy("task").agg(F.greatest(F.max(F.col("stop_t") - F.col("window_t")), F.when(F.max("window_t").isNotNull(), 0.0)).alias("window_seconds"))
    known = figures.join(ran, "task").join(to_ess_km, "task").withColumn("met", F.coalesce(F.col("window_seconds") >= least_run(nominal_time, scoring), F.lit(False)))
    spread = (F.col("to_ess_km") - F.col("best") + 1 > 0) & (F.col("best") > F.col("mean"))
    usual = gap.stopped_validity(F.col("best"), F.col("mean"), F.col("dev"), F.col("to_ess_km"), F.col("landed"), F.col("launched"), F.col("at_ess"))
    narrow = F.when(F.col("at_ess") > 0, 1.0).otherwise(F.least(F.lit(1.0), F.pow(F.col("landed") / F.col("launched"), F.lit(3))))
    validity = F.when(F.col("met"), F.when(spread, usual).otherwise(narrow)).otherwise(0.0)
    return known.select("task", "window_seconds", "met", validity.alias("stopped_validity"), "landed")


def time_reduction(best_time: Column, between: Column, available: Column) -> Column:
    """The time points that goal pilots lose and distance gains: what the best of those between the end of the speed section and goal would have had; without such, a pilot arriving as the window ends."""
    would = lambda t: gap.speed_fraction(t, best_time) * available
    due = F.col("met") & (F.col("n_goal") > 0) & best_time.isNotNull()
    return F.when(due & between.isNotNull(), would(between)).when(due & F.col("window_seconds").isNotNull(), would(F.col("window_seconds"))).otherwise(0.0)
