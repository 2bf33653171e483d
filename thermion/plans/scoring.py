"""Scoring a field: from one row a flight to points and ranks, for any number of tasks and classes at once.

A field's figures are one grouped aggregate, joined back to its flights; ranks are windows within the
field. Nothing is iterated, and tasks spread over the cluster by their key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import gap
from ..functions.geo import ellipsoid_metres
from ..functions.numbers import half_up
from ..operators import leading, progress, routes, sequence
from ..operators.aggregates import distance_difficulty
from ..operators.components import kept
from ..operators.stopped import time_reduction


def field_figures(flights: DataFrame, keys: list[str], minimum: float) -> DataFrame:
    """Counts, best distance, best time and sums of each field. flights: keys, distance, goal, ess, time (s, null without), present, flying."""
    over = F.greatest(F.lit(0.0), F.col("distance") - minimum)
    return flights.groupBy(*keys).agg(
        F.sum(F.col("present").cast("long")).alias("n_present"),
        F.sum(F.col("flying").cast("long")).alias("n_flying"),
        F.sum((F.col("flying") & F.col("goal")).cast("long")).alias("n_goal"),
        F.sum((F.col("flying") & F.col("ess")).cast("long")).alias("n_ess"),
        F.max(F.when(F.col("flying"), F.col("distance"))).alias("best_distance"),
        F.min(F.when(F.col("flying") & F.col("ess") & (F.col("time") > 0), F.col("time"))).alias("best_ess_time"),
        F.min(F.when(F.col("flying") & F.col("goal") & (F.col("time") > 0), F.col("time"))).alias("best_goal_time"),
        F.sum(F.when(F.col("flying"), over)).alias("sum_over"),
        F.min(F.when(F.col("flying"), F.col("leading"))).alias("least_leading"),
        F.min(F.when(F.col("flying") & F.col("ess") & ~F.col("goal") & (F.col("time") > 0), F.col("time"))).alias("between_time"),
    )


def available_points(figures: DataFrame, params: dict) -> DataFrame:
    """figures with validities, weights and the points on offer.

    Figures of stopped tasks have stopped_validity, met and window_seconds too (stopped.outcome): another factor, no
    time points with nobody in goal, and what goal pilots lose of them moved to distance.
    """
    p = gap.DEFAULTS | params
    best_time = F.col("best_ess_time") if p["scoring"] == "HG" else F.col("best_goal_time")
    best = F.coalesce("best_distance", F.lit(0.0))
    ratio = F.when(F.col("n_flying") > 0, F.col("n_goal") / F.col("n_flying")).otherwise(0.0)
    w = gap.weights(F.col("goal_ratio"), F.col("n_ess"), p["scoring"], p["leading"], p["arrival"])
    out = (
        figures.withColumn("best_time", best_time)
        .withColumn("goal_ratio", ratio)
        .withColumn("launch_validity", gap.launch_validity(F.col("n_flying"), F.col("n_present")))
        .withColumn("distance_validity", gap.distance_validity(F.coalesce("sum_over", F.lit(0.0)), F.col("n_flying"), best, p["nominal_distance"], p["minimum_distance"]))
        .withColumn("time_validity", gap.time_validity(F.col("best_time"), best, p["nominal_time"], p["nominal_distance"]))
        .withColumn("validity", F.col("launch_validity") * F.col("distance_validity") * F.col("time_validity"))
    )
    was_stopped = "stopped_validity" in figures.columns
    if was_stopped:
        out = out.withColumn("validity", F.col("validity") * F.col("stopped_validity"))
    offered = out.withColumns({f"available_{k}": 1000 * F.col("validity") * v for k, v in w.items()})
    if not was_stopped:
        return offered.withColumn("time_reduction", F.lit(0.0))
    reduced = offered.withColumn("time_reduction", time_reduction(F.col("best_time"), F.col("between_time"), F.col("available_time")))
    none = F.col("met") & (F.col("n_goal") == 0)
    return reduced.withColumns({"available_distance": F.col("available_distance") + F.col("time_reduction"), "available_time": F.when(none, 0.0).otherwise(F.col("available_time"))})


def score_flights(flights: DataFrame, keys: list[str], pilot: str, params: dict | None = None, stopped: DataFrame | None = None) -> DataFrame:
    """flights with points by component, total (one decimal) and rank.

    flights: keys, pilot, distance (m), goal, ess (boolean), time (s, null without), ess_time (order of
    arrival, null without), leading (coefficient, null without), present, flying (boolean), penalty.
    stopped: (keys, stopped_validity, met, window_seconds), where tasks were stopped.
    """
    p = gap.DEFAULTS | (params or {})
    floored = flights.withColumn("distance", F.when(F.col("flying"), F.greatest(F.col("distance"), F.lit(p["minimum_distance"]))).otherwise(0.0))
    field = field_figures(floored, keys, p["minimum_distance"])
    figures = available_points(field if stopped is None else field.join(stopped, keys), p)
    joined = floored.join(figures, keys)
    linear = F.col("distance") / F.col("best_distance")
    if p["scoring"] == "HG":
        steps = distance_difficulty(floored.filter("flying"), keys, p["minimum_distance"]).select(*keys, F.col("slot").alias("_slot"), F.col("score").alias("_score"))
        joined = joined.withColumn("_slot", F.floor(F.col("distance") / 100).cast("long"))
        here = joined.join(steps, [*keys, "_slot"], "left")
        after = steps.select(*keys, (F.col("_slot") - 1).alias("_slot"), F.col("_score").alias("_next"))
        joined = here.join(after, [*keys, "_slot"], "left")
        within = F.when(F.col("_next") > F.col("_score"), F.col("_score") + (F.col("_next") - F.col("_score")) * (F.col("distance") / 100 - F.col("_slot"))).otherwise(F.col("_score"))
        hard = F.when(F.col("goal"), 0.5).otherwise(F.coalesce(within, F.lit(0.5)))
        share = F.when(F.col("goal"), 1.0).otherwise(0.5 * linear + hard)
    else:
        share = linear
    kept = F.when(F.col("goal"), 1.0).when(F.col("ess"), 0.8 if p["scoring"] == "HG" else 0.0).otherwise(0.0)
    timed = F.col("ess") & (F.col("time") > 0)
    time = F.when(timed, gap.speed_fraction(F.col("time"), F.col("best_time")) * kept).otherwise(0.0)
    order = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("ess_time").asc_nulls_last(), pilot))
    arrival = F.when(F.col("ess") & F.col("ess_time").isNotNull(), gap.arrival_fraction(order, F.col("n_ess")) * kept).otherwise(0.0)
    points: dict[str, Column] = {
        "distance_points": F.when(F.col("flying") & (F.col("best_distance") > 0), share).otherwise(0.0) * F.col("available_distance"),
        "time_points": F.greatest(F.lit(0.0), F.coalesce(time, F.lit(0.0)) * F.col("available_time") - F.when(F.col("goal"), F.col("time_reduction")).otherwise(0.0)),
        "leading_points": F.coalesce(gap.leading_fraction(F.col("leading"), F.col("least_leading")), F.lit(0.0)) * F.col("available_leading"),
        "arrival_points": arrival * F.col("available_arrival"),
    }
    scored = joined.withColumns(points)
    total = half_up(sum((F.col(k) for k in points), F.lit(0.0)), 1)
    total = half_up(F.greatest(F.lit(0.0), total - F.coalesce("penalty", F.lit(0.0))), 1)
    ranked = scored.withColumn("total", total).withColumn("rank", F.rank().over(W.partitionBy(*keys).orderBy(F.col("total").desc())).cast("long"))
    return ranked.select(*keys, pilot, "distance", "validity", "best_distance", "best_time", "time_reduction", *points, "total", "rank")


def early_starts(flights: DataFrame, early: str, scoring: str, most_seconds: float, launch_to_start: Column, seconds_a_point: float) -> DataFrame:
    """flights with `early_outcome` (null: none) and what follows from it.

    PG: the distance from launch to the start is all that counts, flown or not. HG: a penalty of a point for
    every `seconds_a_point`, or, beyond `most_seconds`, the minimum distance only.
    """
    is_early = F.coalesce(F.col(early) > 0, F.lit(False))
    outcome = F.when(is_early, F.lit("launch_to_start") if scoring == "PG" else F.when(F.col(early) > most_seconds, "minimum_distance").otherwise("penalty"))
    voided = F.coalesce(F.col("early_outcome") != "penalty", F.lit(False))
    gone = lambda c: F.when(~voided, F.col(c))
    out = flights.withColumn("early_outcome", outcome)
    penalty = F.coalesce("penalty", F.lit(0.0)) + F.when(F.coalesce(F.col("early_outcome") == "penalty", F.lit(False)), F.col(early) / seconds_a_point).otherwise(0.0)
    return out.withColumns({
        "distance": F.when(F.col("early_outcome") == "launch_to_start", launch_to_start).when(voided, 0.0).otherwise(F.col("distance")),
        "goal": F.col("goal") & ~voided, "ess": F.col("ess") & ~voided, "time": gone("time"), "ess_time": gone("ess_time"), "leading": gone("leading"), "penalty": penalty,
    })


def series(scores: DataFrame, task: str, pilot: str, score: str, planned: int | None = None) -> DataFrame:
    """(task, pilot, performance, fraction, counted): best performances count until the series' target is full.

    The target is 1 less the discard (a fifth; a quarter from 7 tasks on) of the sum of the winners' scores in thousands.
    """
    best = scores.groupBy(task).agg(F.max(score).alias("winner"))
    target = best.agg((F.sum(F.col("winner") / 1000)).alias("all"), F.count("*").alias("tasks"))
    share = F.when((F.lit(planned) if planned else F.col("tasks")) >= 7, 0.75).otherwise(0.8)
    full = target.select((share * F.col("all")).alias("target"))  # one row
    each = scores.join(best, task).join(F.broadcast(full)).withColumn("size", F.col("winner") / 1000)
    ranked = each.withColumn("performance", F.when(F.col("winner") > 0, F.col(score) / F.col("winner")).otherwise(0.0))
    from ..operators.windows import capped_total

    capped = capped_total(ranked, [pilot], [F.col("performance").desc(), F.col(score).desc(), F.col(task)], "size", "target")
    return capped.select(task, pilot, score, "performance", "fraction", (F.col(score) * F.col("fraction")).alias("counted"))


def open_distance(flights: DataFrame, keys: list[str], pilot: str) -> DataFrame:
    """Open-distance tasks: the greatest distance of each pilot is the score, whatever the class; ties share a rank."""
    best = flights.groupBy(*keys, pilot).agg(F.max("distance").alias("distance"))
    return best.withColumn("rank", F.rank().over(W.partitionBy(*keys).orderBy(F.col("distance").desc())).cast("long"))


# Fixed values of hang gliding: seconds of an early start that a penalty makes good, and seconds a point.
EARLY_MOST, EARLY_SECONDS = 300.0, 2.0


def distances_left(tracks: DataFrame, paths: DataFrame, points: DataFrame, route: DataFrame, rules: DataFrame, pilot: str) -> DataFrame:
    """(task, pilot, t, left_km): of each fix from the start on, the way to the edge of the next turnpoint not yet reached and by the course from there to the end of the speed section."""
    totals = route.select("task", "tp", "total")
    ess = rules.select("task", "start", "ess").join(totals.select("task", F.col("tp").alias("ess"), F.col("total").alias("ess_total")), ["task", "ess"])
    ahead = points.select("task", "tp", "plat", "plon", "radius").join(totals, ["task", "tp"]).join(ess.select("task", "ess_total"), "task")
    known = tracks.join(paths.select("task", pilot, "start_t", "path"), ["task", pilot]).filter("t >= start_t").join(ess.select("task", "start", "ess"), "task")
    reached = F.size(F.filter("path", lambda p: (p["t"] <= F.col("t")) & (p["tp"] <= F.col("ess"))))
    flown = known.withColumn("tp", F.least(F.col("start") + 1 + reached, F.col("ess")).cast("int"))
    away = F.greatest(ellipsoid_metres("lat", "lon", "plat", "plon") - F.col("radius"), F.lit(0.0))
    return flown.join(ahead, ["task", "tp"]).select("task", pilot, "t", ((away + F.col("ess_total") - F.col("total")) / 1000).alias("left_km"))


def score_task(tracks: DataFrame, points: DataFrame, rules: DataFrame, pilot: str, params: dict | None = None, lines: DataFrame | None = None) -> DataFrame:
    """Points and ranks of tasks from their tracks (task, pilot, fix_index, t, lat, lon): all pilots with a track, started or not.

    Ways through the turnpoints, the distance flown (the course less the best way left), leading from whole tracks folded over the
    field, early starts, and the formula. points, rules: as for `sequence.resolved`; lines: goal lines.
    """
    p = gap.DEFAULTS | (params or {})
    paths = kept(sequence.resolved(tracks, points, rules, [pilot], lines))
    route = kept(routes.optimised(points))
    at = lambda name: rules.select("task", F.col(name).alias("tp")).join(route, ["task", "tp"]).select("task", F.col("total").alias(f"{name}_total"))
    course = at("start").join(at("ess"), "task").join(at("goal"), "task")
    best = progress.best_progress(tracks, paths, points, rules, [pilot]).select("task", pilot, "remaining")
    gates = F.get("gates", F.lit(0)).alias("gate")
    section = paths.join(course, "task").join(rules.select("task", gates), "task").select("task", pilot, ((F.col("ess_total") - F.col("start_total")) / 1000).alias("section_km"), "start_t", "ess_t", "gate")
    parts = leading.contributions(distances_left(tracks, paths, points, route, rules, pilot), section, ["task", pilot])
    clock = rules.select("task", F.col("closes").alias("deadline"), F.lit(None).cast("double").alias("stop"))
    led = leading.coefficients(parts, clock, ["task"], p["scoring"]).select("task", pilot, "leading")
    every = tracks.select("task", pilot).distinct().join(paths, ["task", pilot], "left").join(course, "task").join(best, ["task", pilot], "left").join(led, ["task", pilot], "left")
    made = F.coalesce("made_goal", F.lit(False))
    flown = F.when(made, F.col("goal_total")).otherwise(F.greatest(F.col("goal_total") - F.col("remaining"), F.lit(0.0)))
    flights = every.select(
        "task", pilot, F.coalesce(flown, F.lit(0.0)).alias("distance"), made.alias("goal"), F.col("ess_t").isNotNull().alias("ess"), F.col("section_seconds").alias("time"), F.col("ess_t").alias("ess_time"), "leading",
        F.lit(True).alias("present"), F.lit(True).alias("flying"), F.lit(0.0).alias("penalty"), F.coalesce("early_seconds", F.lit(0.0)).alias("early_seconds"), "start_total",
    )
    judged = early_starts(flights, "early_seconds", p["scoring"], EARLY_MOST, F.col("start_total"), EARLY_SECONDS)
    return score_flights(judged, ["task"], pilot, p)

