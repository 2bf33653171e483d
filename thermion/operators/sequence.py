"""The way of tracks through a task's turnpoints: crossings, candidate starts, the path of each, the best one.

Crossings are windows over fixes; a track's crossings (a few a turnpoint) then make one array a track, over
which a fold walks the turnpoints. Tasks are joined by key, so a table of many tasks is one job.

tracks: (task, keys, fix_index, t seconds, lat, lon).
points: (task, tp from 0, way "enter" or "exit", plat, plon, radius).
rules: (task, start, ess, goal: turnpoint numbers; start_way "enter", "exit" or null: both; opens, closes:
seconds or null; gates: seconds, ascending, or null; fallback: the start is no named one).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import ellipsoid_metres
from .components import kept
from .goal import line_crossings, line_metres

#: Metres by which a boundary is widened for those who must enter, narrowed for those who must leave.
BAND = 5.0
#: Tables of points and rules of at most so many rows are broadcast; larger ones are joined by task.
SMALL = 10_000


def _sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def approaches(tracks: DataFrame, points: DataFrame, keys: list[str], only: DataFrame | None = None) -> DataFrame:
    """(task, keys, tp, way, radius, fix_index, t, away): every fix's distance to every turnpoint of its task, or to those in `only` (task, keys, tp)."""
    met = tracks.join(_sent(points), "task")
    met = met if only is None else met.join(only, ["task", *keys, "tp"], "left_semi")
    near = met.withColumn("away", ellipsoid_metres("lat", "lon", "plat", "plon"))
    return near.select("task", *keys, "tp", "way", "radius", "fix_index", "t", "away")


def crossings(near: DataFrame, keys: list[str]) -> DataFrame:
    """(task, keys, tp, way, inside_first, first, found): where the track begins, and its crossings by time.

    A crossing is a change of side between consecutive fixes, at the widened or narrowed boundary; its time is where the
    distance passes the radius itself, within the two fixes; `credited` if only the tolerance makes it one.
    """
    at = W.partitionBy("task", *keys, "tp").orderBy("fix_index")
    edge = F.when(F.col("way") == "exit", F.greatest(F.lit(0.0), F.col("radius") - BAND)).otherwise(F.col("radius") + BAND)
    seen = near.withColumn("inside", F.col("away") <= edge)
    steps = seen.withColumns({"was": F.lag("inside").over(at), "away0": F.lag("away").over(at), "t0": F.lag("t").over(at)})
    share = F.when(F.col("away") != F.col("away0"), (F.col("radius") - F.col("away0")) / (F.col("away") - F.col("away0"))).otherwise(0.0)
    clipped = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
    crossing = F.struct((F.col("t0") + clipped * (F.col("t") - F.col("t0"))).alias("t"), "fix_index", F.col("inside").alias("entered"), (clipped != share).alias("credited"))
    return steps.groupBy("task", *keys, "tp", "way").agg(
        F.min_by("inside", "fix_index").alias("inside_first"),
        F.min_by(F.struct("t", "fix_index", (F.col("away") <= F.col("radius")).alias("within")), "fix_index").alias("first"),
        F.array_sort(F.collect_list(F.when(F.col("was") != F.col("inside"), crossing))).alias("found"),
    )


def _walk(tps: Column, start: Column, ess: Column) -> Column:
    """The path from a start crossing: each next turnpoint is reached at once if the track is on its required side, else at the first fit crossing."""
    kind = "struct<tp:int,t:double,fix_index:bigint,reason:string>"
    begin = F.struct(start["t"].alias("t"), start["fix_index"].alias("fix_index"), F.lit(True).alias("going"), F.array().cast(f"array<{kind}>").alias("path"))

    def step(state: Column, tp: Column) -> Column:
        leaves = tp["way"] == "exit"
        before = F.filter(tp["found"], lambda c: c["t"] < state["t"])
        inside = F.when(F.size(before) > 0, F.element_at(before, -1)["entered"]).otherwise(tp["inside_first"])
        there = F.when(leaves, ~inside).otherwise(inside)
        fit = F.get(F.filter(tp["found"], lambda c: (c["t"] >= state["t"]) & (~leaves | ~c["entered"])), F.lit(0))
        going = state["going"] & (there | fit.isNotNull())
        t, fix = F.when(there, state["t"]).otherwise(fit["t"]), F.when(there, state["fix_index"]).otherwise(fit["fix_index"])
        reason = F.when(there & leaves, "already_outside").when(there, "already_inside").when(tp["tp"] == ess, "first_crossing").otherwise("first_after_previous")
        reached = F.struct(tp["tp"].alias("tp"), t.alias("t"), fix.alias("fix_index"), reason.alias("reason"))
        path = F.when(going, F.concat(state["path"], F.array(reached).cast(f"array<{kind}>"))).otherwise(state["path"])
        return F.struct(F.when(going, t).otherwise(state["t"]).alias("t"), F.when(going, fix).otherwise(state["fix_index"]).alias("fix_index"), going.alias("going"), path.alias("path"))

    return F.aggregate(tps, begin, step, lambda s: s["path"])


def resolved(tracks: DataFrame, points: DataFrame, rules: DataFrame, keys: list[str], lines: DataFrame | None = None) -> DataFrame:
    """A row a track with a start: (task, keys, start_t, start_reason, path, reached, made_goal, ess_t, official_start, early_seconds, section_seconds).

    Of all start crossings that the rules admit, the best path wins: most turnpoints, then nearest to the next one
    afterwards, then the latest start. Crossings before the first gate count only if there are no others. A start that is
    no named one and was never crossed is the first fix, if that is outside. The official start is the last gate at or
    before the crossing; who starts early gets the first gate. Tracks without a start have no row. Goals with a line in `lines`
    (goal.goal_lines) are reached through it.
    """
    rounds = points if lines is None else points.join(lines, ["task", "tp"], "left_anti")
    found = crossings(approaches(tracks, rounds, keys), keys)
    if lines is not None:
        found = found.unionByName(line_crossings(tracks, _sent(lines), keys))
    tps = found.groupBy("task", *keys).agg(F.array_sort(F.collect_list(F.struct("tp", "way", "inside_first", "found", "first"))).alias("tps"))
    shown = tps.join(_sent(rules), "task").withColumn("own", F.get(F.filter("tps", lambda x: x["tp"] == F.col("start")), F.lit(0)))
    wanted = F.when(F.col("fallback"), F.lit(None)).otherwise(F.col("start_way"))
    fit = F.filter("own.found", lambda c: (wanted.isNull() | (c["entered"] == (wanted == "enter"))) & (F.col("closes").isNull() | (c["t"] <= F.col("closes"))) & (F.col("opens").isNull() | (c["t"] >= F.col("opens"))))
    timed = F.filter("fit", lambda c: c["t"] >= F.col("gates")[0])
    legal = F.when(F.coalesce(F.size("gates") > 0, F.lit(False)) & (F.size(timed) > 0), timed).otherwise(F.col("fit"))
    first = F.struct(F.col("own.first.t").alias("t"), F.col("own.first.fix_index").alias("fix_index"), F.lit(False).alias("entered"), F.lit(False).alias("credited"))
    from_first = F.col("fallback") & (F.size("legal") == 0) & ~F.col("own.first.within")
    starts = shown.withColumn("fit", fit).withColumn("legal", legal).withColumn("from_first", from_first).withColumn("starts", F.when(F.col("from_first"), F.array(first)).otherwise(F.col("legal")))
    within = F.transform(F.filter("tps", lambda x: (x["tp"] > F.col("start")) & (x["tp"] <= F.col("goal"))), lambda x: F.struct(x["tp"].alias("tp"), x["way"].alias("way"), x["inside_first"].alias("inside_first"), F.filter(x["found"], lambda c: F.col("closes").isNull() | (c["t"] <= F.col("closes"))).alias("found")))
    each = starts.withColumn("within", within).select("task", *keys, "ess", "goal", "gates", "closes", "start", "from_first", "within", F.explode("starts").alias("begin"))
    walked = each.withColumn("path", _walk(F.col("within"), F.col("begin"), F.col("ess"))).withColumn("last", F.get("path", F.size("path") - 1))
    tried = walked.select("task", *keys, "ess", "goal", "gates", "closes", "from_first", F.col("begin.t").alias("start_t"), "path", F.coalesce("last.t", "begin.t").alias("last_t"), (F.coalesce("last.tp", "start") + 1).alias("tp"))
    # only the longest paths of a track can win: few rows, checkpointed so that what follows does not walk them again
    longest = kept(tried.withColumn("_most", F.max(F.size("path")).over(W.partitionBy("task", *keys))).filter(F.size("path") == F.col("_most")).drop("_most"))
    # how near each of these came to the turnpoint it lacks; only those turnpoints' distances are computed again
    lacking = longest.filter("tp <= goal").select("task", *keys, "tp", "last_t", "closes").distinct()
    lacked = lacking.select("task", *keys, "tp").distinct()
    near_next = approaches(tracks, rounds, keys, lacked).select("task", *keys, "tp", "t", "away")
    if lines is not None:
        to_line = tracks.join(_sent(lines), "task").join(lacked, ["task", *keys, "tp"], "left_semi").withColumn("away", line_metres("lat", "lon"))
        near_next = near_next.unionByName(to_line.select("task", *keys, "tp", "t", "away"))
    after = lacking.join(near_next, ["task", *keys, "tp"]).filter("t >= last_t and (closes is null or t <= closes)")
    closest = after.groupBy("task", *keys, "tp", "last_t").agg(F.min("away").alias("closest"))
    ranked = longest.join(closest, ["task", *keys, "tp", "last_t"], "left")
    order = W.partitionBy("task", *keys).orderBy(F.coalesce("closest", F.lit(0.0)), F.col("start_t").desc())
    best = ranked.withColumn("n", F.row_number().over(order)).filter("n = 1")
    ess_t = F.get(F.filter("path", lambda p: p["tp"] == F.col("ess")), F.lit(0))["t"]
    gate = F.coalesce(F.array_max(F.filter("gates", lambda g: g <= F.col("start_t"))), F.get("gates", F.lit(0)), F.col("start_t"))
    timing = best.withColumn("ess_t", ess_t).withColumn("official_start", gate)
    return timing.select(
        "task",
        *keys,
        "start_t",
        F.when(F.col("from_first"), "track_start").otherwise("last_before_next").alias("start_reason"),
        "path",
        (F.size("path") + 1).alias("reached"),
        (F.col("tp") > F.col("goal")).alias("made_goal"),
        "ess_t",
        "official_start",
        F.greatest(F.lit(0.0), F.col("official_start") - F.col("start_t")).alias("early_seconds"),
        (F.col("ess_t") - F.col("official_start")).alias("section_seconds"),
    )
