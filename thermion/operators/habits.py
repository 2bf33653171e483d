"""More figures of pilots against their field, in the long table of `metrics`: how they climb, sink, search, leave others and come in.

Inputs, from tracks by the other operators:
tracks: (task, pilot, fix_index, t, alt); climbs: (task, pilot, climb, first, last, start_t, end_t, start_alt, end_alt, to_goal metres
from where it ends); rings: (task, pilot, first, last, start_t, end_t) of circling; turns: (task, pilot, rms, radius);
phases: (task, pilot, phase, start_t, end_t); starts: (task, pilot, start_t or null, ess_t or null, ess_alt, ess_to_goal, takeoff, landing: fixes, land_t);
bands: (task, lo, hi); goals: (task, goal_alt, last_leg metres: of the last leg over 1 km); grid: (task, pilot, t, rate or null);
frames: (task, episode, t, pilot): who is in a gaggle; reached: (task, pilot, tp, t). A pilot for whom a metric is undefined has
no row of it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .metrics import WHO, _of
from .stopped import GLIDE
from .windows import final_rate, smoothed_share, time_to_share_of_peak

# Fixed thresholds: seconds of a climb, of its window and share of its peak; of circling, and bouts; turns; metres of descent and of gain, seconds about a fix; share of the last leg.
CORE_LEAST, CORE_WINDOW, CORE_SHARE, DECAY_LEAST, DECAY_WINDOW = 60, 30, 0.9, 90, 30
BOUT_LEAST, BOUTS, TURNS = 30, 3, 10
DESCENT, DESCENTS, GAINED, ABOUT, REACH_OF_LEG = 100.0, 2, 200.0, 5, 1.5
# Fixed thresholds of leaving a gaggle: seconds it goes on, members that stay, and that are compared; and of air: rows about a step, rate that is no sink.
GOES_ON, STAY, COMPARED, SMOOTHED, NO_SINK = 120, 2, 2, 1, -0.5

#: Direction of each metric that is computed here.
METRICS = {
    "climb.time_to_core": "lower",
    "climb.exit_decay": "neutral",
    "climb.selectivity": "neutral",
    "climb.circle_smoothness": "lower",
    "glide.dolphin_fraction": "neutral",
    "decision.altitude_floor": "neutral",
    "decision.search_fraction": "lower",
    "gaggle.departure_winrate": "neutral",
    "race.ess_margin": "lower",
    "race.final_glide_init": "neutral",
    "day.airtime_quality": "neutral",
}


def _fixes(tracks: DataFrame, climbs: DataFrame, least: float) -> DataFrame:
    """The fixes of climbs that last, at most a row a second."""
    long = climbs.filter(F.col("end_t") - F.col("start_t") >= least).select(*WHO, "climb", "first", "last")
    on = tracks.join(long, WHO).filter(F.col("fix_index").between(F.col("first"), F.col("last")))
    return on.select(*WHO, "climb", F.col("t").cast("long").alias("t"), F.col("alt").cast("double").alias("alt"))


def centring(tracks: DataFrame, climbs: DataFrame) -> list[DataFrame]:
    core = time_to_share_of_peak(_fixes(tracks, climbs, CORE_LEAST), [*WHO, "climb"], "t", "alt", CORE_WINDOW, CORE_SHARE).filter("seconds is not null")
    left = final_rate(_fixes(tracks, climbs, DECAY_LEAST), [*WHO, "climb"], "t", "alt", DECAY_WINDOW).filter("rate is not null")
    return [_of(core, "climb.time_to_core", F.percentile("seconds", 0.5)), _of(left, "climb.exit_decay", F.percentile("rate", 0.5))]


def turning(climbs: DataFrame, rings: DataFrame, turns: DataFrame, starts: DataFrame) -> list[DataFrame]:
    racing = rings.join(starts.select(*WHO, F.col("start_t").alias("_since")), WHO).filter(F.col("start_t") >= F.col("_since")).filter(F.col("end_t") - F.col("start_t") >= BOUT_LEAST)
    held = climbs.select(*WHO, F.col("first").alias("c0"), F.col("last").alias("c1"))
    kept = racing.join(held, WHO).filter("c0 <= last and first <= c1").select(*WHO, "first").distinct().withColumn("kept", F.lit(1))
    bouts = racing.join(kept, [*WHO, "first"], "left").groupBy(*WHO).agg(F.count("*").alias("n"), F.count("kept").alias("kept")).filter(F.col("n") >= BOUTS)
    round_ = turns.filter("radius > 0").groupBy(*WHO).agg(F.count("*").alias("n"), F.percentile(F.col("rms") / F.col("radius"), 0.5).alias("value")).filter(F.col("n") >= TURNS)
    return [_of(bouts, "climb.selectivity", F.first(100 * F.col("kept") / F.col("n"))), _of(round_, "climb.circle_smoothness", F.first("value"))]


def sinking(tracks: DataFrame, climbs: DataFrame, phases: DataFrame, starts: DataFrame, bands: DataFrame, grid: DataFrame) -> list[DataFrame]:
    began = starts.filter("start_t is not null")
    # height gained outside climbs, smoothed over the seconds about each fix
    race = tracks.join(began.select(*WHO, "start_t", "takeoff", "landing"), WHO).filter("t >= start_t and fix_index between takeoff and landing")
    about = W.partitionBy(*WHO).orderBy(F.col("t").cast("long")).rangeBetween(-ABOUT, ABOUT)
    by = W.partitionBy(*WHO).orderBy("fix_index")
    held = climbs.select(*WHO, "first", "last")
    inside = race.select(*WHO, "fix_index").join(held, WHO).filter(F.col("fix_index").between(F.col("first"), F.col("last"))).select(*WHO, "fix_index").distinct().withColumn("inside", F.lit(True))
    smooth = race.withColumn("smooth", F.avg("alt").over(about)).join(inside, [*WHO, "fix_index"], "left")
    steps = smooth.withColumns({"rise": F.lead("smooth").over(by) - F.col("smooth"), "climbs": F.coalesce("inside", F.lead("inside").over(by), F.lit(False))}).filter("rise > 0")
    gained = steps.groupBy(*WHO).agg(F.sum("rise").alias("all"), F.sum(F.when(~F.col("climbs"), F.col("rise")).otherwise(0.0)).alias("out")).filter(F.col("all") >= GAINED)
    # the lowest fix between two climbs of the race
    after = climbs.join(began.select(*WHO, F.col("start_t").alias("_since")), WHO).filter(F.col("start_t") >= F.col("_since"))
    between = after.withColumn("until", F.lead("first").over(W.partitionBy(*WHO).orderBy("first"))).filter("until > last").select(*WHO, "climb", "last", "until", "end_alt")
    low = tracks.join(between, WHO).filter(F.col("fix_index").between(F.col("last"), F.col("until"))).groupBy(*WHO, "climb", "end_alt").agg(F.min("alt").alias("low"))
    floors = low.filter(F.col("end_alt") - F.col("low") >= DESCENT).join(bands.filter("hi > lo"), "task").withColumn("share", 100 * (F.col("low") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    floor = floors.groupBy(*WHO).agg(F.count("*").alias("n"), F.percentile("share", 0.5).alias("value")).filter(F.col("n") >= DESCENTS)
    # phases cut to the race
    window = began.select(*WHO, F.col("start_t").alias("a"), F.coalesce("ess_t", "land_t").alias("b")).filter("b > a")
    cut = phases.join(window, WHO).withColumn("seconds", F.least("end_t", "b") - F.greatest("start_t", "a")).filter("seconds > 0")
    spent = cut.groupBy(*WHO).agg(F.sum("seconds").alias("all"), F.sum(F.when(F.col("phase") == "search", F.col("seconds")).otherwise(0.0)).alias("search"))
    air = smoothed_share(grid, WHO, "t", "rate", SMOOTHED, NO_SINK)
    return [
        _of(gained, "glide.dolphin_fraction", F.first(100 * F.col("out") / F.col("all"))),
        _of(floor, "decision.altitude_floor", F.first("value")),
        _of(spent, "decision.search_fraction", F.first(100 * F.col("search") / F.col("all"))),
        _of(air, "day.airtime_quality", F.first("pct")),
    ]


def leaving(frames: DataFrame, reached: DataFrame) -> list[DataFrame]:
    """How often a pilot who leaves a gaggle that goes on is at the next turnpoint before the median of those who stay."""
    of = ["task", "episode"]
    sizes = frames.groupBy(*of, "t").agg(F.count("*").alias("members"))
    ahead = W.partitionBy(*of).orderBy("t").rowsBetween(1, W.unboundedFollowing)
    line = sizes.withColumns({"fewest": F.min("members").over(ahead), "ends": F.max("t").over(W.partitionBy(*of)), "next_t": F.lead("t").over(W.partitionBy(*of).orderBy("t"))})
    left = frames.groupBy(*of, "pilot").agg(F.max("t").alias("t")).join(line, [*of, "t"]).filter((F.col("ends") - F.col("t") >= GOES_ON) & (F.col("fewest") >= STAY))
    ordered = reached.select("task", "pilot", "tp", F.col("t").alias("at"))
    next_ = left.join(ordered, WHO).filter("at > t").groupBy(*of, "pilot", "t", "next_t").agg(F.min(F.struct("at", "tp")).alias("n"))
    # who is there both now and in the next frame
    stays = frames.select(*of, F.col("pilot").alias("other"), "t")
    both = stays.join(line.select(*of, "t", "next_t"), [*of, "t"]).join(stays.select(*of, "other", F.col("t").alias("next_t")), [*of, "other", "next_t"], "left_semi")
    others = next_.join(both.select(*of, "other", "t"), [*of, "t"]).filter("other != pilot")
    came = ordered.select("task", F.col("pilot").alias("other"), F.col("tp").alias("their_tp"), F.col("at").alias("theirs"))
    compared = others.join(came, ["task", "other"]).filter("their_tp = n.tp and theirs > t")
    each = compared.groupBy(*of, "pilot", "t", F.col("n.at").alias("mine")).agg(F.count("*").alias("k"), F.percentile("theirs", 0.5).alias("usual")).filter(F.col("k") >= COMPARED)
    return [_of(each, "gaggle.departure_winrate", 100 * F.avg((F.col("mine") < F.col("usual")).cast("double")))]


def coming_in(climbs: DataFrame, starts: DataFrame, goals: DataFrame, scoring: str) -> list[DataFrame]:
    home = starts.filter("ess_t is not null").join(goals, "task")
    margin = F.col("ess_alt") - F.col("goal_alt") - F.col("ess_to_goal") / GLIDE[scoring]
    race = climbs.join(starts.filter("start_t is not null").select(*WHO, F.col("start_t").alias("a"), F.coalesce("ess_t", "land_t").alias("b")), WHO).filter("end_t >= a and (b is null or end_t <= b)")
    last = race.groupBy(*WHO).agg(F.max(F.struct("end_t", "end_alt", "to_goal")).alias("c")).join(goals, "task")
    height = F.col("c.end_alt") - F.col("goal_alt")
    final = last.filter((F.col("c.to_goal") <= REACH_OF_LEG * F.col("last_leg")) & (height > 0))
    return [_of(home, "race.ess_margin", F.first(margin)), _of(final, "race.final_glide_init", F.first(F.col("c.to_goal") / height))]


def field_habits(tracks, climbs, rings, turns, phases, starts, bands, goals, grid, frames, reached, scoring: str = "PG") -> DataFrame:
    """(task, pilot, metric, value): every metric of METRICS that is defined for a pilot."""
    parts = [*centring(tracks, climbs), *turning(climbs, rings, turns, starts), *sinking(tracks, climbs, phases, starts, bands, grid), *leaving(frames, reached), *coming_in(climbs, starts, goals, scoring)]
    return reduce(DataFrame.unionByName, parts)


def winds(drift: DataFrame, ground: DataFrame, of: list[str]) -> DataFrame:
    """(of, speed, direction, method): a turn's wind by the drift of its centre, or else by its ground speed."""
    better = drift.select(*of, "speed", "direction", F.lit("drift").alias("method"))
    other = ground.join(drift.select(*of), of, "left_anti").select(*of, "speed", "direction", F.lit("ground").alias("method"))
    return better.unionByName(other)
