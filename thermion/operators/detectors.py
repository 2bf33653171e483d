"""Flight events in tracks: take-off, landing, climbs, glides and circling (boundary crossings: sequence.py).

All of them are windows, islands of like rows, and folds over the few islands of a track: nothing runs
row by row in Python. Tracks: (keys, fix_index, t seconds, lat, lon, alt).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import bearing, ellipsoid_metres

# Fixed thresholds of the detectors (SI units).
CLIMB_RATE, CLIMB_WINDOW, CLIMB_LEAST, CLIMB_GAP, CLIMB_LOW = 0.5, 10, 20.0, 20.0, 3
GLIDE_LEAST, GLIDE_ROWS, SINK_RATIO = 30.0, 10, 5.0
TURN_RATE, TURN_MOST, TURN_BACK, TURN_IN, TURN_OUT, CIRCLE_FIXES = 4.0, 50.0, 5.0, 8.0, 15.0, 8
TAKEOFF_SPEED, TAKEOFF_GAIN, TAKEOFF_CLIMB, TAKEOFF_WINDOW, TAKEOFF_FIXES = 5.0, 50.0, 1.0, 10, 10
LANDING_WINDOW, LANDING_SPEED, LANDING_SINK = 30, 2.5, -0.5


def climbs(tracks: DataFrame, keys: list[str], rate: float = CLIMB_RATE, window: int = CLIMB_WINDOW, least: float = CLIMB_LEAST, gap: float = CLIMB_GAP) -> DataFrame:
    """(keys, climb, first, last, start_t, end_t, gain, rate) of each track's climbs.

    A fix is high if the rate over the `window` rows before it is above `rate`. High fixes with fewer than
    CLIMB_LOW others between them are one bout, which ends at its last high fix (at the track's end, if
    that comes before so many others). A climb begins `window` rows before the bout's first high fix that
    lies `gap` seconds past the last climb that was kept, and is kept if it lasts `least` seconds. Which
    climbs are kept is a fold over a track's bouts.
    """
    at = W.partitionBy(*keys).orderBy("fix_index")
    back = lambda c: F.lag(c, window).over(at)
    dt = F.col("t") - back("t")
    row = F.row_number().over(at).alias("row")
    fixes = tracks.select(*keys, "fix_index", "t", "alt", row, back("fix_index").alias("i0"), back("t").alias("t0"), back("alt").alias("a0"), F.coalesce(F.when(dt > 0, (F.col("alt") - back("alt")) / dt), F.lit(0.0)).alias("passed"))
    ends = tracks.groupBy(*keys).agg(F.max("fix_index").alias("end_i"), F.max_by("t", "fix_index").alias("end_t"), F.max_by("alt", "fix_index").alias("end_a"), F.count("*").alias("rows"))
    high = fixes.filter((F.col("passed") > rate) & F.col("i0").isNotNull())
    fresh = F.coalesce(F.col("row") - F.lag("row").over(at) > CLIMB_LOW, F.lit(True)).cast("int")
    bouts = high.withColumn("fresh", fresh).withColumn("bout", F.sum("fresh").over(at))
    entry = F.struct(F.col("i0").alias("i"), F.col("t0").alias("t"), F.col("a0").alias("a"))
    last = F.max(F.struct("row", F.col("fix_index").alias("i"), "t", F.col("alt").alias("a"))).alias("last")
    grouped = bouts.groupBy(*keys, "bout").agg(F.array_sort(F.collect_list(entry)).alias("entries"), last).join(ends, keys)
    to_end = F.col("rows") - F.col("last.row") < CLIMB_LOW
    stop = F.when(to_end, F.struct(F.col("end_i").alias("i"), F.col("end_t").alias("t"), F.col("end_a").alias("a"))).otherwise(F.struct("last.i", "last.t", "last.a"))
    of_track = grouped.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bout", "entries", stop.alias("stop")))).alias("bouts"))
    kind = tracks.schema
    found = f"array<struct<first:{kind['fix_index'].dataType.simpleString()},last:{kind['fix_index'].dataType.simpleString()},start_t:double,end_t:double,gain:double>>"
    begin = F.struct(F.lit(float("-inf")).alias("free"), F.lit(None).cast(kind["fix_index"].dataType).alias("end"), F.expr(f"cast(array() as {found})").alias("out"))

    def add(state: Column, b: Column) -> Column:
        open_ = F.get(F.filter(b["entries"], lambda e: (e["t"] >= state["free"] + gap) & (state["end"].isNull() | (e["i"] > state["end"]))), 0)
        kept = open_.isNotNull() & (b["stop"]["t"] - open_["t"] >= least)
        row = F.struct(open_["i"].alias("first"), b["stop"]["i"].alias("last"), open_["t"].cast("double").alias("start_t"), b["stop"]["t"].cast("double").alias("end_t"), (b["stop"]["a"] - open_["a"]).cast("double").alias("gain"))
        return F.when(kept, F.struct(b["stop"]["t"].cast("double").alias("free"), b["stop"]["i"].alias("end"), F.concat(state["out"], F.array(row)).alias("out"))).otherwise(state)

    out = of_track.select(*keys, F.posexplode(F.aggregate("bouts", begin, add, lambda s: s["out"])).alias("climb", "c"))
    return out.select(*keys, (F.col("climb") + 1).alias("climb"), F.col("c.first").cast("long").alias("first"), F.col("c.last").cast("long").alias("last"), "c.start_t", "c.end_t", "c.gain", (F.col("c.gain") / (F.col("c.end_t") - F.col("c.start_t"))).alias("rate"))


def glides(tracks: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, first, last, seconds, metres, lost, ratio, sinks) between climbs, and before and after them: more than 10 rows and 30 s."""
    ends = tracks.groupBy(*keys).agg(F.min("fix_index").alias("lo"), F.max("fix_index").alias("hi"))
    w = W.partitionBy(*keys).orderBy("first")
    edges = found.select(*keys, F.col("first").cast("long"), F.col("last").cast("long")).unionByName(ends.select(*keys, (F.col("hi")).alias("first"), F.col("hi").alias("last")))
    gaps = edges.join(ends, keys).select(*keys, F.coalesce(F.lag("last").over(w), F.col("lo")).alias("first"), F.col("first").alias("last")).filter(F.col("last") - F.col("first") > GLIDE_ROWS)
    at = W.partitionBy(*keys).orderBy("fix_index")
    steps = tracks.withColumn("step", F.coalesce(ellipsoid_metres(F.lag("lat").over(at), F.lag("lon").over(at), F.col("lat"), F.col("lon")), F.lit(0.0)))
    along = steps.withColumn("along", F.sum("step").over(at.rowsBetween(W.unboundedPreceding, 0))).select(*keys, "fix_index", "t", "alt", "along")
    a, b = (along.select(*keys, F.col("fix_index").alias(i), F.col("t").alias(f"t{i}"), F.col("alt").alias(f"a{i}"), F.col("along").alias(f"d{i}")) for i in ("first", "last"))
    ran = gaps.join(a, [*keys, "first"]).join(b, [*keys, "last"])
    lost, far = F.col("afirst") - F.col("alast"), F.col("dlast") - F.col("dfirst")
    ratio = F.when(lost > 0, far / lost)
    out = ran.select(*keys, "first", "last", (F.col("tlast") - F.col("tfirst")).alias("seconds"), far.alias("metres"), lost.alias("lost"), ratio.alias("ratio"), F.coalesce(ratio <= SINK_RATIO, F.lit(False)).alias("sinks"))
    return out.filter(F.col("seconds") > GLIDE_LEAST)


def _turned(to: Column, since: Column) -> Column:
    """Degrees from one heading to another, -180 to 180."""
    return F.pmod(to - since + 180, F.lit(360.0)) - 180


def circling(tracks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, segment, circle, first, last, seconds, turn_rate): segments of circling, and their full turns (circle 0: the segment itself).

    Runs of turning and of straight fixes are islands. A run of turning that lasts TURN_IN seconds begins a
    segment; the next straight run that lasts TURN_OUT seconds ends it, at the fix that completes them, or
    else the track's end does. turn_rate: mean of the segment's turning fixes, degrees a second.
    """
    at = W.partitionBy(*keys).orderBy("fix_index")
    kind = tracks.schema["fix_index"].dataType.simpleString()
    headed = tracks.select(*keys, "fix_index", F.col("t").cast("double").alias("t"), F.when(F.lag("lat").over(at).isNotNull(), bearing(F.lag("lat").over(at), F.lag("lon").over(at), F.col("lat"), F.col("lon"))).alias("heading"))
    earlier = W.partitionBy(*keys).orderBy((F.col("t") * 1000).cast("long")).rangeBetween(W.unboundedPreceding, int(-TURN_BACK * 1000))
    seen = headed.withColumn("before", F.last(F.struct("t", "heading")).over(earlier))
    dt = F.col("t") - F.col("before.t")
    rate = F.when((dt >= 1) & F.col("before.heading").isNotNull(), _turned(F.col("heading"), F.col("before.heading")) / dt)
    # a fix without a rate turns at none: least and greatest would pass over the null
    held = F.when(rate.isNotNull(), F.greatest(F.least(rate, F.lit(TURN_MOST)), F.lit(-TURN_MOST))).otherwise(0.0)
    rated = seen.withColumn("rate", held).withColumn("turning", F.abs("rate") >= TURN_RATE)
    marked = rated.withColumn("new", F.coalesce(F.lag("turning").over(at) != F.col("turning"), F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(at))
    timed = marked.withColumn("since", F.col("t") - F.min("t").over(W.partitionBy(*keys, "run")))
    done = F.min(F.when(F.col("since") >= F.when(F.col("turning"), TURN_IN).otherwise(TURN_OUT), F.col("fix_index")))
    runs = timed.groupBy(*keys, "run", "turning").agg(F.min("fix_index").alias("first"), F.max("fix_index").alias("last"), done.alias("done"))
    straight = (~F.col("turning") & F.col("done").isNotNull()).cast("int")
    # between two long straight runs lies at most one segment
    dealt = runs.withColumn("straight", straight).withColumn("between", F.sum("straight").over(W.partitionBy(*keys).orderBy("run")) - F.col("straight"))
    spans = dealt.groupBy(*keys, "between").agg(F.min(F.when(F.col("turning") & F.col("done").isNotNull(), F.col("first"))).alias("first"), F.coalesce(F.max(F.when(F.col("straight") == 1, F.col("done"))), F.max("last")).alias("last")).filter("first is not null")
    segments = spans.withColumn("segment", F.row_number().over(W.partitionBy(*keys).orderBy("between"))).select(*keys, "segment", "first", "last")
    delta = F.when(F.lag("heading").over(at).isNotNull(), _turned(F.col("heading"), F.lag("heading").over(at)))
    steps = timed.select(*keys, "fix_index", "t", "rate", "turning", F.coalesce(delta, F.lit(0.0)).alias("delta"))
    inside = steps.join(segments, keys).filter(F.col("fix_index").between(F.col("first"), F.col("last")))  # a track has a few segments
    agg = inside.groupBy(*keys, "segment", "first", "last").agg((F.max("t") - F.min("t")).alias("seconds"), F.avg(F.when(F.col("turning"), F.col("rate"))).alias("turn_rate"), F.array_sort(F.collect_list(F.struct("fix_index", "delta", "t"))).alias("fixes"))
    turns = f"array<struct<circle:int,first:{kind},last:{kind},seconds:double,turn_rate:double>>"
    first = F.col("fixes")[0]
    begin = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(0.0).alias("turned"), first["fix_index"].alias("start"), first["t"].alias("since"), F.expr(f"cast(array() as {turns})").alias("out"))

    def add(state: Column, x: Column) -> Column:
        # what a turn has over 360 degrees counts for the next
        total, n, turned, passed = state["sum"] + x["delta"], state["n"] + 1, state["turned"] + x["delta"], x["t"] - state["since"]
        circle = F.struct((F.size(state["out"]) + 1).alias("circle"), state["start"].alias("first"), x["fix_index"].alias("last"), passed.alias("seconds"), F.when(passed > 0, turned / passed).alias("turn_rate"))
        out = F.when(n >= CIRCLE_FIXES, F.concat(state["out"], F.array(circle))).otherwise(state["out"])
        full = F.struct((total - F.signum(total) * 360).alias("sum"), F.lit(0).alias("n"), F.lit(0.0).alias("turned"), x["fix_index"].alias("start"), x["t"].alias("since"), out.alias("out"))
        return F.when(F.abs(total) >= 360, full).otherwise(F.struct(total.alias("sum"), n.alias("n"), turned.alias("turned"), state["start"].alias("start"), state["since"].alias("since"), state["out"].alias("out")))

    whole = F.array(F.struct(F.lit(0).alias("circle"), "first", "last", "seconds", "turn_rate"))
    rest = F.slice("fixes", 2, F.greatest(F.size("fixes") - 1, F.lit(0)))
    out = agg.filter("seconds > 0").select(*keys, "segment", F.explode(F.concat(whole, F.aggregate(rest, begin, add, lambda s: s["out"]))).alias("c"))
    return out.select(*keys, "segment", "c.circle", F.col("c.first").cast("long").alias("first"), F.col("c.last").cast("long").alias("last"), "c.seconds", "c.turn_rate")


def takeoff_and_landing(tracks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, takeoff, landing): the fixes from and to which a track flies (null where it never does, or has fewer than TAKEOFF_FIXES), by windows alone.

    Take-off: the first fix that is fast, TAKEOFF_GAIN above the mean of the first fixes, or climbing over five
    rows, if the TAKEOFF_WINDOW seconds from there bear it out: that gain, a climb, or two fast steps in
    a row that also lead away. Landing: the last fix whose LANDING_WINDOW seconds before it hold a step of half
    that speed, or a descent.
    """
    at = W.partitionBy(*keys).orderBy("fix_index")
    by_time = W.partitionBy(*keys).orderBy("ms")
    speed = lambda k: F.coalesce(F.when(F.col("ms") > F.lag("ms", k).over(at), ellipsoid_metres(F.lag("lat", k).over(at), F.lag("lon", k).over(at), F.col("lat"), F.col("lon")) / (F.col("ms") - F.lag("ms", k).over(at)) * 1000), F.lit(0.0))
    shown = tracks.select(*keys, "fix_index", (F.col("t") * 1000).cast("long").alias("ms"), "lat", "lon", F.col("alt").cast("double").alias("alt"))
    numbered = shown.select("*", F.row_number().over(at).alias("row"), speed(1).alias("v1"), speed(2).alias("v2"), F.coalesce(F.lag("alt", 5).over(at), F.first("alt").over(at)).alias("a5"), F.coalesce(F.lag("ms", 5).over(at), F.first("ms").over(at)).alias("m5"))
    ground = numbered.filter(F.col("row") <= TAKEOFF_FIXES).groupBy(*keys).agg(F.avg("alt").alias("ground"))
    rows = W.partitionBy(*keys)
    # a row's own two steps back are fast and lead away: filed under the fix they begin at
    leads = (F.col("v1") > TAKEOFF_SPEED) & (F.lag("v1").over(at) > TAKEOFF_SPEED) & (F.col("v2") > TAKEOFF_SPEED)
    marked = numbered.withColumn("leads", leads).withColumn("leads_to", F.when(F.lead("leads", 2).over(at), F.lead("ms", 2).over(at)))
    end = F.first(F.struct("ms", "alt")).over(by_time.rangeBetween(TAKEOFF_WINDOW * 1000, W.unboundedFollowing))
    begin = F.last(F.struct("ms", "alt")).over(by_time.rangeBetween(W.unboundedPreceding, -LANDING_WINDOW * 1000))
    seen = marked.select(
        "*",
        end.alias("end"),
        begin.alias("begin"),
        F.min("leads_to").over(by_time.rangeBetween(0, TAKEOFF_WINDOW * 1000)).alias("leads_by"),
        F.max("v1").over(by_time.rangeBetween(-LANDING_WINDOW * 1000 + 1, 0)).alias("fastest"),
        F.count("*").over(rows).alias("rows"),
    ).join(ground, keys)
    climbing = lambda up, ms, least: F.coalesce((ms > 0) & (up / ms * 1000 > least), F.lit(False))
    off = (F.col("v1") > TAKEOFF_SPEED) | (F.col("alt") - F.col("ground") > TAKEOFF_GAIN) | climbing(F.col("alt") - F.col("a5"), F.col("ms") - F.col("m5"), TAKEOFF_CLIMB)
    borne_out = (F.col("end.alt") - F.col("ground") > TAKEOFF_GAIN) | climbing(F.col("end.alt") - F.col("alt"), F.col("end.ms") - F.col("ms"), TAKEOFF_CLIMB) | F.coalesce(F.col("leads_by") <= F.col("end.ms"), F.lit(False))
    enough = F.col("rows") >= TAKEOFF_FIXES
    takes_off = enough & (F.col("row") > 1) & F.col("end").isNotNull() & off & borne_out
    sinks = (F.col("alt") - F.col("begin.alt")) / (F.col("ms") - F.col("begin.ms")) * 1000 < LANDING_SINK
    flies = enough & F.col("row").between(2, F.col("rows") - 1) & F.col("begin").isNotNull() & ((F.col("fastest") > LANDING_SPEED) | sinks)
    return seen.groupBy(*keys).agg(F.min(F.when(takes_off, F.col("fix_index"))).alias("takeoff"), F.max(F.when(flies, F.col("fix_index"))).alias("landing"))


def clean_altitude(pressure: Column, gnss: Column, cleaned: Column | None = None) -> Column:
    """The altitude to use: a repaired one, else satellite altitude, else (0: missing) pressure altitude."""
    usual = F.when(gnss != 0, gnss).otherwise(pressure)
    return usual if cleaned is None else F.coalesce(cleaned, usual)
