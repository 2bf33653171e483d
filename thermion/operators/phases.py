"""A flight as climbs, glides and search: every second between take-off and landing belongs to one of them.

Climbs are given. What lies between them is cut into pieces of at most PIECE seconds; a piece that gets on fast enough
and does not touch circling is a glide, any other is search. Neighbours of one kind are one phase.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import ellipsoid_metres

#: Seconds of a piece and metres a second of net speed that make it a glide (fixed values).
PIECE, SPEED = 60.0, 8.0


def gaps(climbs: DataFrame, flights: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(held, between): climbs cut to the flights (keys, takeoff, landing), and what of the flights they leave, both (keys, first, last) in fixes."""
    flown = flights.filter("landing > takeoff")
    within = climbs.select(*keys, "first", "last").join(flown, keys).select(*keys, F.greatest("first", "takeoff").alias("first"), F.least("last", "landing").alias("last"))
    held = within.filter("last > first")
    ends = flown.select(*keys, F.col("landing").alias("first"), F.col("landing").alias("last"))
    by = W.partitionBy(*keys).orderBy("first", "last")
    edges = held.unionByName(ends).withColumn("since", F.lag("last").over(by))
    between = edges.join(flown, keys).select(*keys, F.coalesce("since", "takeoff").alias("first"), F.col("first").alias("last")).filter("last > first")
    return held, between


def pieces(tracks: DataFrame, between: DataFrame, keys: list[str], seconds: float = PIECE) -> DataFrame:
    """(keys, first, last): gaps (keys, first, last) cut at the first fix that lies `seconds` past the last cut."""
    spans = between.select(*keys, F.col("first").alias("gap"), F.col("last").alias("until"))
    inside = tracks.select(*keys, "fix_index", F.col("t").cast("double").alias("t")).join(spans, keys).filter(F.col("fix_index").between(F.col("gap"), F.col("until")))
    fixes = F.array_sort(F.collect_list(F.struct("fix_index", "t")))  # of one gap of one flight
    rows = inside.groupBy(*keys, "gap", "until").agg(fixes.alias("fixes"))
    kind = tracks.schema["fix_index"].dataType.simpleString()
    begin = F.struct(F.col("fixes")[0]["t"].alias("since"), F.array(F.col("fixes")[0]["fix_index"]).cast(f"array<{kind}>").alias("cuts"))

    def step(state, x):
        due = (x["t"] >= state["since"] + seconds) | (x["fix_index"] == F.col("until"))
        return F.when(due, F.struct(x["t"].alias("since"), F.concat(state["cuts"], F.array(x["fix_index"])).alias("cuts"))).otherwise(state)

    cuts = rows.withColumn("cuts", F.aggregate(F.slice("fixes", 2, F.greatest(F.size("fixes") - 1, F.lit(0))), begin, step, lambda s: s["cuts"]))
    pairs = F.transform(F.sequence(F.lit(1), F.size("cuts") - 1), lambda i: F.struct(F.col("cuts")[i - 1].alias("first"), F.col("cuts")[i].alias("last")))
    return cuts.filter(F.size("cuts") > 1).select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.first", "p.last")


def phases(tracks: DataFrame, climbs: DataFrame, circling: DataFrame, flights: DataFrame, keys: list[str], seconds: float = PIECE, speed: float = SPEED) -> DataFrame:
    """(keys, phase, first, last, seconds) of tracks (keys, fix_index, t, lat, lon): climb, glide or search, that share their boundary fixes.

    climbs, circling: (keys, first, last); flights: (keys, takeoff, landing), flights without either have no phases.
    """
    held, between = gaps(climbs, flights, keys)
    cut = pieces(tracks, between, keys, seconds)
    ends = lambda name: tracks.select(*keys, F.col("fix_index").alias(name), F.col("t").cast("double").alias(f"t_{name}"), F.col("lat").alias(f"lat_{name}"), F.col("lon").alias(f"lon_{name}"))
    placed = cut.join(ends("first"), [*keys, "first"]).join(ends("last"), [*keys, "last"])
    passed = F.col("t_last") - F.col("t_first")
    fast = F.when(passed > 0, ellipsoid_metres("lat_first", "lon_first", "lat_last", "lon_last") / passed).otherwise(0.0) >= speed
    rings = circling.select(*keys, F.col("first").alias("c0"), F.col("last").alias("c1"))
    met = placed.select(*keys, "first", "last").join(rings, keys).filter("c0 < last and c1 > first").select(*keys, "first").distinct()
    kinds = placed.withColumn("fast", fast).join(met.withColumn("rings", F.lit(True)), [*keys, "first"], "left")
    between_ = kinds.select(*keys, "first", "last", F.when(F.col("fast") & F.col("rings").isNull(), "glide").otherwise("search").alias("phase"))
    every = between_.unionByName(held.withColumn("phase", F.lit("climb")))
    by = W.partitionBy(*keys).orderBy("first", "last")
    runs = every.withColumn("new", F.when(F.lag("phase").over(by) == F.col("phase"), 0).otherwise(1)).withColumn("island", F.sum("new").over(by))
    whole = runs.groupBy(*keys, "island", "phase").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    time = lambda name: tracks.select(*keys, F.col("fix_index").alias(name), F.col("t").alias(f"t_{name}"))
    timed = whole.join(time("first"), [*keys, "first"]).join(time("last"), [*keys, "last"])
    return timed.select(*keys, "phase", "first", "last", (F.col("t_last") - F.col("t_first")).alias("seconds"))
