"""Circles: the circle that fits a turn's fixes, and the wind that a turn and its successor show.

tracks: (keys, fix_index, t, lat, lon); turns: (keys, segment, circle, first, last), full turns as
`detectors.circling` gives them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import bearing, ellipsoid_metres

# Metres of a degree in these small frames, least difference of ground speeds and greatest wind that count, metres a second.
DEGREE, LEAST_CHANGE, MOST_WIND = 111_320.0, 2.0, 30.0


def _on(tracks: DataFrame, turns: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """The fixes of each turn; a track has some hundred turns."""
    spans = turns.select(*keys, "segment", "circle", "first", "last")
    return tracks.select(*keys, "fix_index", *columns).join(spans, keys).filter(F.col("fix_index").between(F.col("first"), F.col("last")))


def fits(tracks: DataFrame, turns: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, segment, circle, first, last, centre_lat, centre_lon, radius, rms): the circle of least squares in its algebraic form, by sums alone.

    A circle's centre solves two linear equations of the second and third moments about the fixes' mean. Turns whose
    moments settle no centre, or of fewer than three fixes, have no row.
    """
    of = [*keys, "segment", "circle", "first", "last"]
    on = _on(tracks, turns, keys, "lat", "lon")
    middle = on.groupBy(*of).agg(F.avg("lat").alias("lat0"), F.avg("lon").alias("lon0"))
    east = DEGREE * F.cos(F.radians("lat0"))
    local = on.join(middle, of).withColumns({"u": (F.col("lat") - F.col("lat0")) * DEGREE, "v": (F.col("lon") - F.col("lon0")) * east})
    total = lambda *c: F.sum(_product(c)).alias("s" + "".join(c))
    sums = local.groupBy(*of, "lat0", "lon0").agg(F.count("*").alias("n"), *(total(*c) for c in ("uu", "vv", "uv", "uuu", "vvv", "uvv", "vuu")))
    det = F.col("suu") * F.col("svv") - F.col("suv") * F.col("suv")
    a, b = F.col("suuu") + F.col("suvv"), F.col("svvv") + F.col("svuu")
    solved = sums.filter((F.col("n") >= 3) & (F.abs(det) >= 1e-10)).withColumns({"cu": (F.col("svv") * a - F.col("suv") * b) / (2 * det), "cv": (F.col("suu") * b - F.col("suv") * a) / (2 * det)})
    round_ = solved.withColumn("radius", F.sqrt(F.col("cu") * F.col("cu") + F.col("cv") * F.col("cv") + (F.col("suu") + F.col("svv")) / F.col("n")))
    off = F.hypot(F.col("u") - F.col("cu"), F.col("v") - F.col("cv")) - F.col("radius")
    errors = local.join(round_.select(*of, "cu", "cv", "radius"), of).groupBy(*of).agg(F.sqrt(F.avg(off * off)).alias("rms"))
    placed = round_.select(*of, (F.col("lat0") + F.col("cu") / DEGREE).alias("centre_lat"), (F.col("lon0") + F.col("cv") / east).alias("centre_lon"), "radius")
    return placed.join(errors, of)


def _product(names) -> Column:
    out = F.col(names[0])
    for n in names[1:]:
        out = out * F.col(n)
    return out


def ground_winds(tracks: DataFrame, turns: DataFrame, keys: list[str], least: float = LEAST_CHANGE, most: float = MOST_WIND) -> DataFrame:
    """(keys, segment, circle, speed, direction it blows from) of turns whose ground speed tells it: half the difference of the fastest and slowest step, against the fastest step's heading."""
    by = W.partitionBy(*keys, "segment", "circle").orderBy("fix_index")
    on = _on(tracks, turns, keys, "t", "lat", "lon").withColumns({"t1": F.lead("t").over(by), "lat1": F.lead("lat").over(by), "lon1": F.lead("lon").over(by)})
    steps = on.filter("t1 > t").withColumn("speed", ellipsoid_metres("lat", "lon", "lat1", "lon1") / (F.col("t1") - F.col("t")))
    fastest = F.max(F.struct("speed", (-F.col("fix_index")).alias("i"), "lat", "lon", "lat1", "lon1")).alias("fast")
    found = steps.groupBy(*keys, "segment", "circle").agg(fastest, F.min("speed").alias("slow"))
    change = F.col("fast.speed") - F.col("slow")
    heading = bearing(F.col("fast.lat"), F.col("fast.lon"), F.col("fast.lat1"), F.col("fast.lon1"))
    told = found.filter((change >= least) & (change / 2 <= most))
    return told.select(*keys, "segment", "circle", (change / 2).alias("speed"), F.pmod(heading + 180, F.lit(360.0)).alias("direction"))


def drift_winds(fitted: DataFrame, tracks: DataFrame, keys: list[str], most: float = MOST_WIND) -> DataFrame:
    """(keys, segment, circle, speed, direction it blows from): how far a turn's centre lies from that of the turn before it in its segment, over the time between their middles."""
    time = lambda name: tracks.select(*keys, F.col("fix_index").alias(name), F.col("t").cast("double").alias(f"t_{name}"))
    timed = fitted.join(time("first"), [*keys, "first"]).join(time("last"), [*keys, "last"]).withColumn("mid", (F.col("t_first") + F.col("t_last")) / 2)
    by = W.partitionBy(*keys, "segment").orderBy("circle")
    pairs = timed.withColumns({c + "0": F.lag(c).over(by) for c in ("centre_lat", "centre_lon", "mid")})
    north = (F.col("centre_lat") - F.col("centre_lat0")) * DEGREE
    east = (F.col("centre_lon") - F.col("centre_lon0")) * DEGREE * F.cos(F.radians((F.col("centre_lat") + F.col("centre_lat0")) / 2))
    drift = pairs.filter("mid > mid0").select(*keys, "segment", "circle", (F.sqrt(north * north + east * east) / (F.col("mid") - F.col("mid0"))).alias("speed"), F.pmod(F.degrees(F.atan2(east, north)) + 180, F.lit(360.0)).alias("direction"))
    return drift.filter(F.col("speed") <= most)
