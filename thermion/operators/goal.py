"""Goal lines: a line across the last leg, a half-disc behind it, and how tracks come through them.

A line stands about its goal's centre, its `radius` to each side, across the course of the last leg. Places are
metres in the line's own frame: `along` past the line, `across` it to the right. Both the line's ends and the
half-disc have the band of every other boundary. A track reaches goal where it crosses the line in the course's
direction, or where it comes into the half-disc.

lines: (task, tp, plat, plon, radius, course radians).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import bearing, east_north, ellipsoid_metres, metres_per_degree
from .routes import optimised

#: Metres by which the line's ends and the half-disc are widened, and from which two points give a course.
BAND, APART = 5.0, 1.0


def goal_lines(points: DataFrame, goals: DataFrame) -> DataFrame:
    """The lines of goals (task, goal: its number) among points (task, tp, plat, plon, radius, ...).

    The course runs from where the shortest way to the goal's centre touches the last turnpoint before it that is
    not the centre itself; where no such point is, from the last centre elsewhere. Without either, or without
    a radius, a task has no line and keeps its cylinder.
    """
    upto = points.join(goals, "task").filter("tp <= goal")
    aim = upto.filter("tp = goal").select("task", F.col("plat").alias("glat"), F.col("plon").alias("glon"), F.col("radius").alias("half"))
    touched = optimised(upto.select("task", "tp", "plat", "plon", F.when(F.col("tp") == F.col("goal"), 0.0).otherwise(F.col("radius")).alias("radius")))
    met = upto.filter("tp < goal").join(touched, ["task", "tp"]).join(aim, "task").withColumn("apart", ellipsoid_metres("lat", "lon", "glat", "glon"))
    elsewhere = (F.col("plat") != F.col("glat")) | (F.col("plon") != F.col("glon"))
    before = met.groupBy("task").agg(
        F.max_by(F.when(F.col("apart") > APART, F.struct("lat", "lon")), F.when(F.col("apart") > APART, F.col("tp"))).alias("route"),
        F.max_by(F.when(elsewhere, F.struct(F.col("plat").alias("lat"), F.col("plon").alias("lon"))), F.when(elsewhere, F.col("tp"))).alias("centre"),
    )
    known = aim.join(before, "task").join(goals, "task").withColumn("since", F.coalesce("route", "centre")).filter("since is not null and half > 0")
    course = F.radians(bearing(F.col("since.lat"), F.col("since.lon"), F.col("glat"), F.col("glon")))
    return known.select("task", F.col("goal").alias("tp"), F.col("glat").alias("plat"), F.col("glon").alias("plon"), F.col("half").alias("radius"), course.alias("course"))


def in_frame(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(along, across) of a place, in a row that has its line."""
    east, north = east_north(lat, lon, F.col("plat"), F.col("plon"))
    x, y = F.sin("course"), F.cos("course")
    return east * x + north * y, east * y - north * x


def line_crossings(tracks: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """(task, keys, tp, way, inside_first, first, found) of tracks (task, keys, fix_index, t, lat, lon), as `sequence.crossings` gives them.

    Through the line: at the track's own intersection with it, `credited` if only the band makes it one. Such a
    crossing enters or leaves the half-disc; one that does neither enters and leaves at once if it goes with
    the course, and is none if it goes against it. Through the arc: where the segment meets it, `credited`.
    """
    along, across = in_frame(F.col("lat"), F.col("lon"))
    at = W.partitionBy("task", *keys, "tp").orderBy("fix_index")
    edge = F.col("radius") + BAND
    placed = tracks.join(lines, "task").withColumns({"along": along, "across": across})
    inside = placed.withColumn("inside", (F.col("along") > 0) & (F.col("along") * F.col("along") + F.col("across") * F.col("across") <= edge * edge))
    steps = inside.withColumns({"was": F.lag("inside").over(at), "along0": F.lag("along").over(at), "across0": F.lag("across").over(at), "t0": F.lag("t").over(at)})
    # the line: where `along` passes zero
    sides = (F.col("along") != F.col("along0")) & (((F.col("along0") > 0) != (F.col("along") > 0)) | (F.col("along0") == 0))
    share = F.when(sides, F.col("along0") / (F.col("along0") - F.col("along")))
    beside = F.abs(F.col("across0") + share * (F.col("across") - F.col("across0")))
    hit = F.coalesce((share >= 0) & (share <= 1) & (beside <= edge), F.lit(False))
    # the arc: the segment in the disc, from its first to its second meeting
    run, side = F.col("along") - F.col("along0"), F.col("across") - F.col("across0")
    a, b, c = run * run + side * side, F.col("along0") * run + F.col("across0") * side, F.col("along0") * F.col("along0") + F.col("across0") * F.col("across0") - edge * edge
    root = F.sqrt(F.greatest(b * b - a * c, F.lit(0.0)))
    arc = F.least(F.greatest(F.when(F.col("inside"), (-b - root) / a).otherwise((-b + root) / a), F.lit(0.0)), F.lit(1.0))
    change = F.coalesce(F.col("was") != F.col("inside"), F.lit(False))
    when = lambda s: F.col("t0") + s * (F.col("t") - F.col("t0"))
    one = lambda s, entered, credited, order: F.struct(when(s).alias("t"), "fix_index", F.lit(order).alias("order"), entered.alias("entered"), credited.alias("credited"))
    past_end = F.coalesce(beside > F.col("radius"), F.lit(False))
    through = F.array(one(share, F.lit(True), past_end, 0), one(share, F.lit(False), past_end, 1))
    found = F.when(hit & change, F.array(one(share, F.col("inside"), past_end, 0))).when(hit & (F.col("along") > F.col("along0")), through).when(~hit & change, F.array(one(arc, F.col("inside"), F.lit(True), 0)))
    seen = steps.withColumn("crossed", found)
    own = F.array_sort(F.flatten(F.collect_list("crossed")))
    return seen.groupBy("task", *keys, "tp", F.lit("enter").alias("way")).agg(
        F.min_by("inside", "fix_index").alias("inside_first"),
        F.min_by(F.struct("t", "fix_index", F.col("inside").alias("within")), "fix_index").alias("first"),
        F.transform(own, lambda x: F.struct(x["t"].alias("t"), x["fix_index"].alias("fix_index"), x["entered"].alias("entered"), x["credited"].alias("credited"))).alias("found"),
    )


def line_metres(lat: str, lon: str) -> Column:
    """Metres on the ellipsoid from a place to its row's line."""
    _, across = in_frame(F.col(lat), F.col(lon))
    held = F.least(F.greatest(across, -F.col("radius")), F.col("radius"))
    north, east = metres_per_degree(F.col("plat"))
    # the line's own direction is the course turned right
    return ellipsoid_metres(F.col(lat), F.col(lon), F.col("plat") - held * F.sin("course") / north, F.col("plon") + held * F.cos("course") / east)
