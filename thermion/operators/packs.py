"""Track packs: a field's tracks as one run of 32-bit numbers a task, with a manifest, for drawing.

A vertex is four numbers: metres east of the field's origin, up from its lowest fix, south, and seconds from its first.
A pilot's vertices are one row, so a task is never whole in one place; offsets say where they lie in the task's run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import metres_per_degree

#: Numbers of a vertex.
FLOATS = 4


def manifests(tracks: DataFrame, task: str, pilot: str) -> DataFrame:
    """(task, lat0, lon0, alt0, m_lat, m_lon, t0, t1, vertices, alt_max) of tracks (task, pilot, fix_index, t, lat, lon, alt): the origin is the mean of the pilots' first fixes, and as low as the lowest."""
    each = tracks.groupBy(task, pilot).agg(F.min_by(F.struct("lat", "lon"), "fix_index").alias("first"), F.min("alt").alias("low"), F.max("alt").alias("high"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.count("*").alias("n"))
    whole = each.groupBy(task).agg(F.avg("first.lat").alias("lat0"), F.avg("first.lon").alias("lon0"), F.min("low").alias("alt0"), F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.sum("n").alias("vertices"), (F.max("high") - F.min("low")).alias("alt_max"))
    north, east = metres_per_degree(F.col("lat0"))
    return whole.withColumns({"m_lat": north, "m_lon": east})


def packed(tracks: DataFrame, task: str, pilot: str) -> DataFrame:
    """(task, pilot, vertex_offset, vertex_count, data array<float>): each pilot's vertices, in the order of pilots."""
    known = tracks.join(manifests(tracks, task, pilot), task)
    x, y, z, t = ((F.col("lon") - F.col("lon0")) * F.col("m_lon"), F.col("alt") - F.col("alt0"), (F.col("lat0") - F.col("lat")) * F.col("m_lat"), F.col("t") - F.col("t0"))
    vertex = F.struct("fix_index", F.array(*[c.cast("float") for c in (x, y, z, t)]).alias("v"))
    rows = known.groupBy(task, pilot).agg(F.array_sort(F.collect_list(vertex)).alias("all"))  # of one flight
    counted = rows.select(task, pilot, F.size("all").cast("long").alias("vertex_count"), F.flatten(F.transform("all", lambda v: v["v"])).alias("data"))
    before = W.partitionBy(task).orderBy(pilot).rowsBetween(W.unboundedPreceding, -1)  # a field: some hundred pilots
    offsets = counted.select(task, pilot, F.coalesce(F.sum("vertex_count").over(before), F.lit(0)).alias("vertex_offset"))
    return counted.join(offsets, [task, pilot]).select(task, pilot, "vertex_offset", "vertex_count", "data")


def write_pack(tracks: DataFrame, path: str, task: str, pilot: str) -> None:
    """Vertices in folders a task and the manifests beside them, written by the executors; `path` is overwritten."""
    packed(tracks, task, pilot).write.mode("overwrite").partitionBy(task).parquet(f"{path}/vertices")
    manifests(tracks, task, pilot).write.mode("overwrite").json(f"{path}/manifest")


def read_pack(spark: SparkSession, path: str, task: str, pilot: str) -> DataFrame:
    """(task, pilot, fix, t, lat, lon, alt) of a written pack, as near as 32 bits hold them."""
    rows = spark.read.parquet(f"{path}/vertices").join(spark.read.json(f"{path}/manifest"), task)
    each = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("vertex_count") - 1)).alias("fix"))
    v = lambda i: F.get("data", (F.col("fix") * FLOATS + i).cast("int")).cast("double")
    return each.select(task, pilot, F.col("fix").cast("long").alias("fix"), (F.col("t0") + v(3)).alias("t"), (F.col("lat0") - v(2) / F.col("m_lat")).alias("lat"), (F.col("lon0") + v(0) / F.col("m_lon")).alias("lon"), (F.col("alt0") + v(1)).alias("alt"))
