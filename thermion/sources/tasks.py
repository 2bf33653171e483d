"""Task definitions: JSON, whole or compact, and declarations of tracklogs, read into turnpoints, written back, and checked."""

from __future__ import annotations

import base64
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import ellipsoid_metres

#: Degrees of the cells by which declared points meet waypoints: more than the reach of such a match, up to 80 degrees of latitude.
CELL = 0.005

SCHEMA = """taskType string, version int, earthModel string,
turnpoints array<struct<type: string, radius: double, waypoint: struct<name: string, description: string, lat: double, lon: double, altSmoothed: double>>>,
sss struct<type: string, direction: string, timeGates: array<string>>, goal struct<type: string, deadline: string>, takeoff struct<timeOpen: string, timeClose: string>"""


#: The compact form: one letter a name, a turnpoint's place and size in one string.
COMPACT = """taskType string, e int, t array<struct<z: string, n: string, t: string, y: string, lat: double, lon: double, r: double>>,
s struct<t: int, d: int, g: array<string>>, g struct<t: int, d: string, fa: double>, to string, tc string"""
RADIUS = 400.0  # of turnpoints that give none


@F.pandas_udf(T.StringType())
def inflated(text: pd.Series) -> pd.Series:
    """Base-64 text of a deflated one; null where it is none."""

    def one(x: str | None) -> str | None:
        try:
            return zlib.decompress(base64.b64decode(x or "", validate=True)).decode()
        except (ValueError, zlib.error):
            return None

    return text.map(one)


def decoded(z: Column) -> Column:
    """The whole numbers of a delta string: groups of five bits, least first, each but a number's last marked; the lowest bit is the sign."""
    codes = F.transform(F.filter(F.split(z, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long") - 63)
    begin = F.struct(F.lit(0).cast("long").alias("v"), F.lit(0).alias("shift"), F.expr("cast(array() as array<bigint>)").alias("out"))

    def add(s: Column, c: Column) -> Column:
        v = s["v"] + F.call_function("shiftleft", c.bitwiseAND(F.lit(31)), s["shift"])
        number = F.when(v % 2 == 1, -F.shiftright(v, 1) - 1).otherwise(F.shiftright(v, 1))
        more = F.struct(v.alias("v"), (s["shift"] + 5).alias("shift"), s["out"].alias("out"))
        return F.when(c >= 32, more).otherwise(F.struct(F.lit(0).cast("long").alias("v"), F.lit(0).alias("shift"), F.concat(s["out"], F.array(number)).alias("out")))

    return F.aggregate(codes, begin, add, lambda s: s["out"])


def encoded(numbers: Column) -> Column:
    """Whole numbers (an array) as a delta string: what `decoded` reads."""

    def one(x: Column) -> Column:
        v = F.when(x < 0, -2 * x - 1).otherwise(2 * x).cast("long")
        group = lambda i: F.call_function("shiftright", v, 5 * i)
        used = F.filter(F.sequence(F.lit(0), F.lit(12)), lambda i: (i == 0) | (group(i) > 0))
        return F.array_join(F.transform(used, lambda i: F.char(group(i).bitwiseAND(F.lit(31)) + F.when(group(i + 1) > 0, 32).otherwise(0) + 63)), "")

    return F.array_join(F.transform(numbers, one), "")


def _compact(value: Column) -> Column:
    """A compact task as a whole one: places in hundred-thousandths of a degree, types by number or letter."""
    c = F.from_json(value, COMPACT)

    def point(p: Column) -> Column:
        n = decoded(p["z"])
        at = lambda i: F.get(n, F.lit(i))
        kind = F.when((p["t"] == "2") | (p["y"] == "S"), "SSS").when((p["t"] == "3") | (p["y"] == "E"), "ESS").when(p["y"] == "T", "TAKEOFF")
        size = F.coalesce(p["r"], F.when(at(3) > 0, at(3).cast("double")), F.lit(RADIUS))
        place = F.struct(F.coalesce(F.nullif(p["n"], F.lit("")), F.lit("Unnamed")).alias("name"), F.lit(None).cast("string").alias("description"), F.coalesce(p["lat"], at(1) / 1e5, F.lit(0.0)).alias("lat"), F.coalesce(p["lon"], at(0) / 1e5, F.lit(0.0)).alias("lon"), F.nullif(at(2), F.lit(0).cast("long")).cast("double").alias("altSmoothed"))
        return F.struct(kind.alias("type"), size.alias("radius"), place.alias("waypoint"))

    start = F.when(c["s"].isNotNull(), F.struct(F.when(c["s"]["t"] == 1, "RACE").otherwise("ELAPSED-TIME").alias("type"), F.when(c["s"]["d"] == 1, "ENTER").otherwise("EXIT").alias("direction"), c["s"]["g"].alias("timeGates")))
    goal = F.when(c["g"].isNotNull(), F.struct(F.when(c["g"]["t"] == 1, "LINE").otherwise("CYLINDER").alias("type"), c["g"]["d"].alias("deadline")))
    takeoff = F.when(F.coalesce(c["to"], c["tc"]).isNotNull(), F.struct(c["to"].alias("timeOpen"), c["tc"].alias("timeClose")))
    whole = F.struct(F.coalesce(c["taskType"], F.lit("CLASSIC")).alias("taskType"), F.lit(2).alias("version"), F.when(c["e"] == 1, "FAI_SPHERE").otherwise("WGS84").alias("earthModel"), F.transform(c["t"], point).alias("turnpoints"), start.alias("sss"), goal.alias("goal"), takeoff.alias("takeoff"))
    return F.when(c["t"].isNotNull(), whole)


def parsed(text: Column) -> Column:
    """The task of a JSON text, whole or compact, bare or as a QR code's text; null where it is none."""
    trimmed = F.trim(text)
    plain = F.when(trimmed.startswith("XCTSKZ:"), inflated(F.when(trimmed.startswith("XCTSKZ:"), F.substr(trimmed, F.lit(8))))).when(trimmed.startswith("XCTSK:"), F.substr(trimmed, F.lit(7))).otherwise(trimmed)
    short = F.get_json_object(plain, "$.turnpoints").isNull() & F.get_json_object(plain, "$.t").isNotNull()
    return F.when(short, _compact(plain)).otherwise(F.from_json(plain, SCHEMA))


def compacted(task: Column) -> Column:
    """A task as compact JSON text: what `parsed` reads."""
    number = lambda x: F.round(F.coalesce(x, F.lit(0.0))).cast("long")
    point = lambda p: F.struct(encoded(F.array(F.round(p["waypoint"]["lon"] * 1e5).cast("long"), F.round(p["waypoint"]["lat"] * 1e5).cast("long"), number(p["waypoint"]["altSmoothed"]), number(p["radius"]))).alias("z"), p["waypoint"]["name"].alias("n"), F.when(p["type"] == "SSS", 2).when(p["type"] == "ESS", 3).alias("t"), F.when(p["type"] == "TAKEOFF", "T").alias("y"))
    start = F.when(task["sss"].isNotNull(), F.struct(F.when(task["sss"]["type"] == "RACE", 1).otherwise(2).alias("t"), F.when(task["sss"]["direction"] == "ENTER", 1).otherwise(2).alias("d"), task["sss"]["timeGates"].alias("g")))
    goal = F.when(task["goal"].isNotNull(), F.struct(F.when(task["goal"]["type"] == "LINE", 1).otherwise(2).alias("t"), task["goal"]["deadline"].alias("d")))
    return F.to_json(F.struct(task["taskType"].alias("taskType"), F.lit(2).alias("version"), F.when(task["earthModel"] == "FAI_SPHERE", 1).alias("e"), F.transform(task["turnpoints"], point).alias("t"), start.alias("s"), goal.alias("g"), task["takeoff"]["timeOpen"].alias("to"), task["takeoff"]["timeClose"].alias("tc")))


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """(file, task): the parsed text of whole files; null where a file is none."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), parsed(F.col("value")).alias("task"))


def from_declared(points: DataFrame, waypoints: DataFrame | None = None, reach: float = 50.0) -> DataFrame:
    """(file, task) of declared points (igc.declared): the start opens the speed section on the way out, the finish is goal.

    A start's radius is its area's inner one, any other's its outer one; else that of the waypoint of the same name, or
    else the nearest within `reach` metres, of waypoints (code, name, lat, lon, alt, radius); else RADIUS.
    """
    each = points.select(F.col("track_file").alias("file"), F.posexplode("points").alias("k", "p")).filter("p.role in ('start', 'turnpoint', 'finish')")
    fallback = F.initcap("p.role")
    rows = each.select("file", "k", F.coalesce(F.nullif(F.col("p.name"), F.lit("")), fallback).alias("name"), "p.lat", "p.lon", "p.role", "p.area")
    if waypoints is None:
        known = rows.select("*", F.lit(None).cast("struct<name: string, alt: double, radius: double>").alias("w"))
    else:
        held = waypoints.select(F.lower("code").alias("code"), F.col("lat").alias("wlat"), F.col("lon").alias("wlon"), F.struct("name", "alt", "radius").alias("w"))
        named = held.groupBy("code").agg(F.min("w").alias("by_name"))
        cell = lambda c: F.round(F.col(c) / CELL).cast("long")
        filed = held.withColumns({"x": cell("wlon"), "y": cell("wlat")})
        around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
        near = rows.select("file", "k", "lat", "lon", around.alias("o")).withColumns({"x": cell("lon") + F.col("o.i"), "y": cell("lat") + F.col("o.j")}).join(filed, ["x", "y"])
        metres = near.withColumn("m", ellipsoid_metres("lat", "lon", "wlat", "wlon")).filter(F.col("m") <= reach)
        nearest = metres.groupBy("file", "k").agg(F.min(F.struct("m", "w")).alias("n")).select("file", "k", F.col("n.w").alias("by_place"))
        known = rows.join(named, F.lower(rows["name"]) == named["code"], "left").join(nearest, ["file", "k"], "left").withColumn("w", F.coalesce("by_name", "by_place"))
    size = F.when((F.col("area.kind") == "STARTAREA") & (F.col("area.inner") > 0), F.col("area.inner")).when(F.col("area.outer") > 0, F.col("area.outer"))
    opens = (F.col("role") == "start") | F.coalesce(F.col("area.kind") == "STARTAREA", F.lit(False))
    place = F.struct(F.coalesce(F.nullif(F.col("w.name"), F.lit("")), "name").alias("name"), F.lit(None).cast("string").alias("description"), "lat", "lon", F.col("w.alt").alias("altSmoothed"))
    point = F.struct("k", F.when(opens, "SSS").alias("type"), F.coalesce(size, F.col("w.radius"), F.lit(RADIUS)).alias("radius"), place.alias("waypoint"))
    whole = known.groupBy("file").agg(F.array_sort(F.collect_list(point)).alias("all"))
    tps = F.transform("all", lambda x: F.struct(x["type"].alias("type"), x["radius"].alias("radius"), x["waypoint"].alias("waypoint")))
    task = F.struct(F.lit("CLASSIC").alias("taskType"), F.lit(1).alias("version"), F.lit("WGS84").alias("earthModel"), tps.alias("turnpoints"), F.struct(F.lit("RACE").alias("type"), F.lit("EXIT").alias("direction"), F.lit(None).cast("array<string>").alias("timeGates")).alias("sss"), F.struct(F.lit("CYLINDER").alias("type"), F.lit(None).cast("string").alias("deadline")).alias("goal"))
    return whole.select("file", task.alias("task"))


def second_of_day(text: Column) -> Column:
    """"HH:MM:SSZ" as seconds."""
    g = lambda i: F.regexp_extract(text, r"^(\d{1,2}):(\d{2}):(\d{2})", i).try_cast("int")
    return g(1) * 3600 + g(2) * 60 + g(3)


def turnpoints(tasks: DataFrame) -> DataFrame:
    """(file, tp_index, type, name, lat, lon, radius, alt): a row a turnpoint."""
    t = tasks.select("file", F.posexplode("task.turnpoints").alias("tp_index", "tp"))
    return t.select("file", "tp_index", "tp.type", "tp.waypoint.name", "tp.waypoint.lat", "tp.waypoint.lon", "tp.radius", F.col("tp.waypoint.altSmoothed").alias("alt"))


def outline(tasks: DataFrame) -> DataFrame:
    """(file, start, end, goal, gates, deadline, valid): indices of the start, the end of the speed section and goal, gates in seconds.

    Without a named start the first turnpoint that is no take-off is it; without a named end, goal is.
    """
    tps = F.col("task.turnpoints")
    n = F.size(tps)
    index = lambda kind: F.array_position(F.transform(tps, lambda t: F.coalesce(t["type"], F.lit(""))), kind).cast("int") - 1
    start = F.when(index("SSS") >= 0, index("SSS")).otherwise(F.when(index("TAKEOFF") == 0, 1).otherwise(0))
    end = F.when(index("ESS") >= 0, index("ESS")).otherwise(n - 1)
    sound = tps.isNotNull() & (n >= 2) & F.forall(tps, lambda t: (t["radius"] > 0) & t["waypoint"]["lat"].between(-90, 90) & t["waypoint"]["lon"].between(-180, 180)) & (start < end)
    gates = F.transform(F.coalesce("task.sss.timeGates", F.array().cast("array<string>")), second_of_day)
    return tasks.select("file", start.alias("start"), end.alias("end"), (n - 1).alias("goal"), F.array_sort(gates).alias("gates"), second_of_day(F.col("task.goal.deadline")).alias("deadline"), F.coalesce(sound, F.lit(False)).alias("valid"))


def gate_of(gates: Column, second: Column) -> Column:
    """The last gate at or before a time; null before the first."""
    return F.array_max(F.filter(gates, lambda g: g <= second))


def written_task(task: Column) -> Column:
    return F.to_json(task)


def trimmed(task: Column) -> Column:
    """A task from its start on, where it has a named one that is not the first turnpoint."""
    kinds = F.transform(task["turnpoints"], lambda t: F.coalesce(t["type"], F.lit("")))
    at = F.array_position(kinds, "SSS").cast("int")
    return F.when(at > 1, task.withField("turnpoints", F.slice(task["turnpoints"], at, F.size(task["turnpoints"])))).otherwise(task)


def near(second: Column, reference: Column) -> Column:
    """The time (seconds since 1970) of a second of the day within half a day of a reference."""
    same = F.floor(reference / 86_400) * 86_400 + second
    return F.when(same - reference > 43_200, same - 86_400).when(reference - same > 43_200, same + 86_400).otherwise(same).cast("long")


def timing(gates: Column, deadline: Column, opens: Column, crossing: Column, first: Column, last: Column, fallback: Column) -> Column:
    """struct<gates, deadline, opens> of a flight, in seconds since 1970, from seconds of the day (null: none).

    Gates lie about the first start crossing (or the first fix), the deadline about the last fix, the launch's opening about the
    first. A deadline not after the first gate is a mistake and does not count, nor does an opening not before the deadline, or after the
    first gate. A start that is no named one has neither gates nor an opening.
    """
    since = F.coalesce(crossing, first)
    own = F.when(~fallback & (F.size(gates) > 0) & since.isNotNull(), F.array_sort(F.transform(gates, lambda g: near(g, since))))
    begin = F.get(own, F.lit(0))
    end = near(deadline, last)
    ends = F.when(begin.isNull() | (end > begin), end)
    at = F.when(~fallback, near(opens, first))
    opened = F.when((ends.isNull() | (at < ends)) & (begin.isNull() | (at <= begin)), at)
    return F.struct(own.alias("gates"), ends.alias("deadline"), opened.alias("opens"))


def directions(points: DataFrame, route: DataFrame, rules: DataFrame) -> DataFrame:
    """(task, tp, way) of points (task, tp, plat, plon, radius): "exit" where the course comes from within the cylinder, else "enter".

    route: (task, tp, lat, lon), where the course touches each turnpoint; rules: (task, start or null, start_way "exit" or else). The
    start goes by its rule; the first and the last are entered.
    """
    last = W.partitionBy("task")
    before = route.select("task", (F.col("tp") + 1).alias("tp"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    placed = points.withColumns({"_lo": F.min("tp").over(last), "_hi": F.max("tp").over(last)}).join(before, ["task", "tp"], "left").join(rules.select("task", "start", "start_way"), "task")
    inside = F.coalesce(ellipsoid_metres("_lat", "_lon", "plat", "plon") < F.col("radius"), F.lit(False)) & (F.col("tp") > F.col("_lo")) & (F.col("tp") < F.col("_hi"))
    way = F.when(F.coalesce(F.col("tp") == F.col("start"), F.lit(False)), F.when(F.col("start_way") == "exit", "exit").otherwise("enter")).when(inside, "exit").otherwise("enter")
    return placed.select("task", "tp", way.alias("way"))
