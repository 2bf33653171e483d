"""Queries of readers, writers and flight events, and their SQL: formats are written from the tables' rows and read again."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import A
from ..functions.numbers import shown
from ..operators import detectors
from ..sources import igc, tasks, waypoints
from .catalog import FIXES, fixes, query, table
from .flights import NUMBERED, numbered

KINDS = tuple(waypoints.READERS)


@query(f"""SELECT format, 'C' || c_custkey AS code, c_name AS name, round((c_custkey * 37 % 15900) / 100.0::DOUBLE - 79.5, 4) AS lat, round((c_custkey * 101 % 35990) / 100.0::DOUBLE - 179.95, 4) AS lon, (c_custkey % 3000)::DOUBLE AS alt
FROM customer, unnest([{', '.join(repr(k) for k in KINDS)}]) f(format)""")
def waypoint_formats(spark, d):
    """Every customer's place as a record of each waypoint format, and read from it."""
    k = F.col("c_custkey")
    points = table(spark, d, "customer").select(F.lit("f").alias("track_file"), (k + 10).alias("line_no"), F.concat(F.lit("C"), k.cast("string")).alias("code"), F.col("c_name").alias("name"), (k * 37 % 15900 / 100.0 - 79.5).alias("lat"), (k * 101 % 35990 / 100.0 - 179.95).alias("lon"), (k % 3000).cast("double").alias("alt"), F.lit(400.0).alias("radius"))
    out = None
    for kind, reader in waypoints.READERS.items():
        # a file a hundred customers: elements are found in whole files
        records = points.select(F.floor(F.col("line_no") / 100).cast("string").alias("track_file"), "line_no", waypoints.writers()[kind][1].alias("line"))
        own = reader(waypoints.worked_out(records, line=F.col("line"))).select(F.lit(kind).alias("format"), "code", "name", shown(F.col("lat"), 4).alias("lat"), shown(F.col("lon"), 4).alias("lon"), shown(F.col("alt"), 1).alias("alt"))
        out = own if out is None else out.unionByName(own)
    return out


@query(f"""WITH {FIXES} SELECT user_id || '-' || (t // 86400) AS track_file, row_number() OVER (PARTITION BY user_id, t // 86400 ORDER BY t, event_id) - 1 AS fix_index, t * 1000 AS time_ms, round(-36 - (event_id % 1000) / 1000.0::DOUBLE, 8) AS lat, round(147 + (event_id % 977) / 1000.0::DOUBLE, 8) AS lon, (event_id % 5000 - 100)::INTEGER AS pressure_alt, (event_id % 4001)::INTEGER AS gnss_alt, event_id % 3 > 0 AS valid, event_type AS pilot FROM fixes""")
def log_fixes(spark, d):
    """A user's day as a log: headers, fix records, and a line that is none; read again."""
    i = F.col("event_id")
    by = W.partitionBy("track_file").orderBy("t", "event_id")
    e = fixes(spark, d).withColumn("track_file", F.concat_ws("-", F.col("user_id").cast("string"), F.floor(F.col("t") / 86400).cast("string")))
    rows = e.select("track_file", "event_id", "event_type", F.row_number().over(by).alias("fix_index"), (F.col("t") * 1000).cast("long").alias("time_ms"), (-36 - i % 1000 / 1000).alias("lat"), (147 + i % 977 / 1000).alias("lon"), (i % 3 > 0).alias("valid"), (i % 5000 - 100).cast("int").alias("pressure_alt"), (i % 4001).cast("int").alias("gnss_alt"))
    records = igc.written_fixes(rows).select("track_file", (F.col("fix_index") + 3).alias("line_no"), "line")
    date = F.date_format(F.timestamp_seconds(F.min("time_ms") / 1000), "ddMMyy")
    heads = rows.groupBy("track_file").agg(F.array(F.concat(F.lit("HFDTE"), date), F.lit("BROKEN"), F.lit("HFGIDGLIDERID:x")).alias("lines")).select("track_file", F.posexplode("lines").alias("line_no", "line"))
    read = igc.fixes(heads.unionByName(records))
    types = rows.withColumn("fix_index", F.col("fix_index").cast("long") - 1).select("track_file", "fix_index", F.col("event_type").alias("pilot"))
    return read.join(types, ["track_file", "fix_index"]).withColumns({"lat": shown(F.col("lat"), 8), "lon": shown(F.col("lon"), 8)})


@query("""WITH l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS i, l_orderkey % 3 = 0 AND l_linenumber = 1 AS s, l_orderkey % 2 = 0 AND l_linenumber = 3 AS e, l_partkey % 185 - 90 AS lat FROM lineitem),
o AS (SELECT k, count(*) AS n, coalesce(min(i) FILTER (s), 0) AS a, coalesce(min(i) FILTER (e), count(*) - 1) AS b, bool_and(lat <= 90) AS sound FROM l GROUP BY 1)
SELECT k::VARCHAR AS file, a::INTEGER AS start, b::INTEGER AS end, (n - 1)::INTEGER AS goal, (k % 20) * 3600 + 1800 AS deadline, sound AND n >= 2 AND a < b AS valid FROM o""")
def task_outlines(spark, d):
    """Orders as task files, their lines as turnpoints: written as JSON, read, and outlined."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    kind = F.when((k % 3 == 0) & (n == 1), "SSS").when((k % 2 == 0) & (n == 3), "ESS")
    place = F.struct(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("name"), (F.col("l_partkey") % 185 - 90).cast("double").alias("lat"), (F.col("l_suppkey") % 100).cast("double").alias("lon"))
    points = table(spark, d, "lineitem").groupBy(k).agg(F.array_sort(F.collect_list(F.struct(n.alias("n"), kind.alias("type"), F.lit(400.0).alias("radius"), place.alias("waypoint")))).alias("all"))
    deadline = F.concat(F.lpad((k % 20).cast("string"), 2, "0"), F.lit(":30:00Z"))
    tps = F.transform("all", lambda x: F.struct(x["type"].alias("type"), x["radius"].alias("radius"), x["waypoint"].alias("waypoint")))
    text = F.to_json(F.struct(F.lit("CLASSIC").alias("taskType"), F.lit(1).alias("version"), tps.alias("turnpoints"), F.struct(F.lit("CYLINDER").alias("type"), deadline.alias("deadline")).alias("goal")))
    read = points.select(k.cast("string").alias("file"), tasks.parsed(text).alias("task"))
    return tasks.outline(read).select("file", "start", "end", "goal", F.col("deadline").cast("long").alias("deadline"), "valid")


# --- flight events: users' events as fixes along the equator, a tenth of a degree a unit of value ---

STEP = f"radians(abs(value - lag(value) OVER w) / 10) * {A!r}"


@query(f"""WITH {NUMBERED}, s AS (SELECT *, t * 1000 AS ms, value * 10 AS alt, {STEP} AS d1, radians(abs(value - lag(value, 2) OVER w) / 10) * {A!r} AS d2, t - lag(t) OVER w AS e1, t - lag(t, 2) OVER w AS e2, coalesce(lag(value * 10, 5) OVER w, first(value * 10) OVER w) AS a5, coalesce(lag(t, 5) OVER w, first(t) OVER w) AS t5 FROM n WINDOW w AS (PARTITION BY user_id ORDER BY fix)),
v AS (SELECT *, CASE WHEN e1 > 0 THEN d1 / e1 ELSE 0 END AS v1, CASE WHEN e2 > 0 THEN d2 / e2 ELSE 0 END AS v2 FROM s),
g AS (SELECT user_id, avg(alt) AS ground, max(max_fix) AS rows FROM (SELECT *, max(fix) OVER (PARTITION BY user_id) AS max_fix FROM v) WHERE fix <= 10 GROUP BY 1),
l AS (SELECT *, v1 > 5 AND coalesce(lag(v1) OVER w, 0) > 5 AND lag(v1) OVER w IS NOT NULL AND v2 > 5 AS leads FROM v WINDOW w AS (PARTITION BY user_id ORDER BY fix)),
k AS (SELECT *, CASE WHEN lead(leads, 2) OVER w THEN lead(ms, 2) OVER w END AS leads_to FROM l WINDOW w AS (PARTITION BY user_id ORDER BY fix)),
x AS (SELECT *, first(ms) OVER (r RANGE BETWEEN 10000 FOLLOWING AND UNBOUNDED FOLLOWING) AS end_ms, first(alt) OVER (r RANGE BETWEEN 10000 FOLLOWING AND UNBOUNDED FOLLOWING) AS end_alt,
  last(ms) OVER (r RANGE BETWEEN UNBOUNDED PRECEDING AND 30000 PRECEDING) AS begin_ms, last(alt) OVER (r RANGE BETWEEN UNBOUNDED PRECEDING AND 30000 PRECEDING) AS begin_alt,
  min(leads_to) OVER (r RANGE BETWEEN CURRENT ROW AND 10000 FOLLOWING) AS leads_by, max(v1) OVER (r RANGE BETWEEN 29999 PRECEDING AND CURRENT ROW) AS fastest FROM k JOIN g USING (user_id) WINDOW r AS (PARTITION BY user_id ORDER BY ms)),
f AS (SELECT *, rows >= 10 AND fix > 1 AND end_ms IS NOT NULL AND (v1 > 5 OR alt - ground > 50 OR (t > t5 AND (alt - a5) / (t - t5) > 1)) AND (end_alt - ground > 50 OR (end_ms > ms AND (end_alt - alt) / (end_ms - ms) * 1000 > 1) OR coalesce(leads_by <= end_ms, false)) AS off,
  rows >= 10 AND fix BETWEEN 2 AND rows - 1 AND begin_ms IS NOT NULL AND (fastest > 2.5 OR (alt - begin_alt) / (ms - begin_ms) * 1000 < -0.5) AS flies FROM x)
SELECT user_id, min(CASE WHEN off THEN fix END) AS takeoff, max(CASE WHEN flies THEN fix END) AS landing FROM f GROUP BY 1""")
def takeoffs(spark, d):
    tracks = numbered(spark, d).select("user_id", "fix_index", "t", F.lit(0.0).alias("lat"), (F.col("value") / 10).alias("lon"), (F.col("value") * 10).alias("alt"))
    return detectors.takeoff_and_landing(tracks, ["user_id"])


CLIMB, ROWS, LASTS, APART = 2e-4, 2, 30000.0, 20000.0


@query(f"""WITH RECURSIVE {NUMBERED}, p AS (SELECT *, lag(fix, {ROWS}) OVER w AS i0, lag(t, {ROWS}) OVER w AS t0, lag(value, {ROWS}) OVER w AS a0, max(fix) OVER (PARTITION BY user_id) AS rows FROM n WINDOW w AS (PARTITION BY user_id ORDER BY fix)),
h AS (SELECT *, fix - lag(fix) OVER w AS since FROM p WHERE i0 IS NOT NULL AND t > t0 AND (value - a0) / (t - t0) > {CLIMB} WINDOW w AS (PARTITION BY user_id ORDER BY fix)),
b AS (SELECT *, sum(CASE WHEN since IS NULL OR since > {detectors.CLIMB_LOW} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY fix) AS bout FROM h),
g AS (SELECT user_id, bout, CASE WHEN any_value(rows) - max(fix) < {detectors.CLIMB_LOW} THEN any_value(rows) ELSE max(fix) END AS stop FROM b GROUP BY ALL),
s AS (SELECT g.user_id, bout, stop, n.t AS stop_t, n.value AS stop_a FROM g JOIN n ON n.user_id = g.user_id AND n.fix = stop),
f AS (SELECT user_id, 0::HUGEINT AS bout, -1e18::DOUBLE AS free, -1::BIGINT AS done, NULL::BIGINT AS i, NULL::BIGINT AS stop FROM (SELECT DISTINCT user_id FROM s)
  UNION ALL SELECT f.user_id, s.bout, CASE WHEN k.i IS NOT NULL AND s.stop_t - k.t >= {LASTS} THEN s.stop_t ELSE free END, CASE WHEN k.i IS NOT NULL AND s.stop_t - k.t >= {LASTS} THEN s.stop ELSE done END, CASE WHEN s.stop_t - k.t >= {LASTS} THEN k.i END, s.stop
  FROM f JOIN s ON s.user_id = f.user_id AND s.bout = f.bout + 1 LEFT JOIN LATERAL (SELECT min(b.i0) AS i, min(b.t0) AS t FROM b WHERE b.user_id = s.user_id AND b.bout = s.bout AND b.t0 >= f.free + {APART} AND b.i0 > f.done) k ON true)
SELECT f.user_id, row_number() OVER (PARTITION BY f.user_id ORDER BY f.bout) AS climb, f.i AS first, f.stop AS last, round(b.value - a.value, 4) AS gain, round((b.value - a.value) / (b.t - a.t), 8) AS rate FROM f JOIN n a ON a.user_id = f.user_id AND a.fix = f.i JOIN n b ON b.user_id = f.user_id AND b.fix = f.stop WHERE f.i IS NOT NULL""")
def climbs(spark, d):
    tracks = numbered(spark, d).select("user_id", "fix_index", "t", F.col("value").alias("alt"))
    found = detectors.climbs(tracks, ["user_id"], CLIMB, ROWS, LASTS, APART)
    return found.select("user_id", F.col("climb").cast("long").alias("climb"), "first", "last", shown(F.col("gain"), 4).alias("gain"), shown(F.col("rate"), 8).alias("rate"))


_H = "degrees(atan2(sin({d}) * cos(radians(lat)), cos(radians(lat0)) * sin(radians(lat)) - sin(radians(lat0)) * cos(radians(lat)) * cos({d})))".format(d="radians(lon - lon0)")


def _turned(a: str, b: str) -> str:
    return f"(({a}) - ({b}) + 180 - 360 * floor((({a}) - ({b}) + 180) / 360) - 180)"


@query(f"""WITH {NUMBERED}, q AS (SELECT user_id, fix, 3.0::DOUBLE * fix AS t, -36 + value / 1000 AS lat, 147 + (id % 97) / 1000.0::DOUBLE AS lon FROM n),
p AS (SELECT *, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0 FROM q WINDOW w AS (PARTITION BY user_id ORDER BY fix)),
h AS (SELECT *, CASE WHEN lat0 IS NOT NULL THEN {_H} END AS heading FROM p),
r AS (SELECT *, lag(heading, 2) OVER w AS before FROM h WINDOW w AS (PARTITION BY user_id ORDER BY fix)),
v AS (SELECT *, CASE WHEN heading IS NOT NULL AND before IS NOT NULL THEN greatest(least({_turned('heading', 'before')} / 6, {detectors.TURN_MOST}), -{detectors.TURN_MOST}) ELSE 0 END AS rate FROM r),
m AS (SELECT *, abs(rate) >= {detectors.TURN_RATE} AS turning, CASE WHEN coalesce(lag(abs(rate) >= {detectors.TURN_RATE}) OVER w <> (abs(rate) >= {detectors.TURN_RATE}), true) THEN 1 ELSE 0 END AS fresh FROM v WINDOW w AS (PARTITION BY user_id ORDER BY fix)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY fix) AS run FROM m),
j AS (SELECT *, t - min(t) OVER (PARTITION BY user_id, run) AS since FROM i),
u AS (SELECT user_id, run, turning, min(fix) AS first, max(fix) AS last, min(CASE WHEN since >= CASE WHEN turning THEN {detectors.TURN_IN} ELSE {detectors.TURN_OUT} END THEN fix END) AS done FROM j GROUP BY ALL),
b AS (SELECT *, sum(CASE WHEN NOT turning AND done IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - CASE WHEN NOT turning AND done IS NOT NULL THEN 1 ELSE 0 END AS part FROM u),
g AS (SELECT user_id, part, min(CASE WHEN turning AND done IS NOT NULL THEN first END) AS first, coalesce(max(CASE WHEN NOT turning AND done IS NOT NULL THEN done END), max(last)) AS last FROM b GROUP BY ALL HAVING min(CASE WHEN turning AND done IS NOT NULL THEN first END) IS NOT NULL)
SELECT g.user_id, row_number() OVER (PARTITION BY g.user_id ORDER BY part) AS segment, first, last, max(t) - min(t) AS seconds, round(avg(CASE WHEN turning THEN rate END), 6) AS turn_rate FROM g JOIN j ON j.user_id = g.user_id AND fix BETWEEN first AND last GROUP BY g.user_id, part, first, last""")
def circling_segments(spark, d):
    """Users' events three seconds apart, on places that turn about."""
    tracks = numbered(spark, d).select("user_id", "fix_index", (F.col("fix_index") * 3.0).alias("t"), (F.col("value") / 1000 - 36).alias("lat"), (F.col("id") % 97 / 1000 + 147).alias("lon"), F.lit(0.0).alias("alt"))
    found = detectors.circling(tracks, ["user_id"]).filter("circle = 0")
    return found.select("user_id", F.col("segment").cast("long").alias("segment"), "first", "last", "seconds", shown(F.col("turn_rate")).alias("turn_rate"))


@query(f"""WITH {NUMBERED}, c AS (SELECT user_id, min(fix) AS first, max(fix) AS last FROM (SELECT *, fix - row_number() OVER (PARTITION BY user_id ORDER BY fix) AS g FROM n WHERE value >= 70) GROUP BY user_id, g HAVING count(*) > 1),
e AS (SELECT user_id, min(fix) AS lo, max(fix) AS hi FROM n GROUP BY 1), x AS (SELECT * FROM c UNION ALL SELECT user_id, hi, hi FROM e),
g AS (SELECT * FROM (SELECT x.user_id, coalesce(lag(last) OVER (PARTITION BY x.user_id ORDER BY first), lo) AS first, first AS last FROM x JOIN e USING (user_id)) WHERE last - first > {detectors.GLIDE_ROWS}),
s AS (SELECT *, coalesce({STEP}, 0) AS step FROM n WINDOW w AS (PARTITION BY user_id ORDER BY fix)), d AS (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY fix) AS along FROM s),
r AS (SELECT g.user_id, first, last, b.t - a.t AS seconds, b.along - a.along AS metres, (a.value - b.value) * 1000 AS lost FROM g JOIN d a ON a.user_id = g.user_id AND a.fix = first JOIN d b ON b.user_id = g.user_id AND b.fix = last)
SELECT user_id, first, last, seconds, round(metres, 0) AS metres, round(lost, 4) AS lost, CASE WHEN lost > 0 THEN round(metres / lost, 6) END AS ratio, lost > 0 AND metres / lost <= {detectors.SINK_RATIO} AS sinks FROM r WHERE seconds > {detectors.GLIDE_LEAST}""")
def glides(spark, d):
    """What lies between runs of value 70 and more, along the equator."""
    base = numbered(spark, d)
    w = W.partitionBy("user_id").orderBy("fix_index")
    high = base.filter("value >= 70").withColumn("g", F.col("fix_index") - F.row_number().over(w)).groupBy("user_id", "g").agg(F.min("fix_index").alias("first"), F.max("fix_index").alias("last")).filter("last > first")
    tracks = base.select("user_id", "fix_index", "t", F.lit(0.0).alias("lat"), (F.col("value") / 10).alias("lon"), (F.col("value") * 1000).alias("alt"))
    found = detectors.glides(tracks, high, ["user_id"])
    return found.select("user_id", "first", "last", "seconds", shown(F.col("metres"), 0).alias("metres"), shown(F.col("lost"), 4).alias("lost"), shown(F.col("ratio")).alias("ratio"), "sinks")
