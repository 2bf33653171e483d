"""Queries of formats and projections, and their SQL: the grid, delta strings, clocks that run backwards, daylight, track packs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import projections as p
from ..functions import sun
from ..functions.numbers import seconds, shown
from ..operators import packs
from ..sources import igc, tasks
from .catalog import FIXES, fixes, query, table

LAT, LON = "(c_custkey * 37 % 15900) / 100.0::DOUBLE - 79.5", "(c_custkey * 101 % 35990) / 100.0::DOUBLE - 179.95"


def _series(t: str, terms: tuple) -> str:
    return " + ".join(f"{c!r} * {t.format(j=2 * j)}" for j, c in enumerate(terms, 1))


COS, SIN = "cos({j} * x) * sinh({j} * y)", "sin({j} * x) * cosh({j} * y)"


@query(f"""WITH c AS (SELECT c_custkey, {LAT} AS lat, {LON} AS lon FROM customer), z AS (SELECT *, (floor((lon + 180) / 6) + 1)::INTEGER AS zone FROM c),
t AS (SELECT *, sinh(atanh(sin(radians(lat))) - {p.E!r} * atanh(sin(radians(lat)) * {p.E!r})) AS t, radians(lon - (zone * 6 - 183)) AS dl FROM z),
k AS (SELECT *, atan2(t, cos(dl)) AS x, atanh(sin(dl) / sqrt(1 + t * t)) AS y FROM t),
g AS (SELECT *, y + {_series(COS, p.FORWARD)} AS e, x + {_series(SIN, p.FORWARD)} AS n FROM k)
SELECT c_custkey, zone, '{p.BANDS}'[(floor((lat + 80) / 8) + 1)::INTEGER] AS band, round(500000 + {p.SCALE * p.MEAN!r} * e, 3) AS easting, round({p.SCALE * p.MEAN!r} * n + CASE WHEN lat < 0 THEN 10000000 ELSE 0 END, 3) AS northing, round(lat, 7) AS lat, round(lon, 7) AS lon FROM g""")
def grid_places(spark, d):
    """A place a customer, to the grid and back again."""
    k = F.col("c_custkey")
    places = table(spark, d, "customer").select(k, (k * 37 % 15900 / 100.0 - 79.5).alias("lat0"), (k * 101 % 35990 / 100.0 - 179.95).alias("lon0"))
    grid = places.select("c_custkey", "lat0", *[c.alias(n) for n, c in p.to_grid(F.col("lat0"), F.col("lon0")).items()])
    grid = grid.withColumn("place", p.from_grid(F.col("zone"), F.col("lat0") >= 0, F.col("easting"), F.col("northing")))
    return grid.select("c_custkey", "zone", "band", shown(F.col("easting"), 3).alias("easting"), shown(F.col("northing"), 3).alias("northing"), shown(F.col("place.lat"), 7).alias("lat"), shown(F.col("place.lon"), 7).alias("lon"))


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, [l_partkey * 137 - 9000000, 4000000 - l_suppkey * 7919, l_quantity::BIGINT, l_extendedprice::BIGINT] AS n FROM lineitem),
u AS (SELECT *, list_transform(n, lambda x: CASE WHEN x < 0 THEN -2 * x - 1 ELSE 2 * x END) AS s FROM v)
SELECT l_orderkey, l_linenumber, list_sum(n)::BIGINT AS total, array_to_string(list_transform(s, lambda x: array_to_string(list_transform(list_filter(range(0, 13), lambda i: i = 0 OR (x >> (5 * i)) > 0), lambda i: chr((((x >> (5 * i)) & 31) + CASE WHEN (x >> (5 * (i + 1))) > 0 THEN 32 ELSE 0 END + 63)::INTEGER)), '')), '') AS z FROM u""")
def delta_strings(spark, d):
    """Four numbers of a line item as a turnpoint's string, and their sum from reading it again."""
    numbers = F.array(F.col("l_partkey") * 137 - 9_000_000, 4_000_000 - F.col("l_suppkey") * 7919, F.round("l_quantity").cast("long"), F.bround("l_extendedprice").cast("long"))
    z = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", tasks.encoded(numbers).alias("z"))
    return z.withColumn("total", F.aggregate(tasks.decoded(F.col("z")), F.lit(0).cast("long"), lambda a, x: a + x))


@query(f"""WITH RECURSIVE {FIXES}, o AS (SELECT user_id, event_id, t + (event_id % 5) * 40000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM fixes),
s AS (SELECT user_id, 0::BIGINT AS k, (-4611686018427387904)::BIGINT AS prior, (-4611686018427387904)::BIGINT AS last, -1::BIGINT AS line, NULL::BIGINT AS dropped FROM (SELECT DISTINCT user_id FROM o)
  UNION ALL SELECT o.user_id, o.k, CASE WHEN t >= last THEN last ELSE prior END, CASE WHEN t >= prior THEN t ELSE last END, CASE WHEN t >= prior THEN event_id ELSE line END, CASE WHEN t >= last THEN NULL WHEN t >= prior THEN line ELSE event_id END FROM s JOIN o ON o.user_id = s.user_id AND o.k = s.k + 1)
SELECT user_id, dropped AS event_id FROM s WHERE dropped IS NOT NULL""")
def backward_clocks(spark, d):
    """Events in order of their numbers, with times that jump: those to drop so that no user's clock runs backwards."""
    timed = fixes(spark, d).select(F.col("user_id").alias("track_file"), F.col("event_id").cast("int").alias("line_no"), (F.col("t") + F.col("event_id") % 5 * 40_000).cast("long").alias("time_ms"))
    return igc._disordered(timed).select(F.col("track_file").alias("user_id"), F.col("line_no").cast("long").alias("event_id"))


_M = f"radians(({sun.ANOMALY} + noon * {sun.DAILY}) % 360)"
_L = f"radians((degrees({_M}) + {sun.CENTRE[0]} * sin({_M}) + {sun.CENTRE[1]} * sin(2 * {_M}) + {sun.CENTRE[2]} * sin(3 * {_M}) + 180 + {sun.PERIHELION}) % 360)"


@query(f"""WITH o AS (SELECT o_orderkey, (epoch_us(o_orderdate) // 86400000000) * 86400 AS midnight, (o_custkey * 37 % 17900) / 100.0::DOUBLE - 89.5 AS lat, (o_custkey * 101 % 35990) / 100.0::DOUBLE - 179.95 AS lon FROM orders),
n AS (SELECT *, round((midnight - {sun.NOON_2000}) / 86400 + 0.5) - lon / 360 AS noon FROM o), l AS (SELECT *, {_M} AS m, {_L} AS along FROM n),
h AS (SELECT *, noon + {sun.TRANSIT[0]} * sin(m) + ({sun.TRANSIT[1]}) * sin(2 * along) AS transit, sin(along) * sin(radians({sun.TILT})) AS height FROM l),
s AS (SELECT *, (sin(radians({sun.RISES_AT})) - sin(radians(lat)) * height) / (cos(radians(lat)) * cos(asin(height))) AS share FROM h)
SELECT o_orderkey, round({sun.NOON_2000} + (transit - degrees(acos(share)) / 360) * 86400, 2) AS rise, round({sun.NOON_2000} + (transit + degrees(acos(share)) / 360) * 86400, 2) AS set FROM s WHERE share BETWEEN -1 AND 1""")
def sunrises(spark, d):
    """Sunrise and sunset on an order's day at a place of its customer's; orders of the polar day or night have none."""
    k = F.col("o_custkey")
    midnight = F.floor(seconds(F.col("o_orderdate")) / 86_400) * 86_400
    own = table(spark, d, "orders").select("o_orderkey", sun.sun_times(k * 37 % 17900 / 100.0 - 89.5, k * 101 % 35990 / 100.0 - 179.95, midnight).alias("s")).filter("s is not null")
    return own.select("o_orderkey", shown(F.col("s.rise"), 2).alias("rise"), shown(F.col("s.set"), 2).alias("set"))


@query(f"""WITH {FIXES}, f AS (SELECT t // 604800 AS task, user_id AS pilot, t, min(event_id) AS id FROM fixes GROUP BY ALL),
q AS (SELECT task, pilot, t, row_number() OVER (PARTITION BY task, pilot ORDER BY t) AS fix, (id % 211) * 7.0::DOUBLE AS alt FROM f),
w AS (SELECT task, min(alt) AS alt0 FROM q GROUP BY 1),
n AS (SELECT task, pilot, count(*) AS vertex_count, round(sum(alt - alt0), 1) AS up FROM q JOIN w USING (task) GROUP BY ALL)
SELECT task, pilot, (coalesce(sum(vertex_count) OVER (PARTITION BY task ORDER BY pilot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS vertex_offset, vertex_count, up FROM n""")
def track_packs(spark, d):
    """Weeks of events as fields packed for drawing: where each pilot's vertices lie, and the sum of their heights."""
    f = fixes(spark, d).groupBy(F.floor(F.col("t") / 604800).cast("long").alias("task"), F.col("user_id").alias("pilot"), "t").agg(F.max("value").alias("value"), F.min("event_id").alias("id"))
    by = packs.W.partitionBy("task", "pilot").orderBy("t")
    tracks = f.select("task", "pilot", F.row_number().over(by).alias("fix_index"), "t", (F.col("value") / 1000 - 36).alias("lat"), (F.col("id") % 97 / 1000 + 147).alias("lon"), (F.col("id") % 211 * 7.0).alias("alt"))
    rows = packs.packed(tracks, "task", "pilot")
    heights = F.transform(F.sequence(F.lit(0), F.col("vertex_count") - 1), lambda i: F.get("data", (i * packs.FLOATS + 1).cast("int")).cast("double"))
    return rows.select("task", "pilot", "vertex_offset", "vertex_count", F.round(F.aggregate(heights, F.lit(0.0), lambda a, x: a + x), 1).alias("up"))
