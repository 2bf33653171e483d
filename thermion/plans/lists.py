"""Queries of lists and matches, and their SQL: winds at heights, rosters, published results, events of flights, nearest turnpoints, times of day."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import air
from ..functions.numbers import seconds, shown
from ..operators import joins
from ..sources import results, tasks
from .catalog import FIXES, fixes, query, table
from .flights import NUMBERED, RUN, numbered, runs

LEVELS = "l AS (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity * 100 AS h, l_tax * 500 AS s, (l_partkey % 360)::DOUBLE AS d FROM lineitem WHERE l_discount > 0.01)"


@query(f"""WITH {LEVELS}, o AS (SELECT o_orderkey AS k, (o_custkey % 6000)::DOUBLE AS z FROM orders),
v AS (SELECT k, n, h, s * sin(radians(d)) AS u, s * cos(radians(d)) AS v FROM l),
e AS (SELECT o.k, z, arg_min({{'h': h, 'u': u, 'v': v}}, (h, u, v)) FILTER (h >= z) AS hi, arg_max({{'h': h, 'u': u, 'v': v}}, (h, u, v)) FILTER (h < z) AS lo, arg_min({{'h': h, 'u': u, 'v': v}}, (h, u, v)) AS low, arg_max({{'h': h, 'u': u, 'v': v}}, (h, u, v)) AS high FROM o JOIN v USING (k) GROUP BY 1, 2),
p AS (SELECT k, z, coalesce(lo, low) AS a, coalesce(hi, high) AS b FROM e), t AS (SELECT *, CASE WHEN b.h > a.h THEN least(greatest((z - a.h) / (b.h - a.h), 0), 1) ELSE 0 END AS t FROM p),
w AS (SELECT k, a.u + (b.u - a.u) * t AS u, a.v + (b.v - a.v) * t AS v FROM t),
f AS (SELECT o.k, first(l.h ORDER BY abs(l.h - 1000 - o.k % 500), l.n, l.h) AS level FROM o JOIN l USING (k) GROUP BY 1)
SELECT w.k AS o_orderkey, round(sqrt(u * u + v * v), 6) AS speed, round(degrees(atan2(u, v)) - 360 * floor(degrees(atan2(u, v)) / 360), 4) AS direction, level FROM w JOIN f USING (k)""")
def winds_aloft(spark, d):
    """An order's lines as levels of the air: the wind at a height between them, and the level nearest flying height."""
    level = F.struct("l_linenumber", F.struct((F.col("l_quantity") * 100).alias("height"), F.when(F.col("l_discount") > 0.01, F.col("l_tax") * 500).alias("speed"), (F.col("l_partkey") % 360).cast("double").alias("direction")).alias("x"))
    held = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(level)), lambda x: x["x"]).alias("levels"))
    own = table(spark, d, "orders").join(held, F.col("o_orderkey") == F.col("l_orderkey"))
    k = F.col("o_orderkey")
    wind = own.select(k, air.wind_at(F.col("levels"), (F.col("o_custkey") % 6000).cast("double")).alias("w"), air.flying_level(F.col("levels"), (k % 500).cast("double"))["height"].alias("level"))
    return wind.filter("w is not null").select("o_orderkey", shown(F.col("w.speed")).alias("speed"), shown(F.col("w.direction"), 4).alias("direction"), "level")


@query("""WITH r AS (SELECT c_custkey AS row, CASE WHEN c_custkey % 3 = 0 THEN c_custkey // 2 END AS civl, 'Pilot ' || (c_custkey % 700) AS name FROM customer),
e AS (SELECT o_custkey AS civl, ' pilot  ' || (o_custkey % 900) AS name, o_orderkey AS rank FROM orders),
p AS (SELECT civl, min(rank) AS rank, first(name ORDER BY rank, name) AS name FROM e GROUP BY 1),
k AS (SELECT *, lower(regexp_replace(trim(name), '\\s+', ' ', 'g')) AS key FROM p), o AS (SELECT key, any_value(civl) AS civl, any_value(rank) AS rank FROM k GROUP BY key HAVING count(*) = 1),
c AS (SELECT row, o.civl, o.rank FROM r JOIN o ON lower(regexp_replace(trim(r.name), '\\s+', ' ', 'g')) = o.key WHERE r.civl IS NULL AND o.civl NOT IN (SELECT civl FROM r WHERE civl IS NOT NULL))
SELECT row, civl, p.rank, 'id' AS matched_by FROM r JOIN p USING (civl) UNION ALL SELECT row, civl, rank, 'name' FROM c QUALIFY count(*) OVER (PARTITION BY civl) = 1""")
def roster_matches(spark, d):
    k = F.col("c_custkey")
    roster = table(spark, d, "customer").select(k.alias("row"), F.when(k % 3 == 0, F.floor(k / 2)).alias("civl"), F.concat(F.lit("Pilot "), (k % 700).cast("string")).alias("name"))
    ranked = table(spark, d, "orders").select(F.col("o_custkey").alias("civl"), F.concat(F.lit(" pilot  "), (F.col("o_custkey") % 900).cast("string")).alias("name"), F.col("o_orderkey").alias("rank"))
    return joins.matched(roster, ranked, "row", "civl", "name", "rank")


@query("""WITH a AS (SELECT o_orderstatus AS task, o_custkey AS pilot, max(o_totalprice) AS best, min(o_totalprice) AS least FROM orders GROUP BY 1, 2),
r AS (SELECT *, rank() OVER (PARTITION BY task ORDER BY best DESC) AS rank, CASE WHEN pilot % 5 > 0 THEN rank() OVER (PARTITION BY task ORDER BY least DESC) END AS official FROM a)
SELECT task, pilot, rank, official, rank - official AS moved FROM r""")
def official_ranks(spark, d):
    """Ranks by the dearest order beside published ones by the cheapest, which a fifth of the pilots lack."""
    own = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("task"), F.col("o_custkey").alias("pilot")).agg(F.max("o_totalprice").alias("best"), F.min("o_totalprice").alias("least"))
    ranked = lambda c: own.select("task", "pilot", F.rank().over(W.partitionBy("task").orderBy(F.desc(c))).cast("long").alias("rank"))
    return joins.overlaid(ranked("best"), ranked("least").filter("pilot % 5 > 0"), ["task", "pilot"], "rank")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN (o_orderkey % 90)::INTEGER END AS rank, o_custkey::VARCHAR AS pilot_id, 'A. Pilot ' || o_custkey AS name, CASE WHEN o_custkey % 2 = 0 THEN o_orderkey::VARCHAR END AS track_id, CASE WHEN o_orderkey % 7 > 0 THEN '10:00:01' END AS start, o_totalprice AS distance, floor(o_totalprice / 100 + 0.5)::BIGINT AS score FROM orders""")
def published_results(spark, d):
    """An order as a row of a published table, by position, and read again."""
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    rank = F.when(k % 4 > 0, (k % 90).cast("string")).otherwise("-")
    link = F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit('<a href="x?trackid='), k.cast("string"), F.lit('&c=1">A. Pilot '), c, F.lit("</a>"))).otherwise(F.concat(F.lit("A. Pilot "), c))
    none = F.lit("")
    cells = [rank, c, link, none, none, none, F.when(k % 7 > 0, "10:00:01").otherwise(""), none, none, none, F.col("o_totalprice").cast("string"), none, none, none, none, none, (F.col("o_totalprice") / 100).cast("string")]
    text = table(spark, d, "orders").select(k, F.to_json(F.array(F.array(*cells))).alias("text"))
    return text.select("o_orderkey", results.result(results.rows(F.col("text"))[0]).alias("r")).select("o_orderkey", "r.rank", "r.pilot_id", "r.name", "r.track_id", "r.start", "r.distance", "r.score")


@query(f"""WITH {NUMBERED}, c AS ({RUN.format(what='value >= 60')}), s AS ({RUN.format(what='value < 10')}),
e AS (SELECT user_id, first AS fix, 'climb_entry' AS kind FROM c UNION ALL SELECT user_id, last, 'climb_exit' FROM c UNION ALL SELECT user_id, first, 'sink_entry' FROM s UNION ALL SELECT user_id, min(fix), 'takeoff' FROM n GROUP BY 1 UNION ALL SELECT user_id, max(fix), 'landing' FROM n GROUP BY 1)
SELECT e.user_id, row_number() OVER (PARTITION BY e.user_id ORDER BY t, kind) AS place, kind, fix, t, value, value BETWEEN 5 AND 90 AND id % 97 BETWEEN 10 AND 80 AS in_view FROM e JOIN n USING (user_id, fix)""")
def flight_events(spark, d):
    """All that happens in a flight in one list, by time, and whether it lies in a box."""
    n = numbered(spark, d)
    high, low = runs(n, "value >= 60"), runs(n, "value < 10")
    ends = n.groupBy("user_id").agg(F.min("fix_index").alias("first"), F.max("fix_index").alias("last"))
    found = joins.event_list([(high, "first", "climb_entry"), (high, "last", "climb_exit"), (low, "first", "sink_entry"), (ends, "first", "takeoff"), (ends, "last", "landing")], n, ["user_id"])
    boxed = joins.in_box(found.withColumn("x", F.col("id") % 97), "value", "x", (5, 10, 90, 80))
    return boxed.select("user_id", F.col("place").cast("long").alias("place"), "kind", F.col("fix_index").alias("fix"), "t", "value", "in_view")


@query(f"""WITH {FIXES}, p AS (SELECT n_nationkey AS tp, (n_nationkey * 37 % 101)::DOUBLE AS x, (n_nationkey * 53 % 97)::DOUBLE AS y FROM nation),
a AS (SELECT user_id, event_id, tp, sqrt(pow(event_id % 101 - x, 2) + pow(value - y, 2)) AS away FROM fixes, p)
SELECT user_id, first(tp ORDER BY away, tp, event_id) AS tp, round(min(away), 6) AS away, first(event_id ORDER BY away, tp, event_id) AS event_id FROM a GROUP BY 1""")
def nearest_turnpoints(spark, d):
    """How near each user came to any of 25 places, to which, and with which event."""
    k = F.col("n_nationkey")
    points = table(spark, d, "nation").select(F.lit(0).alias("task"), k.alias("tp"), (k * 37 % 101).cast("double").alias("x"), (k * 53 % 97).cast("double").alias("y"))
    tracks = fixes(spark, d).select(F.lit(0).alias("task"), "user_id", "event_id", (F.col("event_id") % 101).cast("double").alias("x"), F.col("value").alias("y"))
    return joins.nearest_approach(tracks, points, "task", ["user_id"], "event_id", "tp").select("user_id", "tp", shown(F.col("away")).alias("away"), "event_id")


@query("""WITH o AS (SELECT o_orderkey, epoch_us(o_orderdate) // 1000000 + o_custkey % 86400 AS r, (o_orderkey * 7919 % 86400)::BIGINT AS s FROM orders), c AS (SELECT *, r // 86400 * 86400 + s AS c FROM o)
SELECT o_orderkey, CASE WHEN c - r > 43200 THEN c - 86400 WHEN r - c > 43200 THEN c + 86400 ELSE c END AS t FROM c""")
def times_of_day(spark, d):
    """A time of the day as the moment within half a day of another."""
    k = F.col("o_orderkey")
    clock = k * 7919 % 86_400
    text = F.concat_ws(":", *[F.lpad((F.floor(clock / x) % m).cast("string"), 2, "0") for x, m in ((3600, 24), (60, 60), (1, 60))])
    return table(spark, d, "orders").select("o_orderkey", tasks.near(tasks.second_of_day(F.concat(text, F.lit("Z"))), seconds(F.col("o_orderdate")) + F.col("o_custkey") % 86_400).alias("t"))


@query("""SELECT l_orderkey, sha256(string_agg(l_linenumber || ':' || l_partkey || ':' || l_suppkey, '|' ORDER BY l_linenumber, l_partkey, l_suppkey)) AS state, sha256(string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey, l_suppkey))[1:16] AS geometry, count(*) AS n FROM lineitem GROUP BY 1""")
def state_keys(spark, d):
    """The digest of all that an order's lines say, and a short one of their places alone: keys by which stored results are known to be fresh."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    held = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("all"))
    whole = F.array_join(F.transform("all", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"), x["l_suppkey"].cast("string"))), "|")
    places = F.array_join(F.transform("all", lambda x: x["l_partkey"].cast("string")), ",")
    return held.select("l_orderkey", F.sha2(whole, 256).alias("state"), F.left(F.sha2(places, 256), F.lit(16)).alias("geometry"), F.size("all").cast("long").alias("n"))


@query("""WITH o AS (SELECT o_orderkey AS k, epoch_us(o_orderdate) // 1000000 + o_custkey % 50000 AS a, o_custkey % 3 = 0 AS fb, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey * 31 % 86400 END AS g1, CASE WHEN o_orderkey % 4 > 1 THEN o_orderkey * 37 % 86400 END AS g2, o_orderkey * 41 % 86400 AS dl, o_orderkey * 43 % 86400 AS op FROM orders),
t AS (SELECT *, a + 20000 AS z, CASE WHEN k % 5 > 0 THEN a + 3000 END AS c FROM o), n AS (SELECT *, coalesce(c, a) AS r FROM t),
m AS (SELECT *, CASE WHEN NOT fb THEN least(r // 86400 * 86400 + g1 + CASE WHEN r // 86400 * 86400 + g1 - r > 43200 THEN -86400 WHEN r - (r // 86400 * 86400 + g1) > 43200 THEN 86400 ELSE 0 END, coalesce(r // 86400 * 86400 + g2 + CASE WHEN r // 86400 * 86400 + g2 - r > 43200 THEN -86400 WHEN r - (r // 86400 * 86400 + g2) > 43200 THEN 86400 ELSE 0 END, 9e18::BIGINT)) END AS g,
  z // 86400 * 86400 + dl + CASE WHEN z // 86400 * 86400 + dl - z > 43200 THEN -86400 WHEN z - (z // 86400 * 86400 + dl) > 43200 THEN 86400 ELSE 0 END AS e, CASE WHEN NOT fb THEN a // 86400 * 86400 + op + CASE WHEN a // 86400 * 86400 + op - a > 43200 THEN -86400 WHEN a - (a // 86400 * 86400 + op) > 43200 THEN 86400 ELSE 0 END END AS b FROM n),
x AS (SELECT k, CASE WHEN g1 IS NOT NULL THEN g END AS gate, b, e FROM m),
y AS (SELECT k, gate, b, CASE WHEN gate IS NULL OR e > gate THEN e END AS deadline FROM x)
SELECT k AS o_orderkey, gate, deadline, CASE WHEN (deadline IS NULL OR b < deadline) AND (gate IS NULL OR b <= gate) THEN b END AS opens FROM y""")
def timing_windows(spark, d):
    """Gates, deadline and opening of an order as a flight, from times of the day, without those that are mistakes."""
    k, a = F.col("o_orderkey"), seconds(F.col("o_orderdate")) + F.col("o_custkey") % 50_000
    gates = F.filter(F.array(F.when(k % 4 > 0, k * 31 % 86_400), F.when(k % 4 > 1, k * 37 % 86_400)), lambda g: g.isNotNull())
    times = tasks.timing(gates, k * 41 % 86_400, k * 43 % 86_400, F.when(k % 5 > 0, a + 3000), a, a + 20_000, F.col("o_custkey") % 3 == 0)
    own = table(spark, d, "orders").select("o_orderkey", times.alias("t"))
    return own.select("o_orderkey", F.get("t.gates", F.lit(0)).alias("gate"), "t.deadline", "t.opens")
