"""Every registered query with the SQL that says the same, by name.

The tables at hand have no tracklogs; users of `events` stand for pilots, their events for fixes, and
`value` for a height; orders and customers stand for results. Doubles are rounded to 6 places in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import gap, stats
from ..functions.geo import ellipsoid_metres
from ..functions.numbers import half_up, micros, seconds, shown
from ..operators import aggregates, clustering, components, joins, search, windows
from . import scoring

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def fixes(spark: SparkSession, d: str) -> DataFrame:
    """events as tracks: event_id, user_id, event_type, t (seconds), value."""
    return table(spark, d, "events").select("event_id", "user_id", "event_type", seconds(F.col("ts")).alias("t"), "value")


FIXES = "fixes AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000000 AS t, value FROM events)"

# --- ranks -----------------------------------------------------------------------------------------


@query("""SELECT c_custkey, c_nationkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS rank FROM customer""")
def rank_competition(spark, d):
    return windows.competition_rank(table(spark, d, "customer"), ["c_nationkey"], F.col("c_acctbal").desc()).select("c_custkey", "c_nationkey", "rank")


@query("""
SELECT o_custkey, o_orderpriority, floor(best + 0.5)::BIGINT AS published,
       rank() OVER (PARTITION BY o_orderpriority ORDER BY floor(best + 0.5) DESC) AS rank
FROM (SELECT o_custkey, o_orderpriority, max(o_totalprice / 1000) AS best FROM orders GROUP BY ALL)""")
def rank_published_ties(spark, d):
    best = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.max(F.col("o_totalprice") / 1000).alias("best"))
    shown_ = best.withColumn("published", half_up(F.col("best")).cast("long"))
    return windows.competition_rank(shown_, ["o_orderpriority"], F.col("published").desc()).select("o_custkey", "o_orderpriority", "published", "rank")


@query("""SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS position FROM customer""")
def rank_position(spark, d):
    return windows.position(table(spark, d, "customer"), ["c_mktsegment"], F.col("c_acctbal").desc(), F.col("c_custkey")).select("c_custkey", "position")


AVERAGE_RANK = "rank() OVER (PARTITION BY {g} ORDER BY {v}) + (count(*) OVER (PARTITION BY {g}, {v}) - 1) / 2.0"


@query("SELECT c_custkey, " + AVERAGE_RANK.format(g="c_nationkey", v="band") + " AS rank FROM (SELECT *, floor(c_acctbal / 1000) AS band FROM customer)")
def rank_avg_ties(spark, d):
    banded = table(spark, d, "customer").withColumn("band", F.floor(F.col("c_acctbal") / 1000))
    return windows.average_rank(banded, ["c_nationkey"], "band", "rank").select("c_custkey", "rank")


@query("""SELECT c_custkey, round(100 * percent_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal), 6) AS pct FROM customer""")
def percent_rank_group(spark, d):
    pct = F.percent_rank().over(W.partitionBy("c_nationkey").orderBy("c_acctbal")) * 100
    return table(spark, d, "customer").select("c_custkey", shown(pct).alias("pct"))


@query("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS arrival FROM orders""")
def arrival_order(spark, d):
    return windows.position(table(spark, d, "orders"), ["o_orderstatus"], F.col("o_orderdate"), F.col("o_orderkey"), name="arrival").select("o_orderkey", "arrival")


# --- correlation and statistics ----------------------------------------------------------------------


@query("""SELECT l_returnflag, l_linestatus, round(corr(l_quantity, l_extendedprice), 6) AS r, count(*) AS n FROM lineitem GROUP BY ALL""")
def pearson_by_group(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(shown(F.corr("l_quantity", "l_extendedprice")).alias("r"), F.count("*").alias("n"))


SPEARMAN = f"""
per AS (SELECT c_custkey, c_nationkey, c_acctbal, count(o_orderkey) AS orders
        FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
ranked AS (SELECT c_nationkey, {AVERAGE_RANK.format(g='c_nationkey', v='c_acctbal')} AS x, {AVERAGE_RANK.format(g='c_nationkey', v='orders')} AS y FROM per),
rho AS (SELECT c_nationkey, count(*) AS n, CASE WHEN count(*) >= 3 AND isfinite(corr(x, y)) THEN corr(x, y) END AS rho FROM ranked GROUP BY ALL)"""


def _spearman(spark, d):
    per = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    counted = per.groupBy("c_custkey", "c_nationkey", "c_acctbal").agg(F.count("o_orderkey").cast("double").alias("orders"))
    return aggregates.spearman(counted, ["c_nationkey"], "c_acctbal", "orders")


@query("WITH " + SPEARMAN + " SELECT c_nationkey, n, round(rho, 6) AS rho FROM rho")
def spearman_by_group(spark, d):
    return _spearman(spark, d).select("c_nationkey", "n", shown(F.col("rho")).alias("rho"))


T_SQL = f"""CASE WHEN n - 2 = 1 THEN {stats.T1} WHEN n - 2 = 2 THEN {stats.T2} ELSE
  {stats.Z} + ({stats.Z}**3 + {stats.Z}) / (4.0 * (n - 2)) + (5 * {stats.Z}**5 + 16 * {stats.Z}**3 + 3 * {stats.Z}) / (96.0 * (n - 2)**2)
  + (3 * {stats.Z}**7 + 19 * {stats.Z}**5 + 17 * {stats.Z}**3 - 15 * {stats.Z}) / (384.0 * (n - 2)**3) END"""


@query(f"""WITH {SPEARMAN},
floors AS (SELECT *, CASE WHEN n >= 3 THEN least(1.0, t / sqrt(n - 2 + t * t)) END AS noise FROM (SELECT *, {T_SQL} AS t FROM rho WHERE n <> 2))
SELECT c_nationkey, round(noise, 6) AS noise,
  CASE WHEN n < 8 THEN 'n too small' WHEN abs(rho) < noise THEN 'within noise' WHEN abs(rho) >= 0.5 THEN 'strong' WHEN abs(rho) >= 0.3 THEN 'moderate' ELSE 'weak' END AS verdict
FROM floors""")
def correlation_verdict(spark, d):
    found = _spearman(spark, d).filter("n <> 2")
    return found.select("c_nationkey", shown(stats.noise_floor(F.col("n"))).alias("noise"), stats.verdict(F.abs("rho"), F.col("n")).alias("verdict"))


@query("""SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, count(*) AS n, """ + ", ".join(f"round(quantile_cont(value, {p / 100}), 6) AS p{p}" for p in (10, 25, 50, 75, 90)) + " FROM events GROUP BY 1")
def percentiles_by_hour(spark, d):
    hour = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("hour")
    parts = [shown(F.percentile("value", F.lit(p / 100))).alias(f"p{p}") for p in (10, 25, 50, 75, 90)]
    return table(spark, d, "events").groupBy(hour).agg(F.count("*").alias("n"), *parts)


@query("""SELECT user_id, CASE WHEN count(*) < 10 THEN round(min(value), 6) ELSE round(quantile_cont(value, 0.1), 6) END AS low,
  CASE WHEN count(*) < 10 THEN round(max(value), 6) ELSE round(quantile_cont(value, 0.9), 6) END AS high FROM events GROUP BY 1""")
def working_band(spark, d):
    few = F.count("*") < 10
    low, high = (F.when(few, edge("value")).otherwise(F.percentile("value", F.lit(p))) for edge, p in ((F.min, 0.1), (F.max, 0.9)))
    return table(spark, d, "events").groupBy("user_id").agg(shown(low).alias("low"), shown(high).alias("high"))


@query("""SELECT user_id, round(quantile_disc(value, 0.5), 6) AS lower_median FROM events GROUP BY 1""")
def lower_median(spark, d):
    # places by rank in sorted, spillable partitions: no user's values meet in one array
    of = W.partitionBy("user_id")
    placed = table(spark, d, "events").select("user_id", "value", F.row_number().over(of.orderBy("value")).alias("at"), F.count("*").over(of).alias("n"))
    return placed.filter(F.col("at") == F.floor((F.col("n") - 1) / 2) + 1).select("user_id", shown(F.col("value")).alias("lower_median"))


@query("""SELECT event_type, round(CASE WHEN degrees(atan2(e, n)) < 0 THEN degrees(atan2(e, n)) + 360 ELSE degrees(atan2(e, n)) END, 6) AS direction, round(sqrt(e * e + n * n), 6) AS strength
FROM (SELECT event_type, avg(sin(radians((value * 7) % 360)) * value) AS e, avg(cos(radians((value * 7) % 360)) * value) AS n FROM events GROUP BY 1)""")
def circular_mean(spark, d):
    direction, strength = aggregates.circular_mean((F.col("value") * 7) % 360, F.col("value"))
    return table(spark, d, "events").groupBy("event_type").agg(shown(direction).alias("direction"), shown(strength).alias("strength"))


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
e AS (SELECT *, n * 100 / sum(n) OVER (PARTITION BY user_id) AS exact FROM c),
f AS (SELECT *, floor(exact) AS whole, row_number() OVER (PARTITION BY user_id ORDER BY round(exact - floor(exact), 9) DESC, event_type) AS r FROM e)
SELECT user_id, event_type, (whole + CASE WHEN r <= 100 - sum(whole) OVER (PARTITION BY user_id) THEN 1 ELSE 0 END)::BIGINT AS share FROM f""")
def largest_remainder(spark, d):
    counted = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return aggregates.largest_remainder(counted, ["user_id"], "n", ["event_type"]).select("user_id", "event_type", "share")


@query("""
WITH p AS (SELECT l_returnflag, l_linestatus, l_quantity AS x, l_discount * 500 AS y FROM lineitem),
s AS (SELECT *, x - avg(x) OVER g AS u, y - avg(y) OVER g AS v, avg(x) OVER g AS mx, avg(y) OVER g AS my FROM p WINDOW g AS (PARTITION BY l_returnflag, l_linestatus)),
m AS (SELECT l_returnflag, l_linestatus, any_value(mx) AS mx, any_value(my) AS my, sum(u*u) AS uu, sum(v*v) AS vv, sum(u*v) AS uv, sum(u*(u*u+v*v)) AS uz, sum(v*(u*u+v*v)) AS vz, avg(u*u+v*v) AS z FROM s GROUP BY ALL),
c AS (SELECT *, (uz*vv - vz*uv) / (2*(uu*vv - uv*uv)) AS a, (vz*uu - uz*uv) / (2*(uu*vv - uv*uv)) AS b FROM m)
SELECT l_returnflag, l_linestatus, round(mx + a, 4) AS cx, round(my + b, 4) AS cy, round(sqrt(z + a*a + b*b), 4) AS radius FROM c""")
def circle_fit(spark, d):
    points = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").alias("x"), (F.col("l_discount") * 500).alias("y"))
    fit = aggregates.circle_fit(points, ["l_returnflag", "l_linestatus"], "x", "y")
    return fit.select("l_returnflag", "l_linestatus", *[shown(F.col(c), 4).alias(c) for c in ("cx", "cy", "radius")])


@query("""SELECT l_shipmode, round((sw*sxy - sx*sy) / (sw*sxx - sx*sx), 6) AS slope FROM (
SELECT l_returnflag || l_linestatus AS l_shipmode, sum(w) AS sw, sum(w*x) AS sx, sum(w*y) AS sy, sum(w*x*x) AS sxx, sum(w*x*y) AS sxy
FROM (SELECT *, l_quantity AS x, l_extendedprice / 1000 AS y, l_linenumber AS w FROM lineitem) GROUP BY ALL)""")
def weighted_slope_lean(spark, d):
    slope = aggregates.weighted_slope(F.col("l_quantity"), F.col("l_extendedprice") / 1000, F.col("l_linenumber"))
    return table(spark, d, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("l_shipmode")).agg(shown(slope).alias("slope"))


# --- windows over tracks -------------------------------------------------------------------------------

WINDOW = 6 * 3600


@query(f"WITH {FIXES} SELECT event_id, round(quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN {WINDOW} PRECEDING AND {WINDOW} FOLLOWING), 6) AS median FROM fixes")
def rolling_median(spark, d):
    return windows.rolling_median(fixes(spark, d), ["user_id"], "t", "value", WINDOW).select("event_id", shown(F.col("median")).alias("median"))


@query(f"WITH {FIXES} SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN {WINDOW} PRECEDING AND {WINDOW} FOLLOWING), 6) AS mean FROM fixes")
def rolling_mean_centered(spark, d):
    return windows.centred_mean(fixes(spark, d), ["user_id"], "t", "value", WINDOW).select("event_id", shown(F.col("mean")).alias("mean"))


@query(f"""WITH {FIXES}, r AS (SELECT event_id, t - lag(t, 10) OVER w AS dt, value - lag(value, 10) OVER w AS dv FROM fixes WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT event_id, round(CASE WHEN dt > 0 THEN dv / dt * 3600 END, 6) AS rate FROM r""")
def trailing_rate(spark, d):
    return windows.trailing_rate(fixes(spark, d), ["user_id"], "t", "value", 10).select("event_id", shown(F.col("rate") * 3600).alias("rate"))


@query(f"""WITH {FIXES}, m AS (SELECT *, min(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS least FROM fixes),
g AS (SELECT *, coalesce(lag(least) OVER (PARTITION BY user_id ORDER BY t, event_id) - least, 0) AS gained FROM m)
SELECT user_id, round(min(least), 6) AS least, round(sum(gained), 6) AS gained, count(*) FILTER (gained > 0) AS falls FROM g GROUP BY 1""")
def ratchet_min(spark, d):
    r = windows.ratchet(fixes(spark, d), ["user_id"], "t", "value")
    return r.groupBy("user_id").agg(shown(F.min("least")).alias("least"), shown(F.sum("gained")).alias("gained"), F.sum((F.col("gained") > 0).cast("long")).alias("falls"))


@query(f"""WITH {FIXES}, s AS (SELECT *, value > 40 AS hit, value > 40 AND NOT coalesce(lag(value > 40) OVER w, false) AS begins FROM fixes WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
n AS (SELECT *, sum(begins::INT) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS island FROM s)
SELECT user_id, island::BIGINT AS island, min(t) AS first_t, max(t) AS last_t, count(*) AS n FROM n WHERE hit GROUP BY 1, 2""")
def islands_above_threshold(spark, d):
    found = windows.islands(fixes(spark, d), ["user_id"], ["t", "event_id"], F.col("value") > 40)
    return found.groupBy("user_id", "island").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count("*").alias("n"))


@query(f"""WITH {FIXES}, s AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > 7200, true) AS fresh FROM fixes),
n AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS session FROM s)
SELECT user_id, session::BIGINT AS session, min(t) AS first_t, max(t) AS last_t, count(*) AS n FROM n GROUP BY 1, 2""")
def session_gap(spark, d):
    found = windows.sessions(fixes(spark, d), ["user_id"], "t", 7200)
    return found.groupBy("user_id", "session").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count("*").alias("n"))


@query("""SELECT user_id, round(sum(CASE WHEN event_type = 'click' THEN value END) / sum(value), 6) AS click_share, count(*) FILTER (event_type = 'click') AS clicks FROM events GROUP BY 1""")
def phase_share(spark, d):
    click = F.col("event_type") == "click"
    return table(spark, d, "events").groupBy("user_id").agg(shown(F.sum(F.when(click, F.col("value"))) / F.sum("value")).alias("click_share"), F.sum(click.cast("long")).alias("clicks"))


ASOF = f"""WITH {FIXES}, a AS (SELECT * FROM fixes WHERE event_type = 'purchase'), b AS (SELECT user_id, t, max(value) AS found FROM fixes WHERE event_type = 'click' GROUP BY ALL)"""


def _sides(spark, d):
    f = fixes(spark, d)
    return f.filter("event_type = 'purchase'").select("event_id", "user_id", "t"), f.filter("event_type = 'click'").groupBy("user_id", "t").agg(F.max("value").alias("found"))


@query(ASOF + " SELECT a.event_id, round(b.found, 6) AS found FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.t >= b.t")
def asof_backward(spark, d):
    return windows.asof_backward(*_sides(spark, d), ["user_id"], "t", ["found"]).select("event_id", shown(F.col("found")).alias("found"))


@query(ASOF + " SELECT a.event_id, round(CASE WHEN b.t - a.t <= 86400 THEN b.found END, 6) AS found FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.t <= b.t")
def asof_forward_tol(spark, d):
    return windows.asof_forward(*_sides(spark, d), ["user_id"], "t", ["found"], within=86400).select("event_id", shown(F.col("found")).alias("found"))


STEP, HOLE = 6 * 3600, 3 * 86400


@query(f"""WITH {FIXES}, p AS (SELECT user_id, t, max(value) AS value FROM fixes GROUP BY ALL),
q AS (SELECT user_id, t AS t0, value AS v0, lead(t) OVER w AS t1, lead(value) OVER w AS v1 FROM p WINDOW w AS (PARTITION BY user_id ORDER BY t)),
g AS (SELECT *, unnest(generate_series(((t0 + {STEP - 1}) // {STEP}) * {STEP}, ((coalesce(t1, t0 + 1) - 1) // {STEP}) * {STEP}, {STEP})) AS t FROM q)
SELECT user_id, t, round(CASE WHEN t = t0 THEN v0 WHEN t1 - t0 <= {HOLE} THEN v0 + (t - t0) / (t1 - t0)::DOUBLE * (v1 - v0) END, 6) AS value FROM g""")
def grid_resample_lerp(spark, d):
    one = fixes(spark, d).groupBy("user_id", "t").agg(F.max("value").alias("value"))
    return windows.resampled(one, ["user_id"], "t", "value", STEP, HOLE).select("user_id", "t", shown(F.col("value")).alias("value"))


# --- interval and range joins ----------------------------------------------------------------------------


@query(f"""WITH {FIXES}, a AS (SELECT event_id, user_id, t AS b, t + 3600 AS e FROM fixes WHERE event_type = 'view'), z AS (SELECT user_id, t AS b, t + 7200 AS e FROM fixes WHERE event_type = 'purchase')
SELECT event_id FROM a WHERE EXISTS (SELECT 1 FROM z WHERE z.user_id = a.user_id AND a.b <= z.e AND z.b <= a.e)""")
def interval_overlap_semi(spark, d):
    f = fixes(spark, d)
    span = lambda kind, n: f.filter(F.col("event_type") == kind).select("event_id", "user_id", F.col("t").alias("begin"), (F.col("t") + n).alias("end"))
    return joins.overlapping(span("view", 3600), span("purchase", 7200), ["user_id"], 14_400).select("event_id")


@query(f"""WITH {FIXES} SELECT event_id FROM fixes a WHERE EXISTS (SELECT 1 FROM fixes b WHERE b.event_type = a.event_type AND b.user_id <> a.user_id AND a.t - b.t BETWEEN 30 AND 600)""")
def marker_exists(spark, d):
    f = fixes(spark, d)
    return joins.preceded(f, f.select("event_type", "t", "user_id"), ["event_type"], "t", "user_id", 30, 600).select("event_id")


@query("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')""")
def not_exists_two(spark, d):
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    done, urgent = orders.filter("o_orderstatus = 'F'").select("c_custkey"), orders.filter(F.col("o_orderpriority").like("1%")).select("c_custkey")
    return table(spark, d, "customer").join(done, "c_custkey", "left_anti").join(urgent, "c_custkey", "left_anti").select("c_custkey")


@query("""
WITH a AS (SELECT p_partkey AS id, lower(p_name || ' ' || p_brand) AS name FROM part WHERE p_partkey % 2 = 0), b AS (SELECT p_partkey AS other, lower(p_name || ' ' || p_brand) AS name FROM part WHERE p_partkey % 2 = 1),
x AS (SELECT name, min(id) AS id FROM a GROUP BY 1 HAVING count(DISTINCT id) = 1), y AS (SELECT name, min(other) AS other FROM b GROUP BY 1 HAVING count(DISTINCT other) = 1)
SELECT id, other FROM x JOIN y USING (name)""")
def ambiguous_name_match(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lower(F.concat_ws(" ", "p_name", "p_brand")).alias("name"))
    return joins.unambiguous(part.filter("id % 2 = 0"), part.filter("id % 2 = 1").withColumnRenamed("id", "other"), "name", "id", "other")


@query("""
SELECT s_suppkey, coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN a.c_custkey IS NOT NULL THEN 'id' WHEN b.c_custkey IS NOT NULL THEN 'nation' END AS match
FROM supplier LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) a ON a.c_custkey = s_suppkey
LEFT JOIN (SELECT c_nationkey, min(c_custkey) AS c_custkey FROM customer WHERE c_acctbal > 5000 GROUP BY 1) b ON b.c_nationkey = s_nationkey""")
def resolve_by_priority(spark, d):
    left, right = table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), table(spark, d, "customer").filter("c_acctbal > 5000").select("c_custkey", "c_nationkey")
    rules = [("id", "s_suppkey", "c_custkey"), ("nation", "s_nationkey", "c_nationkey")]
    return joins.prioritised(left, right, rules, [F.col("c_custkey")]).select("s_suppkey", "c_custkey", "match")


GRID_POINTS = "SELECT p_partkey AS id, p_size AS task, (p_partkey * 7919 % 1000)::DOUBLE AS east, (p_retailprice * 10 % 1000)::DOUBLE AS north FROM part"


def _points(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("task"), (F.col("p_partkey") * 7919 % 1000).cast("double").alias("east"), (F.col("p_retailprice") * 10 % 1000).alias("north"))


@query(f"WITH p AS ({GRID_POINTS}) SELECT a.task, a.id AS a, b.id AS b FROM p a JOIN p b ON a.task = b.task AND a.id < b.id AND sqrt((a.east - b.east)**2 + (a.north - b.north)**2) <= 120")
def nearby_pairs(spark, d):
    return joins.nearby_pairs(_points(spark, d), ["task"], "east", "north", "id", 120.0)


@query(f"""WITH RECURSIVE p AS ({GRID_POINTS}), e AS (SELECT a.id AS u, b.id AS v FROM p a JOIN p b ON a.task = b.task AND a.id <> b.id AND sqrt((a.east - b.east)**2 + (a.north - b.north)**2) <= 120),
r(node, root) AS (SELECT DISTINCT u, u FROM e UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.node)
SELECT node, min(root) AS component FROM r GROUP BY 1""")
def connected_components(spark, d):
    found = components.near_components(_points(spark, d), ["task"], "id", "east", "north", 120.0, repeated=True)
    return found.filter("not alone").select(F.col("id").alias("node"), "component").distinct()


# --- scoring -----------------------------------------------------------------------------------------------


@query("""
WITH task AS (SELECT o_custkey AS pilot, o_orderpriority AS task, max(o_totalprice / 300) AS score FROM orders GROUP BY ALL),
best AS (SELECT task, max(score) AS winner FROM task GROUP BY 1),
goal AS (SELECT CASE WHEN count(*) >= 7 THEN 0.75 ELSE 0.8 END * sum(winner / 1000) AS target FROM best),
each AS (SELECT t.*, winner, winner / 1000 AS size, score / winner AS performance, target FROM task t JOIN best USING (task), goal),
run AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY pilot ORDER BY performance DESC, score DESC, task ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM each)
SELECT task, pilot, round(score * greatest(0, least(1, (target - prior) / size)), 4) AS counted FROM run""")
def ftv_capped_cumsum(spark, d):
    scores = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("pilot"), F.col("o_orderpriority").alias("task")).agg(F.max(F.col("o_totalprice") / 300).alias("score"))
    return scoring.series(scores, "task", "pilot", "score").select("task", "pilot", shown(F.col("counted"), 4).alias("counted"))


FLIGHTS = """
flights AS (
  SELECT o_orderpriority AS task, o_custkey AS pilot, max(o_totalprice) / 4 AS distance, bool_or(o_orderstatus = 'F') AS goal,
         (count(*) * 600 + (o_custkey % 977))::DOUBLE AS time, o_custkey % 17 <> 0 AS flying
  FROM orders GROUP BY o_orderpriority, o_custkey)"""


def flights(spark, d) -> DataFrame:
    """Orders as flights: one for each customer (pilot) and priority (task)."""
    own = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("task"), F.col("o_custkey").alias("pilot")).agg(
        (F.max("o_totalprice") / 4).alias("distance"), F.max(F.col("o_orderstatus") == "F").alias("goal"), F.count("*").alias("n")
    )
    time = (F.col("n") * 600 + F.col("pilot") % 977).cast("double")
    return own.select("task", "pilot", "distance", "goal", F.col("goal").alias("ess"), F.when(F.col("goal"), time).alias("time"), F.when(F.col("goal"), time).alias("ess_time"), F.lit(None).cast("double").alias("leading"), F.lit(True).alias("present"), (F.col("pilot") % 17 != 0).alias("flying"), F.lit(0.0).alias("penalty"))


@query(f"""
WITH {FLIGHTS},
floored AS (SELECT task, pilot, goal AND flying AS goal, flying, CASE WHEN flying THEN greatest(distance, 5000) ELSE 0 END AS distance, CASE WHEN goal THEN time END AS time, goal AS ess FROM flights),
field AS (
  SELECT task, count(*) AS present, count(*) FILTER (flying) AS n, count(*) FILTER (goal) AS in_goal, max(distance) FILTER (flying) AS best,
         min(time) FILTER (flying AND ess AND time > 0) AS best_time, sum(greatest(0, distance - 5000)) FILTER (flying) AS over_min FROM floored GROUP BY 1),
valid AS (
  SELECT *, in_goal / n AS g, least(1.0, n / (present * 0.96)) AS lr,
    least(1.0, greatest(0.0, over_min / (n * ((1.3 * (70000 - 5000) + greatest(0, 0.3 * (best - 70000))) / 2)))) AS dv,
    least(1.0, CASE WHEN best_time IS NOT NULL THEN best_time / 5400 ELSE best / 70000 END) AS tr FROM field),
day AS (
  SELECT *, least(1.0, greatest(0.0, 0.028 * lr + 2.917 * lr**2 - 1.944 * lr**3)) * dv * least(1.0, greatest(0.0, -0.271 + 2.912 * tr - 2.098 * tr**2 + 0.457 * tr**3)) AS v,
    0.9 - 1.665 * g + 1.713 * g**2 - 0.587 * g**3 AS dw, 0.26 AS ltr FROM valid),
scored AS (
  SELECT f.task, f.pilot,
    CASE WHEN flying THEN distance / best ELSE 0 END * 1000 * v * dw AS dp,
    CASE WHEN goal AND time > 0 THEN CASE WHEN time <= best_time THEN 1.0 ELSE greatest(0.0, 1 - pow((time - best_time) / 3600 / sqrt(best_time / 3600), 5.0 / 6)) END ELSE 0 END
      * 1000 * v * greatest(0.0, 1 - dw - CASE WHEN g = 0 THEN 1 - dw ELSE (1 - dw) * ltr END) AS tp
  FROM floored f JOIN day USING (task)),
total AS (SELECT *, floor((dp + tp) * 10 + 0.5) / 10 AS total FROM scored)
SELECT task, pilot, round(dp, 4) AS distance_points, round(tp, 4) AS time_points, total, rank() OVER (PARTITION BY task ORDER BY total DESC) AS rank FROM total""")
def points_pipeline(spark, d):
    own = flights(spark, d)
    flown = own.withColumn("goal", F.col("goal") & F.col("flying"))
    scored = scoring.score_flights(flown, ["task"], "pilot", {"scoring": "PG", "leading": True})
    return scored.select("task", "pilot", shown(F.col("distance_points"), 4).alias("distance_points"), shown(F.col("time_points"), 4).alias("time_points"), "total", "rank")


@query(f"""
WITH {FLIGHTS},
fl AS (SELECT task, pilot, goal AND flying AS goal, goal AS ess, flying, CASE WHEN flying THEN greatest(distance, 5000) ELSE 0 END AS distance, CASE WHEN goal THEN time END AS time FROM flights),
field AS (SELECT task, count(*) AS present, count(*) FILTER (flying) AS n, count(*) FILTER (goal) AS in_goal, count(*) FILTER (flying AND ess) AS at_ess, max(distance) FILTER (flying) AS best, min(time) FILTER (flying AND ess AND time > 0) AS best_time, sum(greatest(0, distance - 5000)) FILTER (flying) AS over_min,
  count(*) FILTER (flying AND NOT goal) AS landed, coalesce(max(greatest(floor(distance / 100), 50)) FILTER (flying AND NOT goal), 50)::BIGINT AS last FROM fl GROUP BY 1),
va AS (SELECT *, in_goal / n AS g, least(1.0, n / (present * 0.96)) AS lr, least(1.0, greatest(0.0, over_min / (n * ((1.3 * 65000 + greatest(0, 0.3 * (best - 70000))) / 2)))) AS dv, least(1.0, CASE WHEN best_time IS NOT NULL THEN best_time / 5400 ELSE best / 70000 END) AS tr FROM field),
da AS (SELECT *, least(1.0, greatest(0.0, 0.028 * lr + 2.917 * lr**2 - 1.944 * lr**3)) * dv * least(1.0, greatest(0.0, -0.271 + 2.912 * tr - 2.098 * tr**2 + 0.457 * tr**3)) AS v, 0.9 - 1.665 * g + 1.713 * g**2 - 0.587 * g**3 AS dw FROM va),
av AS (SELECT *, 1000 * v * dw AS ad, 1000 * v * CASE WHEN at_ess = 0 THEN 0 ELSE greatest(0.0, (1 - dw) * 7 / 8) END AS at0, 1000 * v * CASE WHEN at_ess = 0 THEN 0 ELSE (1 - dw) / 8 END AS aa FROM da),
sized AS (SELECT task, landed, ((last + 10) // 10) * 10 AS size, greatest(30, floor(30 * (best / 1000) / greatest(landed, 1) + 0.5))::BIGINT AS look FROM field),
hist AS (SELECT task, greatest(floor(distance / 100), 50)::BIGINT AS slot, count(*) AS n FROM fl WHERE flying AND NOT goal GROUP BY ALL UNION ALL SELECT task, 50, 1 FROM sized WHERE landed = 0),
grid AS (SELECT task, look, unnest(range(0, size)) AS slot FROM sized),
hard AS (SELECT g.task, g.slot, coalesce((SELECT sum(n) FROM hist h WHERE h.task = g.task AND h.slot BETWEEN g.slot AND g.slot + g.look - 1), 0) AS difficulty FROM grid g),
rel AS (SELECT *, 0.5 * difficulty / sum(difficulty) OVER (PARTITION BY task) AS relative FROM hard),
cum AS (SELECT *, sum(relative) OVER (PARTITION BY task ORDER BY slot ROWS UNBOUNDED PRECEDING) AS total, sum(CASE WHEN slot <= 50 THEN relative END) OVER (PARTITION BY task) AS seed FROM rel),
st AS (SELECT task, slot, CASE WHEN slot <= 50 THEN seed ELSE total END AS score FROM cum),
wi AS (SELECT fl.*, av.* EXCLUDE (task), a.score AS here, b.score AS after, distance / 100 - floor(distance / 100) AS part, row_number() OVER (PARTITION BY fl.task ORDER BY time NULLS LAST, pilot) AS pos FROM fl JOIN av USING (task)
  LEFT JOIN st a ON a.task = fl.task AND a.slot = floor(distance / 100) LEFT JOIN st b ON b.task = fl.task AND b.slot = floor(distance / 100) + 1),
sh AS (SELECT *, CASE WHEN goal THEN 1.0 WHEN ess THEN 0.8 ELSE 0 END AS kept, CASE WHEN goal THEN 1.0 ELSE 0.5 * distance / best + coalesce(CASE WHEN after > here THEN here + (after - here) * part ELSE here END, 0.5) END AS share, 1 - (pos - 1) / at_ess AS q FROM wi),
sc AS (SELECT task, pilot, CASE WHEN flying AND best > 0 THEN share ELSE 0 END * ad AS dp,
  CASE WHEN ess AND time > 0 THEN CASE WHEN time <= best_time THEN 1.0 ELSE greatest(0.0, 1 - pow((time - best_time) / 3600 / sqrt(best_time / 3600), 5.0 / 6)) END * kept ELSE 0 END * at0 AS tp,
  CASE WHEN ess AND time IS NOT NULL THEN (0.2 + 0.037 * q + 0.13 * q * q + 0.633 * q * q * q) * kept ELSE 0 END * aa AS ap FROM sh),
tt AS (SELECT *, floor((dp + tp + ap) * 10 + 0.5) / 10 AS total FROM sc)
SELECT task, pilot, round(dp, 4) AS distance_points, round(tp, 4) AS time_points, round(ap, 4) AS arrival_points, total, rank() OVER (PARTITION BY task ORDER BY total DESC) AS rank FROM tt""")
def points_pipeline_hg(spark, d):
    scored = scoring.score_flights(flights(spark, d).withColumn("goal", F.col("goal") & F.col("flying")), ["task"], "pilot", {"scoring": "HG", "arrival": True})
    return scored.select("task", "pilot", *[shown(F.col(c), 4).alias(c) for c in ("distance_points", "time_points", "arrival_points")], "total", "rank")


@query("""
WITH f AS (SELECT o_orderpriority AS task, o_totalprice / 4 AS distance, o_orderstatus = 'F' AS goal FROM orders),
field AS (SELECT task, max(distance) AS best, count(*) FILTER (NOT goal) AS landed, coalesce(max(greatest(floor(distance / 100), 50)) FILTER (NOT goal), 50)::BIGINT AS last FROM f GROUP BY 1),
sized AS (SELECT task, ((last + 10) // 10) * 10 AS size, greatest(30, floor(30 * (best / 1000) / greatest(landed, 1) + 0.5))::BIGINT AS look FROM field),
hist AS (SELECT task, greatest(floor(distance / 100), 50)::BIGINT AS slot, count(*) AS n FROM f WHERE NOT goal GROUP BY ALL),
grid AS (SELECT task, look, unnest(range(0, size)) AS slot FROM sized),
hard AS (SELECT g.task, g.slot, coalesce((SELECT sum(n) FROM hist h WHERE h.task = g.task AND h.slot BETWEEN g.slot AND g.slot + g.look - 1), 0) AS difficulty FROM grid g),
rel AS (SELECT *, 0.5 * difficulty / sum(difficulty) OVER (PARTITION BY task) AS relative FROM hard),
cum AS (SELECT *, sum(relative) OVER (PARTITION BY task ORDER BY slot ROWS UNBOUNDED PRECEDING) AS total, sum(CASE WHEN slot <= 50 THEN relative END) OVER (PARTITION BY task) AS seed FROM rel)
SELECT task, slot, difficulty::BIGINT AS difficulty, round(CASE WHEN slot <= 50 THEN seed ELSE total END, 6) AS score FROM cum""")
def distance_difficulty(spark, d):
    f = table(spark, d, "orders").select(F.col("o_orderpriority").alias("task"), (F.col("o_totalprice") / 4).alias("distance"), (F.col("o_orderstatus") == "F").alias("goal"))
    found = aggregates.distance_difficulty(f, ["task"])
    return found.select("task", "slot", F.col("difficulty").cast("long").alias("difficulty"), shown(F.col("score")).alias("score"))


@query("""
WITH s AS (SELECT o_orderpriority AS task, avg(o_totalprice / 1000) AS mean, max(o_totalprice / 1000) AS best, coalesce(stddev_samp(o_totalprice / 1000), 0) AS dev, count(*) FILTER (o_orderstatus = 'O') AS landed, count(*) AS n FROM orders GROUP BY 1)
SELECT task, round(least(1.0, sqrt(greatest((best - mean) / (900 - best + 1) * sqrt(dev / 5), 0)) + pow(landed / n, 3)), 6) AS validity FROM s""")
def stopped_stddev_validity(spark, d):
    km = F.col("o_totalprice") / 1000
    s = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("task")).agg(F.avg(km).alias("mean"), F.max(km).alias("best"), F.coalesce(F.stddev_samp(km), F.lit(0.0)).alias("dev"), F.sum((F.col("o_orderstatus") == "O").cast("long")).alias("landed"), F.count("*").alias("n"))
    validity = gap.stopped_validity(F.col("best"), F.col("mean"), F.col("dev"), F.lit(900.0), F.col("landed"), F.col("n"), F.lit(0))
    return s.select("task", shown(validity).alias("validity"))


LEAD = " + ".join(f"({c!r} * p)" if e == 0 else f"({c!r} * (pow(10.0, {e} * p) - 1) / ({e} * ln(10.0)))" for c, e in gap.leading_weight_terms())


@query(f"SELECT l_orderkey, l_linenumber, round({LEAD}, 6) AS integral FROM (SELECT *, l_quantity / 50 AS p FROM lineitem)")
def leading_weight_integral(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", shown(gap.leading_weight_integral(F.col("l_quantity") / 50)).alias("integral"))


@query("""SELECT task, pilot, distance, rank() OVER (PARTITION BY task ORDER BY distance DESC) AS rank
FROM (SELECT o_orderstatus AS task, o_custkey AS pilot, max(o_totalprice) AS distance FROM orders GROUP BY ALL)""")
def open_distance(spark, d):
    f = table(spark, d, "orders").select(F.col("o_orderstatus").alias("task"), F.col("o_custkey").alias("pilot"), F.col("o_totalprice").alias("distance"))
    return scoring.open_distance(f, ["task"], "pilot")


@query("""
SELECT o_custkey, """ + ", ".join(f"floor(coalesce(max(CASE WHEN o_orderpriority LIKE '{i}%' THEN o_totalprice END), 0) + 0.5)::BIGINT AS task{i}" for i in range(1, 6)) + ", floor(sum(o_totalprice) + 0.5)::BIGINT AS total FROM orders GROUP BY 1")
def scores_wide(spark, d):
    task = [half_up(F.coalesce(F.max(F.when(F.col("o_orderpriority").like(f"{i}%"), F.col("o_totalprice"))), F.lit(0.0))).cast("long").alias(f"task{i}") for i in range(1, 6)]
    # doubles are added in the file's order, as SQL adds them: a total that ends in .5 goes up or down with its last bit
    row = F.struct("_metadata.file_path", "_metadata.row_index")
    orders = table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_totalprice", row.alias("row"))
    so_far = F.sum("o_totalprice").over(W.partitionBy("o_custkey").orderBy("row").rowsBetween(W.unboundedPreceding, W.currentRow))
    return orders.withColumn("so_far", so_far).groupBy("o_custkey").agg(*task, half_up(F.max_by("so_far", "row")).cast("long").alias("total"))


@query("""SELECT l_returnflag, arg_max(l_orderkey, l_extendedprice * 1000000 - l_orderkey) AS best, sum(CASE WHEN l_tax > 0.05 THEN 1 ELSE 0 END)::BIGINT AS high_tax, coalesce(sum(CASE WHEN l_quantity > 1000 THEN l_quantity END), 0) AS none FROM lineitem GROUP BY 1""")
def sum_case_and_best(spark, d):
    order = F.col("l_extendedprice") * 1000000 - F.col("l_orderkey")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.max_by("l_orderkey", order).alias("best"), F.sum(F.when(F.col("l_tax") > 0.05, 1).otherwise(0)).alias("high_tax"), F.coalesce(F.sum(F.when(F.col("l_quantity") > 1000, F.col("l_quantity"))), F.lit(0.0)).alias("none"))


# --- relational forms ----------------------------------------------------------------------------------------


@query("SELECT c_nationkey, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) = 1")
def best_per_key(spark, d):
    first = windows.position(table(spark, d, "customer"), ["c_nationkey"], F.col("c_acctbal").desc(), F.col("c_custkey")).filter("position = 1")
    return first.select("c_nationkey", "c_custkey", "c_acctbal")


@query("SELECT o_orderkey, o_custkey FROM orders JOIN (SELECT o_custkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY 1) USING (o_custkey, o_orderdate)")
def latest_snapshot(spark, d):
    orders = table(spark, d, "orders")
    latest = orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("o_orderdate"))
    return orders.join(latest, ["o_custkey", "o_orderdate"]).select("o_orderkey", "o_custkey")


@query("SELECT c_nationkey AS nation FROM customer WHERE c_acctbal < 0 UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, d):
    return table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_nationkey").alias("nation")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("SELECT * FROM (SELECT c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT s_name, s_acctbal FROM supplier) ORDER BY balance DESC, name LIMIT 25")
def union_all_topk(spark, d):
    both = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")).unionAll(table(spark, d, "supplier").select("s_name", "s_acctbal"))
    return both.orderBy(F.col("balance").desc(), "name").limit(25)


@query("SELECT user_id, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS total, count(DISTINCT json_extract(props, '$.k')::BIGINT) AS kinds FROM events GROUP BY 1")
def json_extract_group(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").groupBy("user_id").agg(F.sum(k).alias("total"), F.countDistinct(k).alias("kinds"))


@query("""SELECT key, count(*) AS n, sum(json_extract_string(props, '$.' || key)::BIGINT)::BIGINT AS total FROM (SELECT props, unnest(json_keys(props)) AS key FROM events) GROUP BY 1""")
def json_explode(spark, d):
    """The members of each event's JSON object as rows."""
    members = table(spark, d, "events").select(F.explode(F.from_json("props", "map<string,bigint>")).alias("key", "value"))
    return members.groupBy("key").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%ed%' AND lower(p_name) LIKE '%g%'")
def like_tokens_and(spark, d):
    name = F.lower("p_name")
    return table(spark, d, "part").filter(name.like("%ed%") & name.like("%g%")).select("p_partkey")


TERMS = ["license", "the", "permission"]


@query(f"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: t <> '') AS w FROM documents),
c AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM w),
h AS (SELECT doc_id, len(w) AS length, unnest(list_filter(w, lambda t: t IN {tuple(TERMS)!r})) AS term FROM w),
tf AS (SELECT doc_id, length, term, count(*) AS tf FROM h GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)
SELECT doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM tf JOIN df USING (term), c GROUP BY 1""")
def bm25_search(spark, d):
    return search.bm25(table(spark, d, "documents"), "doc_id", "text", TERMS).select("doc_id", shown(F.col("score")).alias("score"))


@query("""
WITH r AS (SELECT n_regionkey, n_name, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT r_name, n_name, c_custkey, n > 3 AS truncated FROM r JOIN region ON r_regionkey = n_regionkey WHERE rn <= 3""")
def rollup_caps(spark, d):
    small = table(spark, d, "nation").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    of = W.partitionBy("c_nationkey")
    capped = table(spark, d, "customer").withColumn("rn", F.row_number().over(of.orderBy("c_custkey"))).withColumn("n", F.count("*").over(of)).filter("rn <= 3")
    return capped.join(small, F.col("n_nationkey") == F.col("c_nationkey")).select("r_name", "n_name", "c_custkey", (F.col("n") > 3).alias("truncated"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey < 500 ORDER BY o_orderkey DESC LIMIT 40")
def keyset_page(spark, d):
    return table(spark, d, "orders").filter("o_orderkey < 500").orderBy(F.col("o_orderkey").desc()).limit(40).select("o_orderkey", "o_orderdate")


@query("SELECT c_custkey, c_name FROM customer ORDER BY lower(c_name), c_custkey LIMIT 30 OFFSET 60")
def offset_page(spark, d):
    return table(spark, d, "customer").orderBy(F.lower("c_name"), "c_custkey").offset(60).limit(30).select("c_custkey", "c_name")


@query("""
WITH up AS (SELECT o_custkey AS k, o_totalprice AS v, 1 AS gen FROM orders WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)
SELECT c_custkey AS k, coalesce(v, c_acctbal) AS v FROM customer LEFT JOIN up ON k = c_custkey
UNION ALL SELECT k, v FROM up WHERE k NOT IN (SELECT c_custkey FROM customer)""")
def upsert(spark, d):
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.lit(0).alias("gen"), F.lit(0).cast("long").alias("seq"))
    fresh = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), F.lit(1).alias("gen"), F.col("o_orderkey").alias("seq"))
    return base.unionByName(fresh).groupBy("k").agg(F.max_by("v", F.struct("gen", "seq")).alias("v"))


# --- clustering and geodesy ------------------------------------------------------------------------------------


def _metrics(spark, d):
    """Four numbers for each customer; a field is a hundred customers, so pairs within fields grow with the table."""
    o = table(spark, d, "orders").groupBy((F.floor(F.col("o_custkey") / 100)).cast("long").alias("field"), F.col("o_custkey").alias("pilot"))
    price = F.col("o_totalprice")
    each = o.agg(F.avg(price).alias("mean"), F.max(price).alias("most"), F.stddev_samp(price).alias("dev"), F.count("*").cast("double").alias("n"))
    return each.unpivot(["field", "pilot"], ["mean", "most", "dev", "n"], "metric", "value").filter("value is not null").withColumn("value", F.round("value", 4))


METRICS = """WITH e AS (SELECT o_custkey // 100 AS field, o_custkey AS pilot, avg(o_totalprice) AS mean, max(o_totalprice) AS most, stddev_samp(o_totalprice) AS dev, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2),
m AS (SELECT field, pilot, metric, round(value, 4) AS value FROM (UNPIVOT e ON mean, most, dev, n INTO NAME metric VALUE value) WHERE value IS NOT NULL)"""


@query(METRICS + """, p AS (SELECT field, pilot, metric, percent_rank() OVER (PARTITION BY field, metric ORDER BY value) AS pct FROM m)
SELECT a.field, a.pilot AS a, b.pilot AS b, round(avg(abs(a.pct - b.pct)), 6) AS distance FROM p a JOIN p b ON a.field = b.field AND a.metric = b.metric AND a.pilot < b.pilot GROUP BY 1, 2, 3 HAVING count(*) >= 3""")
def gower_distance(spark, d):
    pct = clustering.percentile_columns(_metrics(spark, d), ["field"], "metric", "value")
    return clustering.pair_distances(pct, ["field"], "pilot", "metric", "pct").select("field", "a", "b", shown(F.col("distance")).alias("distance"))


@query()
def ward_clusters(spark, d):
    pct = clustering.percentile_columns(_metrics(spark, d), ["field"], "metric", "value")
    return clustering.style_clusters(clustering.pair_distances(pct, ["field"], "pilot", "metric", "pct"), ["field"])


_A, _B, _F = 6378137.0, 6356752.314245, 1 / 298.257223563


@query(f"""WITH RECURSIVE e AS (SELECT event_id, user_id % 90 - 45 + value / 100 AS lat, event_id % 360 - 180.0::DOUBLE AS lon FROM events),
u AS (SELECT event_id, lat, lon, radians(147.9::DOUBLE - lon) AS dl, atan((1 - {_F!r}) * tan(radians(lat))) AS u1, atan((1 - {_F!r}) * tan(radians(-36.2::DOUBLE))) AS u2 FROM e),
s AS (SELECT event_id, lat, lon, dl, sin(u1) AS s1, cos(u1) AS c1, sin(u2) AS s2, cos(u2) AS c2 FROM u),
r AS (SELECT *, 0 AS k, dl AS l, true AS moving, NULL::DOUBLE AS ss, NULL::DOUBLE AS cs, NULL::DOUBLE AS ca, NULL::DOUBLE AS cm FROM s
  UNION ALL SELECT event_id, lat, lon, dl, s1, c1, s2, c2, k + 1, n, abs(n - l) > 1e-12, ss, cs, ca, cm FROM (
    SELECT *, dl + (1 - cc) * {_F!r} * sa * (atan2(ss, cs) + cc * ss * (cm + cc * cs * (2 * cm * cm - 1))) AS n FROM (
      SELECT *, {_F!r} / 16 * ca * (4 + {_F!r} * (4 - 3 * ca)) AS cc FROM (
        SELECT *, CASE WHEN ca > 0 THEN cs - 2 * s1 * s2 / ca ELSE 0 END AS cm FROM (
          SELECT *, 1 - sa * sa AS ca FROM (
            SELECT *, CASE WHEN ss > 0 THEN c1 * c2 * sin(l) / ss ELSE 0 END AS sa FROM (
              SELECT event_id, lat, lon, dl, s1, c1, s2, c2, k, l, sqrt(pow(c2 * sin(l), 2) + pow(c1 * s2 - s1 * c2 * cos(l), 2)) AS ss, s1 * s2 + c1 * c2 * cos(l) AS cs FROM r WHERE moving AND k < 100)))))) ),
f AS (SELECT * FROM r WHERE k > 0 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY k DESC) = 1),
v AS (SELECT *, ca * {(_A * _A - _B * _B) / (_B * _B)!r} AS v, radians((lat - 36.2) / 2) AS p, radians((lat + 36.2) / 2) AS q, radians(147.9 - lon) / 2 AS h FROM f),
g AS (SELECT *, 1 + v / 16384 * (4096 + v * (-768 + v * (320 - 175 * v))) AS big, v / 1024 * (256 + v * (-128 + v * (74 - 47 * v))) AS small,
  pow(sin(q), 2) * pow(cos(h), 2) + pow(cos(p), 2) * pow(sin(h), 2) AS ns, pow(cos(q), 2) * pow(cos(h), 2) + pow(sin(p), 2) * pow(sin(h), 2) AS nc FROM v),
w AS (SELECT *, small * ss * (cm + small / 4 * (cs * (2 * cm * cm - 1) - small / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3))) AS d, atan2(sqrt(ns), sqrt(nc)) AS angle FROM g)
SELECT event_id, round(CASE WHEN moving OR abs(l) > pi() THEN 2 * angle * {_A!r} * (1 + {_F!r} * ((3 * sqrt(ns * nc) / angle - 1) / (2 * nc) * pow(sin(p), 2) * pow(cos(q), 2) - (3 * sqrt(ns * nc) / angle + 1) / (2 * ns) * pow(cos(p), 2) * pow(sin(q), 2)))
  WHEN ss = 0 THEN 0 ELSE {_B!r} * big * (atan2(ss, cs) - d) END, 2) AS metres FROM w""")
def ellipsoid_distance(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("user_id") % 90 - 45 + F.col("value") / 100).alias("lat"), (F.col("event_id") % 360 - 180.0).alias("lon"))
    return e.select("event_id", shown(ellipsoid_metres("lat", "lon", F.lit(-36.2), F.lit(147.9)), 2).alias("metres"))
