"""Queries of field analysis and their SQL; registered with the catalogue's."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import air
from ..functions.numbers import shown
from ..operators import aggregates, components, field, gaggles, metrics, routes, sequence, windows
from .catalog import FIXES, fixes, query, table

ONE = f"{FIXES}, p AS (SELECT user_id, t, max(value) AS value FROM fixes GROUP BY ALL)"


def tracks(spark, d):
    """events as tracks with one row a time: the highest value of it."""
    return fixes(spark, d).groupBy("user_id", "t").agg(F.max("value").alias("value"))


@query(f"""WITH {FIXES} SELECT user_id, max(value) AS highest, first(event_id ORDER BY value DESC, t, event_id) AS highest_event, min(value) AS lowest, first(event_id ORDER BY value, t, event_id) AS lowest_event
FROM fixes GROUP BY 1""")
def track_extremes(spark, d):
    found = field.extremes(fixes(spark, d), ["user_id"], "value", "t", "event_id")
    return found.select("user_id", "highest", F.col("highest_at.event_id").alias("highest_event"), "lowest", F.col("lowest_at.event_id").alias("lowest_event"))


@query(f"""WITH {ONE}, s AS (SELECT *, t - lag(t) OVER w AS dt, value - lag(value) OVER w AS dv FROM p WINDOW w AS (PARTITION BY user_id ORDER BY t))
SELECT user_id, count(*) AS n, max(t) - min(t) AS seconds, max(value) AS highest, round(coalesce(sum(CASE WHEN dv > 0 THEN dv ELSE 0 END), 0), 4) AS gained, quantile_cont(dt, 0.5) AS interval FROM s GROUP BY 1""")
def flight_summary(spark, d):
    return field.summary(tracks(spark, d), ["user_id"], "t", "value").withColumn("gained", shown(F.col("gained"), 4))


EVERY = 500


@query(f"""WITH {ONE}, s AS (SELECT user_id, t, round(value * 100)::BIGINT AS v FROM p),
q AS (SELECT user_id, t, lag(t) OVER w AS t0, coalesce(abs(v - lag(v) OVER w), 0) AS step FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t)),
c AS (SELECT user_id, t0, t, step, (sum(step) OVER (PARTITION BY user_id ORDER BY t))::BIGINT AS upto FROM q),
m AS (SELECT *, unnest(generate_series((upto - step) // {EVERY * 100} + 1, upto // {EVERY * 100}))::BIGINT AS marker FROM c)
SELECT user_id, marker, round(t0 + (marker * {EVERY * 100} - (upto - step)) / step::DOUBLE * (t - t0), 3) AS t FROM m""")
def distance_markers(spark, d):
    # hundredths as whole numbers, so that sums are exact
    whole = tracks(spark, d).withColumn("value", F.round(F.col("value") * 100).cast("long"))
    at = windows.W.partitionBy("user_id").orderBy("t")
    steps = whole.withColumn("step", F.abs(F.col("value") - F.lag("value").over(at)).cast("double"))
    return field.markers(steps, ["user_id"], "t", F.col("step"), EVERY * 100.0).select("user_id", "marker", shown(F.col("t"), 3).alias("t"))


@query(f"""WITH {ONE}, s AS (SELECT *, lag(t) OVER w AS t0, lag(value) OVER w AS v0 FROM p WINDOW w AS (PARTITION BY user_id ORDER BY t))
SELECT user_id, round(t0 + (50 - v0) / (value - v0) * (t - t0), 3) AS t, value >= 50 AS up FROM s WHERE (v0 >= 50) <> (value >= 50)""")
def level_passages(spark, d):
    return field.passages(tracks(spark, d), ["user_id"], "t", "value", 50.0).withColumn("t", shown(F.col("t"), 3))


@query(f"""WITH {ONE}, s AS (SELECT user_id, t, value, last(t) OVER w AS t1, last(value) OVER w AS v1 FROM p WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN CURRENT ROW AND 86400 FOLLOWING))
SELECT user_id, round(max(CASE WHEN t1 > t THEN (v1 - value) / (t1 - t) END), 6) AS best FROM s GROUP BY 1""")
def sustained_rate(spark, d):
    return field.sustained(tracks(spark, d), ["user_id"], "t", "value", 86400).withColumn("best", shown(F.col("best")))


@query(f"""WITH {FIXES}, s AS (SELECT *, t - lag(t) OVER w AS dt, value - lag(value) OVER w AS dv FROM fixes WINDOW w AS (PARTITION BY event_type ORDER BY t, value)),
c AS (SELECT event_type, count_if(dt > 0 AND abs(dv) > 0.05 * dt) AS jumps, count_if(dt > 7200) AS gaps, count_if(dt = 0) AS repeats FROM s GROUP BY 1)
SELECT event_type, jumps::BIGINT AS jumps, gaps::BIGINT AS gaps, repeats::BIGINT AS repeats, concat_ws(',', CASE WHEN jumps > 0 THEN 'jumps' END, CASE WHEN gaps > 0 THEN 'gaps' END, CASE WHEN repeats > 0 THEN 'repeats' END) AS findings FROM c""")
def track_quality(spark, d):
    return field.quality(fixes(spark, d), ["event_type"], "t", "value", 0.05, 7200).withColumn("findings", F.array_join("findings", ","))


LEGS = "l AS (SELECT l_suppkey AS task, l_orderkey AS pilot, l_linenumber AS leg, min(l_quantity) AS hours FROM lineitem GROUP BY 1, 2, 3)"


@query(f"""WITH {LEGS}, a AS (SELECT *, min(hours) OVER (PARTITION BY task, leg) AS best, sum(hours) OVER (PARTITION BY task, pilot ORDER BY leg) AS total FROM l)
SELECT task, pilot, leg, hours, best, hours - best AS behind, total, rank() OVER (PARTITION BY task, leg ORDER BY total) AS place, total - min(total) OVER (PARTITION BY task, leg) AS lost FROM a""")
def leg_times(spark, d):
    l = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("task"), F.col("l_orderkey").alias("pilot"), F.col("l_linenumber").alias("leg")).agg(F.min("l_quantity").alias("hours"))  # noqa: E741
    return field.legs(l, ["task"], "pilot", "leg", "hours").select("task", "pilot", "leg", "hours", "best", "behind", "total", "place", "lost")


@query("""SELECT l_suppkey, l_linenumber, round(quantile_cont(l_extendedprice / l_quantity, 0.5), 8) AS ratio, count(*) AS n FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2""")
def leg_median_ratio(spark, d):
    ratio = F.col("l_extendedprice") / F.col("l_quantity")
    return table(spark, d, "lineitem").filter("l_quantity > 0").groupBy("l_suppkey", "l_linenumber").agg(shown(F.percentile(ratio, 0.5), 8).alias("ratio"), F.count("*").alias("n"))


@query("""WITH h AS (SELECT event_type, (epoch_us(ts) // 3600000000) % 24 AS hour, quantile_cont(value, 0.5) AS median, count(*) AS n FROM events GROUP BY 1, 2),
b AS (SELECT *, max(n) OVER (PARTITION BY event_type) AS most FROM h)
SELECT event_type, hour, round(median, 6) AS median, n FROM b WHERE n >= 0.2 * most QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY median DESC, hour) = 1""")
def best_conditions_hour(spark, d):
    hours = fixes(spark, d).withColumn("hour", F.floor(F.col("t") / 3600).cast("long") % 24)
    return field.best_hour(hours, ["event_type"], "hour", "value").withColumn("median", shown(F.col("median")))


@query("""WITH e AS (SELECT l_suppkey AS task, l_returnflag AS metric, l_quantity AS x, l_extendedprice AS y FROM lineitem),
r AS (SELECT task, metric, rank() OVER (PARTITION BY task, metric ORDER BY x) + (count(*) OVER (PARTITION BY task, metric, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY task, metric ORDER BY y) + (count(*) OVER (PARTITION BY task, metric, y) - 1) / 2.0 AS ry FROM e),
c AS (SELECT task, metric, corr(rx, ry) AS rho, count(*) AS n FROM r GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT metric, round(sum(abs(rho) * n) / sum(n), 6) AS strength, round(sum(rho * n) / sum(n), 6) AS signed, count_if(rho > 0)::BIGINT AS up, count_if(rho < 0)::BIGINT AS down, count(*) AS tasks FROM c WHERE rho IS NOT NULL AND NOT isnan(rho) GROUP BY 1""")
def correlation_across_tasks(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("task"), F.col("l_returnflag").alias("metric"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    each = aggregates.spearman(e, ["task", "metric"], "x", "y").filter("n >= 3")
    return field.across_tasks(each, ["metric"], "rho", "n").withColumns({"strength": shown(F.col("strength")), "signed": shown(F.col("signed"))})


@query("""SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus = 'P', o_totalprice DESC, o_orderkey) AS place FROM orders""")
def withheld_below(spark, d):
    return field.listed(table(spark, d, "orders"), ["o_orderpriority"], F.col("o_orderstatus") == "P", F.col("o_totalprice").desc(), F.col("o_orderkey")).select("o_orderkey", "o_orderpriority", "place")


@query(f"""WITH {ONE}, b AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > 43200 THEN 1 ELSE 0 END AS fresh FROM p),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t) + 1 AS session FROM b), i AS (SELECT user_id, session, min(t) AS b, max(t) AS e FROM s GROUP BY 1, 2),
w AS (SELECT user_id, t // 604800 AS week, min(t) AS b2, max(t) AS e2 FROM p GROUP BY 1, 2)
SELECT user_id, session::BIGINT AS session, week, least(e, e2) - greatest(b, b2) AS seconds FROM i JOIN w USING (user_id) WHERE b < e2 AND b2 < e""")
def phase_leg_overlap(spark, d):
    one = tracks(spark, d)
    phases = windows.sessions(one, ["user_id"], "t", 43200).groupBy("user_id", "session").agg(F.min("t").alias("begin"), F.max("t").alias("end"))
    weeks = one.groupBy("user_id", F.floor(F.col("t") / 604800).cast("long").alias("week")).agg(F.min("t").alias("begin2"), F.max("t").alias("end2"))
    return field.shared_time(phases, weeks, ["user_id"], 604800).select("user_id", "session", "week", "seconds")


@query("""SELECT c_nationkey, min(c_acctbal) AS lo, max(c_acctbal) AS hi, round((min(c_acctbal) + max(c_acctbal)) / 2, 4) AS centre, round(avg(greatest(0, c_acctbal - 1000)), 4) AS over_minimum FROM customer GROUP BY 1""")
def bounds_and_mean_over_minimum(spark, d):
    x = F.col("c_acctbal")
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.min(x).alias("lo"), F.max(x).alias("hi"), shown((F.min(x) + F.max(x)) / 2, 4).alias("centre"), shown(F.avg(F.greatest(F.lit(0.0), x - 1000)), 4).alias("over_minimum"))


@query(f"""WITH {FIXES}, c AS (SELECT event_type, event_id, t, CASE WHEN event_id % 9 = 0 THEN 0 ELSE event_id % 7 + 900 END AS pressure, CASE WHEN event_id % 11 = 0 THEN 0 WHEN event_id % 13 = 0 THEN 4000 ELSE event_id % 17 + 950 END AS gnss FROM fixes),
u AS (SELECT *, CASE WHEN gnss <> 0 AND pressure <> 0 THEN gnss - pressure END AS differ FROM c),
m AS (SELECT *, quantile_cont(differ, 0.5) OVER (PARTITION BY event_type ORDER BY t RANGE BETWEEN 60 PRECEDING AND 60 FOLLOWING) AS usual, avg((gnss = 0)::INT) OVER (PARTITION BY event_type) AS g0, avg((pressure = 0)::INT) OVER (PARTITION BY event_type) AS p0, count(*) OVER (PARTITION BY event_type) AS n FROM u)
SELECT event_id, CASE WHEN g0 < 0.5 AND p0 < 0.5 AND n >= 10 AND pressure <> 0 AND usual IS NOT NULL AND (gnss = 0 OR abs(differ - usual) > 150) THEN pressure + usual END AS cleaned_alt FROM m""")
def altitude_repair(spark, d):
    i = F.col("event_id")
    pressure, gnss = F.when(i % 9 == 0, 0).otherwise(i % 7 + 900), F.when(i % 11 == 0, 0).when(i % 13 == 0, 4000).otherwise(i % 17 + 950)
    tracks_ = fixes(spark, d).select("event_type", "event_id", i.alias("fix_index"), (F.col("t") * 1000).alias("time_ms"), pressure.alias("pressure_alt"), gnss.alias("gnss_alt"))
    return routes.repaired(tracks_, ["event_type"]).select("event_id", "cleaned_alt")


@query("""SELECT p_partkey, round(44330.77 * (1 - pow(p_retailprice / 1013.25, 0.1902632)), 4) AS height, round(1013.25 * pow(1 - p_size / 44330.77, 1 / 0.1902632), 4) AS pressure, CASE WHEN p_size - 20 > 0 THEN 125.0::DOUBLE * (p_size - 20) END AS base FROM part""")
def air_scalars(spark, d):
    return table(spark, d, "part").select("p_partkey", shown(air.height_of(F.col("p_retailprice")), 4).alias("height"), shown(air.pressure_at(F.col("p_size")), 4).alias("pressure"), air.cloud_base(F.col("p_size"), F.lit(20)).alias("base"))


@query()
def optimised_routes(spark, d):
    """Orders as tasks, their lines as turnpoints: where to touch each cylinder, and the way."""
    k = F.col("l_partkey")
    points = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("task"), F.col("l_linenumber").alias("tp")).agg(F.max(k).alias("k"))
    k = F.col("k")
    return routes.optimised(points.select("task", F.col("tp").cast("int").alias("tp"), (F.lit(-36.0) + k % 97 / 200).alias("plat"), (F.lit(147.0) + k % 89 / 200).alias("plon"), (F.lit(400.0) + k % 5 * 400).alias("radius")))


@query("""WITH own AS (SELECT l_suppkey AS task, o_custkey AS pilot, l_linenumber AS leg, l_quantity AS q, l_discount AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
starts AS (SELECT task, pilot, min(q) + 100 AS start_t, CASE WHEN max(leg) >= 3 THEN sum(q) * 60 + 1000 END AS ess_t FROM own GROUP BY 1, 2),
climbs AS (SELECT task, pilot, leg AS thermal, leg * 600.0::DOUBLE + q AS b, leg * 600.0::DOUBLE + q + 60 + q AS e, x * 5000 AS lo, x * 5000 + q * 20 AS hi FROM own),
glides AS (SELECT task, pilot, leg, leg * 600.0::DOUBLE + q - 300 AS b, leg * 600.0::DOUBLE + q - 100 AS e, q * 100 AS metres, x * 1000 + 60 AS lost FROM own),
legs AS (SELECT task, pilot, leg, max(q) * 30 AS seconds, max(q) * 1000 AS flown, max(q) * 900 AS optimised FROM own GROUP BY 1, 2, 3),
rc AS (SELECT c.* FROM climbs c JOIN starts s USING (task, pilot) WHERE b >= start_t), rg AS (SELECT g.*, e - b AS seconds FROM glides g JOIN starts s USING (task, pilot) WHERE b >= start_t),
pc AS (SELECT task, pilot, e - b AS w, 100 * percent_rank() OVER (PARTITION BY task, thermal ORDER BY (hi - lo) / greatest(1, e - b)) AS pct, count(*) OVER (PARTITION BY task, thermal) AS n FROM climbs),
bl AS (SELECT task, pilot, leg, sum(metres) / sum(lost) AS ratio FROM rg GROUP BY 1, 2, 3 HAVING sum(lost) >= 50), us AS (SELECT task, leg, quantile_cont(ratio, 0.5) AS usual FROM bl GROUP BY 1, 2),
nx AS (SELECT task, pilot, b::BIGINT AS t, max((hi - lo) / (e - b)) AS climb FROM climbs WHERE e > b GROUP BY ALL), en AS (SELECT task, pilot, e::BIGINT AS t, metres / seconds * 3.6 AS kmh FROM rg),
pr AS (SELECT en.task, en.pilot, kmh, nx.climb FROM en ASOF JOIN nx ON en.task = nx.task AND en.pilot = nx.pilot AND en.t <= nx.t WHERE nx.t - en.t <= 300),
mi AS (SELECT task, pilot, quantile_cont(climb, 0.5) AS middle FROM pr GROUP BY 1, 2 HAVING count(*) >= 4),
fl AS (SELECT task, pilot, sum(flown) AS flown, sum(optimised) AS optimised FROM legs GROUP BY 1, 2),
mk AS (SELECT DISTINCT r.task, r.pilot, r.thermal, r.b, EXISTS (SELECT 1 FROM climbs o WHERE o.task = r.task AND o.thermal = r.thermal AND o.pilot <> r.pilot AND o.b <= r.b - 30 AND o.e >= r.b) AS led FROM rc r),
pl AS (SELECT *, row_number() OVER (PARTITION BY task, leg ORDER BY seconds, pilot) AS place FROM legs), be AS (SELECT *, avg(CASE WHEN place <= 10 THEN seconds END) OVER (PARTITION BY task, leg) AS best FROM pl),
m AS (SELECT task, pilot, 'climb.shared_percentile' AS metric, sum(pct * greatest(0.001, w)) / sum(greatest(0.001, w)) AS value FROM pc WHERE n > 1 GROUP BY 1, 2
  UNION ALL SELECT task, pilot, 'climb.departure_band', quantile_cont(hi / 1500, 0.5) * 100 FROM rc GROUP BY 1, 2
  UNION ALL SELECT s.task, s.pilot, 'decision.low_saves', count(r.task) FROM starts s LEFT JOIN rc r ON r.task = s.task AND r.pilot = s.pilot AND lo < 225 AND hi - lo >= 300 GROUP BY 1, 2
  UNION ALL SELECT task, pilot, 'glide.speed', sum(metres) / sum(seconds) * 3.6 FROM rg GROUP BY 1, 2
  UNION ALL SELECT task, pilot, 'glide.ld_vs_field', avg(ratio / usual) FROM bl JOIN us USING (task, leg) GROUP BY 1, 2
  UNION ALL SELECT task, pilot, 'glide.stf_proxy', avg(CASE WHEN climb > middle THEN kmh END) - avg(CASE WHEN climb < middle THEN kmh END) FROM pr JOIN mi USING (task, pilot) GROUP BY 1, 2
  UNION ALL SELECT task, pilot, 'glide.extra_distance', (flown / optimised - 1) * 100 FROM fl
  UNION ALL SELECT task, pilot, 'decision.km_between_climbs', flown / 1000 / n FROM fl JOIN (SELECT task, pilot, count(*) AS n FROM rc GROUP BY 1, 2) USING (task, pilot) WHERE flown >= 20000
  UNION ALL SELECT task, pilot, 'gaggle.affinity', 100 * avg((lo > 200)::INT) FROM rc GROUP BY 1, 2
  UNION ALL SELECT task, pilot, 'gaggle.marker_usage', 100 * avg(led::INT) FROM mk GROUP BY 1, 2 HAVING count(*) >= 3
  UNION ALL SELECT task, pilot, 'race.start_delay', start_t - 100 FROM starts
  UNION ALL SELECT task, pilot, 'race.leg_time_lost', sum(greatest(0, seconds - best)) FROM be GROUP BY 1, 2
  UNION ALL SELECT task, pilot, 'race.time_behind', (ess_t - min(ess_t) OVER (PARTITION BY task)) / 60 FROM starts WHERE ess_t IS NOT NULL)
SELECT task, pilot, metric, round(value::DOUBLE, 6) AS value FROM m WHERE value IS NOT NULL""")
def field_metrics(spark, d):
    """Orders as tasks of a supplier, customers as pilots: every metric of theirs, from made-up starts, climbs and glides."""
    l = table(spark, d, "lineitem").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("pilot")), "l_orderkey")  # noqa: E741
    own = l.select(F.col("l_suppkey").alias("task"), "pilot", F.col("l_linenumber").alias("leg"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("x"))
    # joined once and kept by pilot: the metrics read it some twenty times
    own = components.kept(own.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "task", "pilot"))
    starts = own.groupBy("task", "pilot").agg((F.min("q") + 100).alias("start_t"), F.lit(100.0).alias("official_start"), F.when(F.max("leg") >= 3, F.sum("q") * 60 + 1000).alias("ess_t"))
    begin = F.col("leg") * 600.0 + F.col("q")
    climbs = own.select("task", "pilot", F.col("leg").alias("thermal"), begin.alias("start_t"), (begin + 60 + F.col("q")).alias("end_t"), (F.col("x") * 5000).alias("start_alt"), (F.col("x") * 5000 + F.col("q") * 20).alias("end_alt"))
    glides = own.select("task", "pilot", "leg", (begin - 300).alias("start_t"), (begin - 100).alias("end_t"), (F.col("q") * 100).alias("metres"), (F.col("x") * 1000 + 60).alias("lost"))
    legs = own.groupBy("task", "pilot", "leg").agg((F.max("q") * 30).alias("seconds"), (F.max("q") * 1000).alias("flown"), (F.max("q") * 900).alias("optimised"))
    bands = own.groupBy("task").agg(F.lit(0.0).alias("lo"), F.lit(1500.0).alias("hi"))
    steps = climbs.select("task", "pilot", F.col("start_t").alias("t"), (F.col("start_alt") > 200).alias("together"))
    return metrics.field_metrics(starts, climbs, glides, legs, bands, steps).withColumn("value", shown(F.col("value")))


def _positions(spark, d):
    """events as places of pilots around a point every three hours, a task a week and hundred users."""
    e = fixes(spark, d)
    task = F.floor(F.col("t") / 604800).cast("long") * 1_000_000 + F.floor(F.col("user_id") / 100)
    return e.select(task.cast("long").alias("task"), (F.floor(F.col("t") / 10800) * 10800).cast("long").alias("t"), F.col("user_id").cast("long").alias("pilot"), "value", "event_id")


@query()
def gaggle_episodes(spark, d):
    one = _positions(spark, d).groupBy("task", "t", "pilot").agg(F.max("value").alias("value"))
    return gaggles.gaggles(one.select("task", F.col("t").cast("long").alias("t"), "pilot", (F.col("pilot") % 7 * 150.0).alias("east"), (F.col("value") * 4).alias("north"), (F.col("pilot") % 5 * 100.0).alias("alt")), bridge=21600.0, least_seconds=10800.0)


@query()
def turnpoint_paths(spark, d):
    """Users as pilots on lines north from a point, `value` percent of 20 km out; one task: leave 4 km, reach 12 km, come back to 6 km."""
    lat = lambda km: -36.0 + km / 110.95
    w = windows.W.partitionBy("pilot").orderBy("t")
    own = tracks(spark, d).select(F.lit("t").alias("task"), F.col("user_id").alias("pilot"), F.col("t").cast("double").alias("t"), (F.lit(-36.0) + F.least(F.col("value"), F.lit(100.0)) * 0.2 / 110.95).alias("lat"), F.lit(147.0).alias("lon"))
    shown_ = own.withColumn("fix_index", F.row_number().over(w).cast("long"))
    points = spark.createDataFrame([("t", 0, "exit", lat(0), 147.0, 4000.0), ("t", 1, "enter", lat(14), 147.0, 2000.0), ("t", 2, "enter", lat(4), 147.0, 2000.0)], "task string, tp int, way string, plat double, plon double, radius double")
    rules = spark.createDataFrame([("t", 0, 2, 2, "exit", None, None, None, False)], "task string, start int, ess int, goal int, start_way string, opens double, closes double, gates array<double>, fallback boolean")
    return sequence.resolved(shown_, points, rules, ["pilot"])
