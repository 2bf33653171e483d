"""Queries over rates, leading areas, early starts, winds and legs, with their SQL; registered with the catalogue's."""

from __future__ import annotations

from math import log

from pyspark.sql import functions as F

from ..functions import gap
from ..functions.numbers import shown
from ..operators import aggregates, windows
from . import scoring
from .catalog import FIXES, FLIGHTS, fixes, flights, query, table
from .field import ONE, tracks


@query(f"""WITH {ONE}, r AS (SELECT user_id, t, (value - lag(value, 5) OVER w) / (t - lag(t, 5) OVER w) * 3600 AS rate FROM p WINDOW w AS (PARTITION BY user_id ORDER BY t)),
e AS (SELECT user_id, count(*) AS n, max(rate) AS up, first(t ORDER BY rate DESC NULLS LAST, t) AS up_at, min(rate) AS down, first(t ORDER BY rate NULLS LAST, t) AS down_at FROM r GROUP BY 1)
SELECT user_id, round(CASE WHEN up > 0.1 THEN up END, 6) AS climb_rate, CASE WHEN up > 0.1 THEN up_at END AS climb_at, round(CASE WHEN down < -0.1 THEN down END, 6) AS sink_rate, CASE WHEN down < -0.1 THEN down_at END AS sink_at FROM e WHERE n >= 10""")
def rate_extremes(spark, d):
    """Strongest rise and fall of a track over five rows, units an hour."""
    found = windows.rate_extremes(tracks(spark, d).withColumn("value", F.col("value") * 3600), ["user_id"], "t", "value", 5, 0.1, -0.1)
    return found.select("user_id", shown(F.col("climb_rate")).alias("climb_rate"), "climb_at", shown(F.col("sink_rate")).alias("sink_rate"), "sink_at")


@query(f"""WITH {ONE}, b AS (SELECT user_id, t, value, coalesce(first(t) OVER x, lag(t) OVER w) AS t0, coalesce(first(value) OVER x, lag(value) OVER w) AS v0 FROM p
  WINDOW w AS (PARTITION BY user_id ORDER BY t), x AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING)),
r AS (SELECT user_id, t, (value - v0) / (t - t0) AS rate FROM b),
k AS (SELECT *, max(rate) OVER (PARTITION BY user_id) AS peak, min(t) OVER (PARTITION BY user_id) AS t1 FROM r)
SELECT user_id, min(CASE WHEN peak > 0 AND rate >= peak * 0.9 THEN t - t1 END) AS seconds FROM k GROUP BY 1""")
def time_to_peak(spark, d):
    """Seconds until a track's rate over a day first reaches nine tenths of its greatest."""
    return windows.time_to_share_of_peak(tracks(spark, d), ["user_id"], "t", "value", 86400, 0.9)


@query(f"""WITH {ONE}, e AS (SELECT *, max(t) OVER (PARTITION BY user_id) AS tn FROM p),
b AS (SELECT user_id, max(t) FILTER (tn - t >= 43200) AS t0, max(t) AS tn FROM e GROUP BY 1)
SELECT b.user_id, round((n.value - z.value) / (tn - t0) * 3600, 6) AS rate FROM b JOIN p n ON n.user_id = b.user_id AND n.t = tn LEFT JOIN p z ON z.user_id = b.user_id AND z.t = t0""")
def final_rate(spark, d):
    """Rate of a track's last half day, units an hour."""
    found = windows.final_rate(tracks(spark, d), ["user_id"], "t", "value", 43200)
    return found.select("user_id", shown(F.col("rate") * 3600).alias("rate"))


@query(f"""WITH {ONE}, g AS (SELECT user_id, t // 21600 AS step, avg(round(value * 100)::BIGINT) AS v FROM p GROUP BY ALL),
s AS (SELECT user_id, unnest(range(min(step), max(step) + 1)) AS step FROM g GROUP BY 1),
m AS (SELECT s.user_id, v, avg(v) OVER (PARTITION BY s.user_id ORDER BY s.step ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS mean FROM s LEFT JOIN g USING (user_id, step))
SELECT user_id, round(100.0 * count(*) FILTER (mean >= 5000) / count(*), 6) AS pct FROM m WHERE v IS NOT NULL GROUP BY 1""")
def smoothed_share(spark, d):
    """Share of a track's quarter days whose mean over five of them is at least 50; quarters without a fix are skipped."""
    quarter = F.floor(F.col("t") / 21600).cast("long").alias("step")
    have = tracks(spark, d).groupBy("user_id", quarter).agg(F.avg(F.round(F.col("value") * 100).cast("long")).alias("v"))
    grid = have.groupBy("user_id").agg(F.explode(F.sequence(F.min("step"), F.max("step"))).alias("step"))
    found = windows.smoothed_share(grid.join(have, ["user_id", "step"], "left"), ["user_id"], "step", "v", 2, 5000)
    return found.select("user_id", shown(F.col("pct")).alias("pct"))


@query(f"""WITH {ONE}, r AS (SELECT user_id, t, (last(value) OVER x - first(value) OVER x) / nullif(last(t) OVER x - first(t) OVER x, 0) * 3600 AS rate FROM p
  WINDOW x AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 43200 PRECEDING AND 43200 FOLLOWING))
SELECT user_id, t, round(rate, 6) AS rate FROM r WHERE abs(rate) <= 50""")
def centred_rate(spark, d):
    """Rate of a track between half a day before and after, units an hour."""
    found = windows.centred_rate(tracks(spark, d).withColumn("value", F.col("value") * 3600), ["user_id"], "t", "value", 43200, 50)
    return found.select("user_id", "t", shown(F.col("rate")).alias("rate"))


def _weight_sql(p: str) -> str:
    return " + ".join(f"({f!r} * {p})" if e == 0 else f"((pow(10.0, {e} * {p}) - 1) * {f / (e * log(10))!r})" for f, e in gap.leading_weight_terms())


@query(f"""WITH {ONE}, k AS (SELECT user_id, (t - min(t) OVER (PARTITION BY user_id)) / 60.0 AS s, greatest(0, 100 - round(value)) AS left_km, t FROM p),
b AS (SELECT user_id, s, least(100.0, coalesce(min(left_km) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 100.0)) AS b0, left_km FROM k),
c AS (SELECT user_id, s, b0, least(b0, left_km) AS b1 FROM b)
SELECT user_id, round(sum(s * (b0 * b0 - b1 * b1)) / (1800 * 100.0 * 100.0), 6) AS classic,
  round(sum(b1 * (({_weight_sql('(b0 / 100)')}) - ({_weight_sql('(b1 / 100)')})) * s) / (1800 * 100.0), 6) AS weighted FROM c GROUP BY 1""")
def leading_areas(spark, d):
    """Users as pilots on a section of 100 km, `value` of it behind them: both leading areas."""
    start = windows.W.partitionBy("user_id")
    own = tracks(spark, d).select("user_id", "t", ((F.col("t") - F.min("t").over(start)) / 60.0).alias("s"), F.greatest(F.lit(0.0), 100 - F.round("value")).alias("left_km"), F.lit(100.0).alias("section"))
    found = gap.leading_area(own, ["user_id"], "s", "left_km", "section")
    return found.select("user_id", shown(F.col("classic")).alias("classic"), shown(F.col("weighted")).alias("weighted"))


@query(f"""WITH {FLIGHTS}, c AS (SELECT task, pilot, 1 + (pilot % 89) / 40.0 AS lc FROM flights WHERE flying), m AS (SELECT task, min(lc) AS least FROM c GROUP BY 1)
SELECT task, pilot, round(greatest(0.0, 1 - cbrt(pow(lc - least, 2) / least)), 6) AS fraction FROM c JOIN m USING (task)""")
def leading_fractions(spark, d):
    """Share of the leading points by coefficient, each field against its least."""
    own = flights(spark, d).filter("flying").select("task", "pilot", (1 + F.col("pilot") % 89 / 40.0).alias("lc"))
    least = own.groupBy("task").agg(F.min("lc").alias("least"))
    return own.join(least, "task").select("task", "pilot", shown(gap.leading_fraction(F.col("lc"), F.col("least"))).alias("fraction"))


@query(f"""WITH {FLIGHTS}, e AS (SELECT *, CASE WHEN pilot % 5 = 0 THEN pilot % 600 END AS early FROM flights),
o AS (SELECT *, CASE WHEN early > 300 THEN 'minimum_distance' WHEN early > 0 THEN 'penalty' END AS early_outcome FROM e)
SELECT task, pilot, early_outcome, round(CASE WHEN early_outcome = 'minimum_distance' THEN 0 ELSE distance END, 4) AS distance, goal AND coalesce(early_outcome, '') <> 'minimum_distance' AS goal,
  CASE WHEN goal AND coalesce(early_outcome, '') <> 'minimum_distance' THEN time END AS time, CASE WHEN early_outcome = 'penalty' THEN early / 2.0 ELSE 0.0 END AS penalty FROM o""")
def early_starts_hg(spark, d):
    own = flights(spark, d).withColumn("early", F.when(F.col("pilot") % 5 == 0, F.col("pilot") % 600))
    found = scoring.early_starts(own, "early", "HG", 300, F.lit(0.0), 2.0)
    return found.select("task", "pilot", "early_outcome", shown(F.col("distance"), 4).alias("distance"), "goal", "time", "penalty")


@query(f"""WITH {FLIGHTS}, e AS (SELECT *, pilot % 5 = 0 AND pilot % 600 > 0 AS early FROM flights)
SELECT task, pilot, CASE WHEN early THEN 'launch_to_start' END AS early_outcome, round(CASE WHEN early THEN 4200 ELSE distance END, 4) AS distance, goal AND NOT early AS goal, CASE WHEN goal AND NOT early THEN time END AS time FROM e""")
def early_starts_pg(spark, d):
    own = flights(spark, d).withColumn("early", F.when(F.col("pilot") % 5 == 0, F.col("pilot") % 600))
    found = scoring.early_starts(own, "early", "PG", 300, F.lit(4200.0), 2.0)
    return found.select("task", "pilot", "early_outcome", shown(F.col("distance"), 4).alias("distance"), "goal", "time")


@query("""WITH w AS (SELECT user_id, (event_id * 37 % 3600) / 10.0 AS dir, value AS speed FROM events)
SELECT user_id, count(*) AS n, round(quantile_cont(speed, 0.5), 6) AS speed, round(degrees(atan2(sum(sin(radians(dir)) * speed), sum(cos(radians(dir)) * speed))) + CASE WHEN atan2(sum(sin(radians(dir)) * speed), sum(cos(radians(dir)) * speed)) < 0 THEN 360 ELSE 0 END, 4) AS direction FROM w GROUP BY 1""")
def combined_wind(spark, d):
    """Events as estimates of a user's wind: direction of the vector mean, median of the speeds."""
    own = table(spark, d, "events").select("user_id", (F.col("event_id") * 37 % 3600 / 10.0).alias("dir"), F.col("value").alias("speed"))
    found = aggregates.combined_wind(own, ["user_id"], "dir", "speed")
    return found.select("user_id", "n", shown(F.col("speed")).alias("speed"), shown(F.col("direction"), 4).alias("direction"))


@query(f"""WITH {FIXES}, s AS (SELECT user_id, t // 604800 AS task, t, event_id, row_number() OVER (PARTITION BY user_id, t // 604800 ORDER BY t, event_id) AS leg FROM fixes),
n AS (SELECT *, lead(t) OVER (PARTITION BY user_id, task ORDER BY leg) AS t1 FROM s)
SELECT task, leg, min(t) AS "from", max(t1) AS "to", count(*) AS pilots FROM n WHERE t1 IS NOT NULL GROUP BY ALL""")
def leg_occupancy(spark, d):
    """A user's events of a week as the turnpoints passed: when each leg was flown, and by how many."""
    task = F.floor(F.col("t") / 604800).cast("long")
    passed = fixes(spark, d).withColumn("task", task)
    passed = passed.withColumn("leg", F.row_number().over(windows.W.partitionBy("user_id", "task").orderBy("t", "event_id")).cast("long"))
    return aggregates.leg_occupancy(passed, ["task"], "user_id", "leg", "t")


@query(f"""WITH {ONE}, f AS (SELECT user_id, min(t) AS off, max(t) AS down FROM p GROUP BY 1) SELECT user_id % 100 AS field, min(off) AS begins, max(down) AS ends, count(*) AS pilots FROM f GROUP BY 1""")
def analysis_window(spark, d):
    """From the first take-off to the last landing of each field."""
    flown = tracks(spark, d).groupBy("user_id").agg(F.min("t").alias("off"), F.max("t").alias("down"))
    return flown.groupBy((F.col("user_id") % 100).alias("field")).agg(F.min("off").alias("begins"), F.max("down").alias("ends"), F.count("*").alias("pilots"))
