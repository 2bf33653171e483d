"""Queries of whole tasks, from tracks to points, and their SQL: goal lines, leading, stopped tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import gap
from ..functions.geo import A, FLATTENING
from ..functions.numbers import shown
from ..operators import goal, leading, stopped
from . import scoring
from .catalog import FIXES, LEAD, fixes, query

E2 = FLATTENING * (2 - FLATTENING)
#: Metres of a degree at latitude -36, as the local frame has them.
_W = f"(1 - {E2!r} * pow(sin(radians(-36.0::DOUBLE)), 2))"
NORTH, EAST = f"(radians(1.0::DOUBLE) * {A!r} * (1 - {E2!r}) / pow({_W}, 1.5))", f"(radians(1.0::DOUBLE) * {A!r} * cos(radians(-36.0::DOUBLE)) / sqrt({_W}))"


@query(f"""WITH {FIXES}, l AS (SELECT event_type AS task, (min(event_id) % 7) * 0.9 AS course, 200.0 + 50 * (min(event_id) % 3) AS radius FROM fixes GROUP BY 1),
f AS (SELECT event_type AS task, user_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY t, event_id) AS fix, t, (147.0 + ((event_id * 37) % 101 - 50) * 1e-4 - 147.0) * {EAST} AS e, (-36.0 + (value - 50) * 1e-4 - -36.0) * {NORTH} AS n FROM fixes),
g AS (SELECT *, radius + 5 AS edge, e * sin(course) + n * cos(course) AS y, e * cos(course) - n * sin(course) AS x FROM f JOIN l USING (task)),
i AS (SELECT *, y > 0 AND y * y + x * x <= edge * edge AS inside FROM g),
s AS (SELECT *, lag(inside) OVER w AS was, lag(y) OVER w AS y0, lag(x) OVER w AS x0, lag(t) OVER w AS t0 FROM i WINDOW w AS (PARTITION BY task, user_id ORDER BY fix)),
h AS (SELECT *, CASE WHEN y <> y0 AND ((y0 > 0) <> (y > 0) OR y0 = 0) THEN y0 / (y0 - y) END AS share, (y - y0) * (y - y0) + (x - x0) * (x - x0) AS a, y0 * (y - y0) + x0 * (x - x0) AS b, y0 * y0 + x0 * x0 - edge * edge AS c FROM s WHERE was IS NOT NULL),
k AS (SELECT *, abs(x0 + share * (x - x0)) AS beside, sqrt(greatest(b * b - a * c, 0)) AS root FROM h),
m AS (SELECT *, coalesce(share BETWEEN 0 AND 1 AND beside <= edge, false) AS hit, least(greatest(CASE WHEN inside THEN (-b - root) / a ELSE (-b + root) / a END, 0), 1) AS arc FROM k),
r AS (SELECT task, user_id, fix, t0 + share * (t - t0) AS t, inside AS entered, beside > radius AS credited FROM m WHERE hit AND was <> inside
  UNION ALL SELECT task, user_id, fix, t0 + share * (t - t0), unnest([true, false]), beside > radius FROM m WHERE hit AND was = inside AND y > y0
  UNION ALL SELECT task, user_id, fix, t0 + arc * (t - t0), inside, true FROM m WHERE NOT hit AND was <> inside)
SELECT task, user_id, fix, round(t, 3) AS t, entered, credited FROM r""")
def goal_line_crossings(spark, d):
    """A line a type of event, across a course of its own; users pass it on places some hundred metres about."""
    e = fixes(spark, d)
    lines = e.groupBy(F.col("event_type").alias("task")).agg(F.min("event_id").alias("k")).select("task", F.lit(0).alias("tp"), F.lit(-36.0).alias("plat"), F.lit(147.0).alias("plon"), (F.lit(200.0) + 50 * (F.col("k") % 3)).alias("radius"), (F.col("k") % 7 * 0.9).alias("course"))
    fix = F.row_number().over(goal.W.partitionBy("event_type", "user_id").orderBy("t", "event_id")).cast("long").alias("fix_index")
    tracks = e.select(F.col("event_type").alias("task"), "user_id", fix, "t", (F.lit(-36.0) + (F.col("value") - 50) * 1e-4).alias("lat"), (F.lit(147.0) + ((F.col("event_id") * 37) % 101 - 50) * 1e-4).alias("lon"))
    found = goal.line_crossings(tracks, lines, ["user_id"]).select("task", "user_id", F.explode("found").alias("c"))
    return found.select("task", "user_id", F.col("c.fix_index").alias("fix"), shown(F.col("c.t"), 3).alias("t"), "c.entered", "c.credited")


# --- weeks of events as tasks: users fly 100 km, `value` of it done ---------------------------------

SECTION = 90.0
ONE = f"{FIXES}, one AS (SELECT t // 604800 AS task, user_id AS pilot, t, abs(100 - max(value)) AS left_km, (min(event_id) % 50) * 40.0 AS alt FROM fixes GROUP BY ALL)"
GATE = "CASE WHEN task % 2 = 0 THEN task * 604800 + 43200 END"


def legs(spark, d):
    """(task, pilot, t, left_km, alt): a week of events is a task."""
    e = fixes(spark, d).groupBy(F.floor(F.col("t") / 604800).cast("long").alias("task"), F.col("user_id").alias("pilot"), "t").agg(F.max("value").alias("value"), F.min("event_id").alias("id"))
    return e.select("task", "pilot", "t", F.abs(100 - F.col("value")).alias("left_km"), (F.col("id") % 50 * 40.0).alias("alt"))


def started(tracks, until=None):
    """(task, pilot, start_t, gate): the first fix with no more than SECTION left, up to a time."""
    ready = F.col("left_km") <= SECTION if until is None else (F.col("left_km") <= SECTION) & (F.col("t") <= until)
    gate = F.when(F.col("task") % 2 == 0, F.col("task") * 604800 + 43200)
    return tracks.groupBy("task", "pilot").agg(F.min(F.when(ready, F.col("t"))).alias("start_t")).withColumn("gate", gate)


def _fraction(p: str) -> str:
    return "(" + LEAD.replace("* p)", f"* ({p}))") + ")"


PARTS = f"""{ONE}, st AS (SELECT task, pilot, min(t) FILTER (left_km <= {SECTION}) AS start_t, max(t) AS last_t, {GATE} AS gate FROM one GROUP BY task, pilot),
fl AS (SELECT st.*, (SELECT min(t) FROM one o WHERE o.task = st.task AND o.pilot = st.pilot AND o.t >= start_t AND left_km <= 5) AS ess_t FROM st WHERE start_t IS NOT NULL),
wi AS (SELECT o.task, o.pilot, o.t, left_km, start_t, ess_t, gate, last_t FROM one o JOIN fl USING (task, pilot) WHERE o.t >= start_t AND (ess_t IS NULL OR o.t <= ess_t)),
b AS (SELECT *, least({SECTION}, coalesce(min(left_km) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING), {SECTION})) AS b0, least({SECTION}, coalesce(min(left_km) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {SECTION})) AS b1 FROM wi WINDOW w AS (PARTITION BY task, pilot ORDER BY t)),
d AS (SELECT *, CASE WHEN b0 > b1 THEN b1 * ({_fraction(f'b0 / {SECTION}')} - {_fraction(f'b1 / {SECTION}')}) ELSE 0 END AS part FROM b),
parts AS (SELECT task, pilot, start_t, ess_t, gate, last_t, least(min(left_km), {SECTION}) AS best_km, sum(CASE WHEN b0 > b1 THEN (t - start_t) * (b0 * b0 - b1 * b1) ELSE 0 END) AS classic, sum(part * (greatest(t, coalesce(gate, t)) - start_t)) AS timed, sum(part) AS weighed FROM d GROUP BY ALL),
ft AS (SELECT task, coalesce(min(gate), min(start_t)) AS first_t, greatest(max(last_t) FILTER (ess_t IS NULL), max(ess_t)) AS done_t, task * 604800 + 500000 AS deadline FROM parts GROUP BY task),
ruled AS (SELECT task, first_t, least(coalesce(done_t, first_t + 3600), CASE WHEN deadline > first_t THEN deadline ELSE coalesce(done_t, first_t + 3600) END) AS until FROM ft),
led AS (SELECT p.*, until, first_t,
  (classic + greatest(start_t - first_t, 0) * {SECTION} * {SECTION} + CASE WHEN ess_t IS NULL THEN best_km * best_km * greatest(until - start_t, 0) ELSE 0 END) / (1800 * {SECTION} * {SECTION}) AS hg,
  (timed + (start_t - first_t) * weighed + CASE WHEN ess_t IS NULL THEN best_km * greatest(until - first_t, 0) * {_fraction(f'best_km / {SECTION}')} ELSE 0 END) / (1800 * {SECTION}) AS pg FROM parts p JOIN ruled USING (task))"""


def _led(spark, d, scoring_: str):
    tracks = legs(spark, d)
    starts = started(tracks).filter("start_t is not null")
    ess = tracks.join(starts, ["task", "pilot"]).groupBy("task", "pilot").agg(F.min(F.when((F.col("t") >= F.col("start_t")) & (F.col("left_km") <= 5), F.col("t"))).alias("ess_t"))
    flights = starts.join(ess, ["task", "pilot"]).withColumn("section_km", F.lit(SECTION))
    rules = starts.select("task").distinct().select("task", (F.col("task") * 604800 + 500000).alias("deadline"), F.lit(None).cast("long").alias("stop"))
    parts = leading.contributions(tracks, flights, ["task", "pilot"])
    return leading.coefficients(parts, rules, ["task"], scoring_)


@query(f"WITH {PARTS} SELECT task, pilot, ess_t, until, round(best_km, 6) AS best_km, round(hg, 6) AS classic, round(pg, 6) AS weighted FROM led")
def leading_coefficients(spark, d):
    hg = _led(spark, d, "HG").select("task", "pilot", F.col("leading").alias("hg"))
    both = _led(spark, d, "PG").join(hg, ["task", "pilot"])
    return both.select("task", "pilot", "ess_t", F.col("until").cast("long").alias("until"), shown(F.col("best_km")).alias("best_km"), shown(F.col("hg")).alias("classic"), shown(F.col("leading")).alias("weighted"))


def _cubic(c: tuple, x: str) -> str:
    return f"({c[0]} + {c[1]} * {x} + {c[2]} * {x} * {x} + {c[3]} * {x} * {x} * {x})"


#: The paragliding score of a CTE `flights` (task, pilot, distance, goal, ess, time, leading, and of the task stopped_validity, met, window_seconds).
SCORED = f"""fl0 AS (SELECT *, greatest(distance, 5000) AS dist FROM flights),
fi AS (SELECT task, count(*) AS n, count(*) FILTER (goal) AS in_goal, max(dist) AS best, min(time) FILTER (goal AND time > 0) AS best_time, min(time) FILTER (ess AND NOT goal AND time > 0) AS between_time, sum(greatest(0, dist - 5000)) AS over_min, min(lead_c) AS least_leading, any_value(stopped_validity) AS sv, any_value(met) AS met, any_value(window_seconds) AS ws FROM fl0 GROUP BY task),
va AS (SELECT *, in_goal / n AS g, least(1.0, 1 / 0.96) AS lr, least(1.0, greatest(0.0, over_min / (n * ((1.3 * (70000 - 5000) + greatest(0, 0.3 * (best - 70000))) / 2)))) AS dv, least(1.0, CASE WHEN best_time IS NOT NULL THEN best_time / 5400 ELSE best / 70000 END) AS tr FROM fi),
da AS (SELECT *, least(1.0, greatest(0.0, {_cubic(gap.LAUNCH, 'lr')})) * dv * least(1.0, greatest(0.0, {_cubic(gap.TIME, 'tr')})) * coalesce(sv, 1) AS v, {_cubic(gap.DISTANCE_WEIGHT, 'g')} AS dw FROM va),
we AS (SELECT *, CASE WHEN g = 0 THEN 1 - dw ELSE (1 - dw) * {gap.LEADING_RATIO['PG']} END AS lw FROM da),
av AS (SELECT *, 1000 * v * dw AS ad0, 1000 * v * greatest(0.0, 1 - dw - lw) AS at0, 1000 * v * lw AS al FROM we),
re AS (SELECT *, CASE WHEN coalesce(met, false) AND in_goal > 0 AND best_time IS NOT NULL AND coalesce(between_time, ws) IS NOT NULL THEN at0 * CASE WHEN coalesce(between_time, ws) <= best_time THEN 1.0 ELSE greatest(0.0, 1 - pow((coalesce(between_time, ws) - best_time) / 3600 / sqrt(best_time / 3600), 5.0 / 6)) END ELSE 0 END AS reduction FROM av),
sc AS (SELECT f.*, reduction, dist / best * (ad0 + reduction) AS dp,
  greatest(0.0, CASE WHEN goal AND time > 0 THEN CASE WHEN time <= best_time THEN 1.0 ELSE greatest(0.0, 1 - pow((time - best_time) / 3600 / sqrt(best_time / 3600), 5.0 / 6)) END ELSE 0 END * CASE WHEN coalesce(r.met, false) AND in_goal = 0 THEN 0 ELSE at0 END - CASE WHEN goal THEN reduction ELSE 0 END) AS tp,
  CASE WHEN lead_c IS NULL OR least_leading <= 0 THEN 0.0 ELSE greatest(0.0, 1 - cbrt(pow(lead_c - least_leading, 2) / least_leading)) END * al AS lp FROM fl0 f JOIN re r USING (task))"""


@query(f"""WITH {PARTS}, flights AS (SELECT task, pilot, (100 - best_km) * 1000 AS distance, ess_t IS NOT NULL AS goal, ess_t IS NOT NULL AS ess, ess_t - start_t AS time, pg AS lead_c, NULL::DOUBLE AS stopped_validity, NULL::BOOLEAN AS met, NULL::DOUBLE AS window_seconds FROM led), {SCORED}
SELECT task, pilot, round(dp, 4) AS distance_points, round(tp, 4) AS time_points, round(lp, 4) AS leading_points, round(dp + tp + lp, 1) AS total FROM sc""")
def led_scores(spark, d):
    """Paragliding scores with leading points, from tracks."""
    led = _led(spark, d, "PG")
    done = F.col("ess_t").isNotNull()
    flights = led.select("task", "pilot", ((100 - F.col("best_km")) * 1000).alias("distance"), done.alias("goal"), done.alias("ess"), (F.col("ess_t") - F.col("start_t")).alias("time"), F.col("ess_t").alias("ess_time"), "leading", F.lit(True).alias("present"), F.lit(True).alias("flying"), F.lit(0.0).alias("penalty"))
    scored = scoring.score_flights(flights, ["task"], "pilot", {"scoring": "PG", "leading": True})
    return scored.select("task", "pilot", *[shown(F.col(c), 4).alias(c) for c in ("distance_points", "time_points", "leading_points")], shown(F.col("distance_points") + F.col("time_points") + F.col("leading_points"), 1).alias("total"))


@query(f"""WITH {ONE}, st AS (SELECT task, pilot, min(t) FILTER (left_km <= {SECTION} AND t <= task * 604800 + 432000) AS own, max(t) AS last_t, {GATE} AS gate, task * 604800 + 432000.0 AS stop_t FROM one GROUP BY task, pilot),
wi AS (SELECT *, CASE WHEN own IS NOT NULL THEN coalesce(gate, own) END AS start_t FROM st),
wt AS (SELECT *, coalesce(gate, max(start_t) OVER (PARTITION BY task)) AS window_t FROM wi),
we0 AS (SELECT *, CASE WHEN gate IS NOT NULL THEN stop_t ELSE coalesce(start_t + greatest(stop_t - window_t, 0), stop_t) END AS window_end FROM wt),
cu AS (SELECT o.*, start_t, window_end, window_t, stop_t, last_t >= window_end AS flying FROM one o JOIN we0 USING (task, pilot) WHERE (last_t < window_end OR o.t <= window_end) AND start_t IS NOT NULL),
gl AS (SELECT *, CASE WHEN flying AND t = max(t) OVER (PARTITION BY task, pilot) THEN least(left_km * 1000, 2.5 * greatest(alt - 300, 0)) ELSE 0 END AS bonus FROM cu WHERE t >= start_t),
be AS (SELECT task, pilot, any_value(flying) AS flying, any_value(start_t) AS start_t, min(left_km * 1000 - bonus) AS after, first(bonus ORDER BY left_km * 1000 - bonus, t) AS bonus, min(t) FILTER (left_km <= 5) AS ess_t, count(*) FILTER (left_km <= 1) > 0 AS goal FROM gl GROUP BY task, pilot),
f0 AS (SELECT *, 100000 - after AS distance, ess_t IS NOT NULL AS ess FROM be),
fg AS (SELECT task, max(greatest(distance, 0) / 1000) AS best, avg(greatest(distance, 0) / 1000) AS mean, coalesce(stddev_samp(greatest(distance, 0) / 1000), 0) AS dev, count(*) AS launched, count(*) FILTER (NOT flying) AS landed, count(*) FILTER (ess) AS at_ess FROM f0 GROUP BY task),
rn AS (SELECT task, greatest(max(stop_t - window_t), 0) AS window_seconds FROM we0 GROUP BY task),
ou AS (SELECT *, CASE WHEN at_ess > 0 THEN 1.0 ELSE least(1.0, CASE WHEN 95 - best + 1 > 0 AND best > mean THEN sqrt((best - mean) / (95 - best + 1) * sqrt(dev / 5)) ELSE 0 END + pow(landed / launched, 3)) END AS stopped_validity FROM fg JOIN rn USING (task)),
flights AS (SELECT task, pilot, distance, goal AND ess AS goal, ess, ess_t - start_t AS time, NULL::DOUBLE AS lead_c, stopped_validity, true AS met, window_seconds, bonus, flying FROM f0 JOIN ou USING (task)), {SCORED}
SELECT task, pilot, flying, round(distance, 4) AS distance, round(bonus, 4) AS bonus, round(stopped_validity, 6) AS stopped_validity, round(reduction, 4) AS reduction, round(dp, 4) AS distance_points, round(tp, 4) AS time_points FROM sc""")
def stopped_task(spark, d):
    """Weeks stopped after five days: windows from the starts, tracks cut at them, the glide from the stop, the task's factor and the points."""
    tracks, keys = legs(spark, d), ["task", "pilot"]
    at_stop = F.col("task") * 604800 + 432000
    own = started(tracks, at_stop)
    starts = own.select(*keys, F.when(F.col("start_t").isNotNull(), F.coalesce("gate", "start_t")).alias("start_t"))
    gates = F.when(F.col("task") % 2 == 0, F.array(F.col("task") * 604800 + 43200))
    rules = starts.select("task").distinct().select("task", (at_stop + stopped.SCORED_BACK["PG"]).alias("announced"), gates.alias("gates"), F.lit(300.0).alias("goal_alt"))
    windowed = stopped.windows(starts, rules, "PG")
    fixes_ = stopped.cut(tracks.withColumn("left", F.col("left_km") * 1000), windowed.filter("start_t is not null"), keys)
    best = stopped.glided(fixes_, keys, "PG", "start_t")
    done = fixes_.filter("t >= start_t").groupBy(*keys).agg(F.min(F.when(F.col("left_km") <= 5, F.col("t"))).alias("ess_t"), F.coalesce(F.max(F.col("left_km") <= 1), F.lit(False)).alias("in_goal"), F.first("start_t").alias("start_t"))
    flown = best.join(done, keys).withColumns({"ess": F.col("ess_t").isNotNull(), "distance": 100000 - F.col("left")})
    out = stopped.outcome(flown.withColumn("flying_at_stop", F.col("flying")), windowed, keys, rules.select("task", F.lit(95.0).alias("to_ess_km")), 5400.0, "PG")
    flights = flown.select(*keys, "distance", (F.col("in_goal") & F.col("ess")).alias("goal"), "ess", (F.col("ess_t") - F.col("start_t")).alias("time"), F.col("ess_t").alias("ess_time"), F.lit(None).cast("double").alias("leading"), F.lit(True).alias("present"), F.lit(True).alias("flying"), F.lit(0.0).alias("penalty"))
    scored = scoring.score_flights(flights, ["task"], "pilot", {"scoring": "PG", "leading": True}, out.select("task", "stopped_validity", "met", "window_seconds"))
    shown_ = scored.select(*keys, "distance_points", "time_points", "time_reduction").join(flown.select(*keys, "flying", "distance", "bonus"), keys).join(out.select("task", "stopped_validity"), "task")
    return shown_.select(*keys, "flying", shown(F.col("distance"), 4).alias("distance"), shown(F.col("bonus"), 4).alias("bonus"), shown(F.col("stopped_validity")).alias("stopped_validity"), shown(F.col("time_reduction"), 4).alias("reduction"), shown(F.col("distance_points"), 4).alias("distance_points"), shown(F.col("time_points"), 4).alias("time_points"))


@query()
def scored_tracks(spark, d):
    """Tasks of users a hundred, scored from their tracks: out of 4 km, to 14 km and back to 4 km, on a line north, `value` percent of 20 km out."""
    km = 1 / 110.95
    e = fixes(spark, d).groupBy("user_id", "t").agg(F.max("value").alias("value"))
    by = goal.W.partitionBy("user_id").orderBy("t")
    task = F.floor(F.col("user_id") / 100).cast("string")
    tracks = e.select(task.alias("task"), F.col("user_id").alias("pilot"), F.row_number().over(by).cast("long").alias("fix_index"), F.col("t").cast("double").alias("t"), (F.lit(-36.0) + F.least(F.col("value"), F.lit(100.0)) * 0.2 * km).alias("lat"), F.lit(147.0).alias("lon"))
    tasks = tracks.select("task").distinct()
    point = lambda tp, way, north, radius: F.struct(F.lit(tp).alias("tp"), F.lit(way).alias("way"), F.lit(-36.0 + north * km).alias("plat"), F.lit(147.0).alias("plon"), F.lit(radius).alias("radius"))
    points = tasks.select("task", F.explode(F.array(point(0, "exit", 0.0, 4000.0), point(1, "enter", 14.0, 2000.0), point(2, "enter", 4.0, 2000.0))).alias("p")).select("task", "p.*")
    none = F.lit(None)
    rules = tasks.select("task", F.lit(0).alias("start"), F.lit(2).alias("ess"), F.lit(2).alias("goal"), F.lit("exit").alias("start_way"), none.cast("double").alias("opens"), none.cast("double").alias("closes"), none.cast("array<double>").alias("gates"), F.lit(False).alias("fallback"))
    scored = scoring.score_task(tracks, points, rules, "pilot", {"scoring": "PG", "leading": True, "nominal_distance": 15_000.0, "minimum_distance": 2_000.0})
    return scored.select("task", "pilot", *[shown(F.col(c), 4).alias(c) for c in ("distance", "distance_points", "time_points", "leading_points")], "total", "rank")
