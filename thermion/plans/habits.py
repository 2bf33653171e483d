"""The query of operators/habits.py and of the day's wind, and their SQL: ten fields of users, an event every ten seconds."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import shown
from ..operators import aggregates, circles, habits
from .catalog import query
from .flights import NUMBERED, numbered

# a user's events in order, ten seconds apart, as heights of ten metres a unit; a tenth of the users a task
TRACKS = f"{NUMBERED}, k AS (SELECT user_id % 10 AS task, user_id AS pilot, fix AS i, fix * 10 AS t, value * 10 AS alt, id FROM n)"
RUNS = "SELECT task, pilot, min(i) AS first, max(i) AS last, min(t) AS start_t, max(t) AS end_t, first(alt ORDER BY i) AS start_alt, last(alt ORDER BY i) AS end_alt FROM (SELECT *, i - row_number() OVER (PARTITION BY pilot ORDER BY i) AS g FROM k WHERE {what}) GROUP BY task, pilot, g HAVING count(*) > 1"


def _runs(tracks, what):
    w = W.partitionBy("task", "pilot").orderBy("fix_index")
    held = tracks.filter(what).withColumn("g", F.col("fix_index") - F.row_number().over(w))
    ends = held.groupBy("task", "pilot", "g").agg(F.min("fix_index").alias("first"), F.max("fix_index").alias("last"), F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.min_by("alt", "fix_index").alias("start_alt"), F.max_by("alt", "fix_index").alias("end_alt"))
    return ends.filter("last > first").drop("g")


@query(f"""WITH {TRACKS}, climbs AS (SELECT *, end_alt * 3 AS to_goal FROM ({RUNS.format(what='id % 10 > 0 AND i % 17 > 0')})), rings AS ({RUNS.format(what='id % 4 > 0')}),
st AS (SELECT task, pilot, CASE WHEN pilot % 13 > 0 THEN 50 END AS start_t, CASE WHEN pilot % 3 > 0 THEN 400 + pilot % 7 * 10 END AS ess_t, pilot % 50 * 10.0 AS ess_alt, pilot % 11 * 100.0 AS ess_to_goal, min(i) AS takeoff, max(i) AS landing, max(t) AS land_t FROM k GROUP BY 1, 2),
tu AS (SELECT task, pilot, (i % 7 + 1) / (id % 5 + 1)::DOUBLE AS ratio FROM k WHERE i % 3 = 0),
ph AS (SELECT task, pilot, CASE WHEN i % 3 = 0 THEN 'climb' WHEN id % 2 = 0 THEN 'glide' ELSE 'search' END AS phase, t AS a, t + 10 AS b FROM k),
wi AS (SELECT task, pilot, start_t AS a, coalesce(ess_t, land_t) AS b FROM st WHERE coalesce(ess_t, land_t) > start_t),
cf AS (SELECT c.task, c.pilot, c.first, k.t, k.alt, c.start_t, c.end_t FROM climbs c JOIN k ON k.pilot = c.pilot AND k.i BETWEEN c.first AND c.last),
ra AS (SELECT *, (alt - coalesce(first(alt) OVER r, lag(alt) OVER o)) / (t - coalesce(first(t) OVER r, lag(t) OVER o)) AS rate FROM cf WHERE end_t - start_t >= 60 WINDOW r AS (PARTITION BY pilot, first ORDER BY t RANGE BETWEEN 30 PRECEDING AND 1 PRECEDING), o AS (PARTITION BY pilot, first ORDER BY t)),
pk AS (SELECT *, max(rate) OVER (PARTITION BY pilot, first) AS peak FROM ra),
co AS (SELECT task, pilot, min(t - start_t) AS v FROM pk WHERE peak > 0 AND rate >= peak * 0.9 GROUP BY task, pilot, first),
ex AS (SELECT task, pilot, (last(alt ORDER BY t) - last(alt ORDER BY t) FILTER (end_t - t >= 30)) / (max(t) - max(t) FILTER (end_t - t >= 30)) AS v FROM cf WHERE end_t - start_t >= 90 GROUP BY task, pilot, first),
bo AS (SELECT r.task, r.pilot, EXISTS (SELECT 1 FROM climbs c WHERE c.pilot = r.pilot AND c.first <= r.last AND r.first <= c.last) AS kept FROM rings r JOIN st USING (task, pilot) WHERE r.start_t >= st.start_t AND r.end_t - r.start_t >= 30),
sm AS (SELECT k.*, avg(alt) OVER (PARTITION BY k.pilot ORDER BY t RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS smooth, EXISTS (SELECT 1 FROM climbs c WHERE c.pilot = k.pilot AND k.i BETWEEN c.first AND c.last) AS inside FROM k JOIN st USING (task, pilot) WHERE t >= start_t),
ri AS (SELECT task, pilot, lead(smooth) OVER w - smooth AS rise, inside OR coalesce(lead(inside) OVER w, false) AS climbs FROM sm WINDOW w AS (PARTITION BY pilot ORDER BY i)),
bt AS (SELECT c.*, lead(first) OVER (PARTITION BY pilot ORDER BY first) AS until FROM climbs c JOIN st USING (task, pilot) WHERE c.start_t >= st.start_t),
lo AS (SELECT b.task, b.pilot, b.first, any_value(end_alt) AS end_alt, min(alt) AS low FROM bt b JOIN k ON k.pilot = b.pilot AND k.i BETWEEN b.last AND b.until WHERE until > last GROUP BY 1, 2, 3),
gr AS (SELECT task, pilot, t, CASE WHEN id % 9 > 0 THEN (alt - 400) / 100 END AS rate FROM k), gs AS (SELECT *, avg(rate) OVER (PARTITION BY pilot ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS mean FROM gr),
fr AS (SELECT DISTINCT task, t // 200 AS episode, t, pilot FROM k WHERE t % 200 < (pilot * 7 % 25 + 3) * 10), fs AS (SELECT task, episode, t, count(*) AS members FROM fr GROUP BY ALL),
fl AS (SELECT *, min(members) OVER (PARTITION BY task, episode ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS fewest, max(t) OVER (PARTITION BY task, episode) AS ends, lead(t) OVER (PARTITION BY task, episode ORDER BY t) AS next_t FROM fs),
lv AS (SELECT x.*, fewest, ends, next_t FROM (SELECT task, episode, pilot, max(t) AS t FROM fr GROUP BY ALL) x JOIN fl USING (task, episode, t) WHERE ends - t >= 120 AND fewest >= 2),
re AS (SELECT task, pilot, i // 20 AS tp, t + id % 40 AS came FROM k WHERE i % 20 = 0 AND i > 0),
nx AS (SELECT lv.task, episode, lv.pilot, t, next_t, min(came) AS mine, first(tp ORDER BY came, tp) AS tp FROM lv JOIN re ON re.task = lv.task AND re.pilot = lv.pilot AND came > t GROUP BY ALL),
ot AS (SELECT nx.*, a.pilot AS other FROM nx JOIN fr a ON a.task = nx.task AND a.episode = nx.episode AND a.t = nx.t AND a.pilot <> nx.pilot JOIN fr b ON b.task = a.task AND b.episode = a.episode AND b.t = nx.next_t AND b.pilot = a.pilot),
cm AS (SELECT ot.task, ot.pilot, ot.episode, ot.t, any_value(mine) AS mine, quantile_cont(re.came, 0.5) AS usual FROM ot JOIN re ON re.task = ot.task AND re.pilot = ot.other AND re.tp = ot.tp AND re.came > ot.t GROUP BY ot.task, ot.pilot, ot.episode, ot.t HAVING count(*) >= 2),
lc AS (SELECT c.*, row_number() OVER (PARTITION BY pilot ORDER BY c.end_t DESC) AS z FROM climbs c JOIN st USING (task, pilot) WHERE c.end_t >= st.start_t AND c.end_t <= coalesce(ess_t, land_t)),
m AS (SELECT task, pilot, 'climb.time_to_core' AS metric, quantile_cont(v::DOUBLE, 0.5) AS value FROM co GROUP BY 1, 2
  UNION ALL SELECT task, pilot, 'climb.exit_decay', quantile_cont(v, 0.5) FROM ex GROUP BY 1, 2
  UNION ALL SELECT task, pilot, 'climb.selectivity', 100 * avg(kept::INT) FROM bo GROUP BY 1, 2 HAVING count(*) >= 3
  UNION ALL SELECT task, pilot, 'climb.circle_smoothness', quantile_cont(ratio, 0.5) FROM tu GROUP BY 1, 2 HAVING count(*) >= 10
  UNION ALL SELECT task, pilot, 'glide.dolphin_fraction', 100 * sum(CASE WHEN climbs THEN 0 ELSE rise END) / sum(rise) FROM ri WHERE rise > 0 GROUP BY 1, 2 HAVING sum(rise) >= 200
  UNION ALL SELECT task, pilot, 'decision.altitude_floor', quantile_cont(100 * (low - 100) / 900, 0.5) FROM lo WHERE end_alt - low >= 100 GROUP BY 1, 2 HAVING count(*) >= 2
  UNION ALL SELECT task, pilot, 'decision.search_fraction', 100 * sum(CASE WHEN phase = 'search' THEN least(ph.b, wi.b) - greatest(ph.a, wi.a) ELSE 0 END) / sum(least(ph.b, wi.b) - greatest(ph.a, wi.a)) FROM ph JOIN wi USING (task, pilot) WHERE least(ph.b, wi.b) > greatest(ph.a, wi.a) GROUP BY 1, 2
  UNION ALL SELECT task, pilot, 'day.airtime_quality', 100 * avg((mean >= -0.5)::INT) FROM gs WHERE rate IS NOT NULL GROUP BY 1, 2
  UNION ALL SELECT task, pilot, 'gaggle.departure_winrate', 100 * avg((mine < usual)::INT) FROM cm GROUP BY 1, 2
  UNION ALL SELECT task, pilot, 'race.ess_margin', ess_alt - 100 - ess_to_goal / 2.5 FROM st WHERE ess_t IS NOT NULL
  UNION ALL SELECT task, pilot, 'race.final_glide_init', to_goal / (end_alt - 100) FROM lc WHERE z = 1 AND to_goal <= 3000 AND end_alt > 100)
SELECT task, pilot, metric, round(value::DOUBLE, 6) AS value FROM m WHERE value IS NOT NULL""")
def field_habits(spark, d):
    base = numbered(spark, d)
    u = F.col("user_id")
    tracks = base.select((u % 10).alias("task"), u.alias("pilot"), "fix_index", (F.col("fix_index") * 10).alias("t"), (F.col("value") * 10).alias("alt"), "id")
    climbs = _runs(tracks, "id % 10 > 0 and fix_index % 17 > 0").withColumn("climb", F.col("first")).withColumn("to_goal", F.col("end_alt") * 3)
    rings = _runs(tracks, "id % 4 > 0")
    turns = tracks.filter("fix_index % 3 = 0").select("task", "pilot", (F.col("fix_index") % 7 + 1).cast("double").alias("rms"), (F.col("id") % 5 + 1).cast("double").alias("radius"))
    phase = F.when(F.col("fix_index") % 3 == 0, "climb").when(F.col("id") % 2 == 0, "glide").otherwise("search")
    phases = tracks.select("task", "pilot", phase.alias("phase"), F.col("t").alias("start_t"), (F.col("t") + 10).alias("end_t"))
    p = F.col("pilot")
    starts = tracks.groupBy("task", "pilot").agg(F.min("fix_index").alias("takeoff"), F.max("fix_index").alias("landing"), F.max("t").alias("land_t")).select("*", F.when(p % 13 > 0, 50).alias("start_t"), F.when(p % 3 > 0, 400 + p % 7 * 10).alias("ess_t"), (p % 50 * 10.0).alias("ess_alt"), (p % 11 * 100.0).alias("ess_to_goal"))
    tasks = tracks.select("task").distinct()
    bands = tasks.select("task", F.lit(100.0).alias("lo"), F.lit(1000.0).alias("hi"))
    goals = tasks.select("task", F.lit(100.0).alias("goal_alt"), F.lit(2000.0).alias("last_leg"))
    grid = tracks.select("task", "pilot", "t", F.when(F.col("id") % 9 > 0, (F.col("alt") - 400) / 100).alias("rate"))
    frames = tracks.filter("t % 200 < (pilot * 7 % 25 + 3) * 10").select("task", F.floor(F.col("t") / 200).alias("episode"), "t", "pilot").distinct()
    reached = tracks.filter("fix_index % 20 = 0 and fix_index > 0").select("task", "pilot", F.floor(F.col("fix_index") / 20).alias("tp"), (F.col("t") + F.col("id") % 40).alias("t"))
    found = habits.field_habits(tracks, climbs, rings, turns, phases, starts, bands, goals, grid, frames, reached)
    return found.withColumn("value", shown(F.col("value")))


@query(f"""WITH {NUMBERED}, p AS (SELECT user_id, (fix - 1) // 24 AS segment, (fix - 1) // 8 AS circle, t, 45 + value / 1e4 AS lat, 7 + (id % 97) / 1e4 AS lon FROM n),
m AS (SELECT *, avg(lat) OVER w AS lat0, avg(lon) OVER w AS lon0 FROM p WINDOW w AS (PARTITION BY user_id, circle)), l AS (SELECT *, (lat - lat0) * 111320 AS u, (lon - lon0) * 111320 * cos(radians(lat0)) AS v FROM m),
s AS (SELECT user_id, segment, circle, lat0, lon0, count(*) AS n, min(t) AS ta, max(t) AS tb, sum(u*u) AS uu, sum(v*v) AS vv, sum(u*v) AS uv, sum(u*u*u) AS uuu, sum(v*v*v) AS vvv, sum(u*v*v) AS uvv, sum(v*u*u) AS vuu FROM l GROUP BY ALL),
c AS (SELECT *, (vv * (uuu + uvv) - uv * (vvv + vuu)) / (2 * (uu * vv - uv * uv)) AS cu, (uu * (vvv + vuu) - uv * (uuu + uvv)) / (2 * (uu * vv - uv * uv)) AS cv FROM s WHERE n >= 3 AND abs(uu * vv - uv * uv) >= 1e-10),
f AS (SELECT *, lat0 + cu / 111320 AS clat, lon0 + cv / (111320 * cos(radians(lat0))) AS clon, (ta + tb) / 2 AS mid FROM c),
w AS (SELECT *, clat - lag(clat) OVER o AS dlat, (clon - lag(clon) OVER o) * cos(radians((clat + lag(clat) OVER o) / 2)) AS dlon, mid - lag(mid) OVER o AS dt FROM f WINDOW o AS (PARTITION BY user_id, segment ORDER BY circle)),
r AS (SELECT user_id % 5 AS task, floor(mid / 86400)::BIGINT AS hour, sqrt(dlat * dlat + dlon * dlon) * 111320 / dt AS speed, atan2(dlon, dlat) + pi() AS direction FROM w WHERE dt > 0),
g AS (SELECT task, hour, quantile_cont(speed, 0.5) AS speed, atan2(sum(speed * sin(direction)), sum(speed * cos(direction))) AS direction, count(*) AS n FROM r WHERE speed <= 30 GROUP BY 1, 2)
SELECT task, hour, round(speed * 1000, 4) AS speed, round(degrees(direction) - 360 * floor(degrees(direction) / 360), 3) AS direction, n FROM g""")
def day_wind(spark, d):
    """The wind of each day of a fifth of the users, from every eight events as a turn."""
    base = numbered(spark, d)
    tracks = base.select("user_id", "fix_index", "t", (45 + F.col("value") / 1e4).alias("lat"), (7 + F.col("id") % 97 / 1e4).alias("lon"))
    circle = F.floor((F.col("fix_index") - 1) / 8).cast("long").alias("circle")
    turns = tracks.groupBy("user_id", circle).agg(F.min("fix_index").alias("first"), F.max("fix_index").alias("last"), ((F.min("t") + F.max("t")) / 2).alias("mid")).withColumn("segment", F.floor(F.col("circle") / 3).cast("long"))
    drift = circles.drift_winds(circles.fits(tracks, turns, ["user_id"]), tracks, ["user_id"])
    timed = drift.join(turns.select("user_id", "circle", "mid"), ["user_id", "circle"]).select((F.col("user_id") % 5).alias("task"), F.floor(F.col("mid") / 86400).cast("long").alias("hour"), "speed", "direction")
    found = aggregates.combined_wind(timed, ["task", "hour"], "direction", "speed")
    return found.select("task", "hour", shown(F.col("speed") * 1000, 4).alias("speed"), shown(F.pmod(F.col("direction"), F.lit(360.0)), 3).alias("direction"), "n")
