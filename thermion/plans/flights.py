"""Queries of flights and thermals, and their SQL: phases, circles and wind, altitude excursions, shared thermals and their shapes."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import shown
from ..operators import circles, phases, routes, thermals
from .catalog import FIXES, fixes, query

#: events as tracks: a row a time, numbered, with places on a line north (20 m a unit of value would be slow; degrees are thousandths).
NUMBERED = f"{FIXES}, n AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t) AS fix, t, max(value) AS value, min(event_id) AS id FROM fixes GROUP BY user_id, t)"


def numbered(spark, d):
    one = fixes(spark, d).groupBy("user_id", "t").agg(F.max("value").alias("value"), F.min("event_id").alias("id"))
    return one.withColumn("fix_index", F.row_number().over(W.partitionBy("user_id").orderBy("t")).cast("long"))


def runs(tracks, what):
    """(user_id, first, last): islands of two fixes and more for which `what` holds."""
    w = W.partitionBy("user_id").orderBy("fix_index")
    held = tracks.filter(what).withColumn("g", F.col("fix_index") - F.row_number().over(w))
    return held.groupBy("user_id", "g").agg(F.min("fix_index").alias("first"), F.max("fix_index").alias("last")).filter("last > first").drop("g")


RUN = "SELECT user_id, min(fix) AS first, max(fix) AS last FROM (SELECT *, fix - row_number() OVER (PARTITION BY user_id ORDER BY fix) AS g FROM n WHERE {what}) GROUP BY user_id, g HAVING count(*) > 1"
PIECE, FAST = 86400, 2e-4


@query(f"""WITH RECURSIVE {NUMBERED}, ends AS (SELECT user_id, min(fix) + 1 AS a, max(fix) AS b FROM n GROUP BY 1 HAVING max(fix) > min(fix) + 1),
climbs AS ({RUN.format(what='value >= 50')}), rings AS ({RUN.format(what='value < 12')}),
held AS (SELECT user_id, greatest(first, a) AS first, least(last, b) AS last FROM climbs JOIN ends USING (user_id) WHERE least(last, b) > greatest(first, a)),
edges AS (SELECT * FROM held UNION ALL SELECT user_id, b, b FROM ends),
gaps AS (SELECT * FROM (SELECT e.user_id, coalesce(lag(last) OVER (PARTITION BY e.user_id ORDER BY first, last), a) AS gap, first AS until FROM edges e JOIN ends USING (user_id)) WHERE until > gap),
cuts AS (SELECT user_id, until, gap AS first, gap AS last FROM gaps
  UNION ALL SELECT c.user_id, until, c.last, (SELECT min(m.fix) FROM n m WHERE m.user_id = c.user_id AND m.fix > c.last AND m.fix <= c.until AND (m.fix = c.until OR m.t >= (SELECT t FROM n x WHERE x.user_id = c.user_id AND x.fix = c.last) + {PIECE})) FROM cuts c WHERE c.last < until),
kinds AS (SELECT c.user_id, c.first, c.last, CASE WHEN b.t > a.t AND abs(b.value - a.value) / (b.t - a.t) >= {FAST} AND NOT EXISTS (SELECT 1 FROM rings r WHERE r.user_id = c.user_id AND r.first < c.last AND r.last > c.first) THEN 'glide' ELSE 'search' END AS phase
  FROM cuts c JOIN n a ON a.user_id = c.user_id AND a.fix = c.first JOIN n b ON b.user_id = c.user_id AND b.fix = c.last WHERE c.last > c.first
  UNION ALL SELECT user_id, first, last, 'climb' FROM held),
marked AS (SELECT *, CASE WHEN lag(phase) OVER (PARTITION BY user_id ORDER BY first, last) = phase THEN 0 ELSE 1 END AS fresh FROM kinds),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY first, last) AS island FROM marked),
whole AS (SELECT user_id, phase, min(first) AS first, max(last) AS last FROM islands GROUP BY user_id, island, phase)
SELECT w.user_id, phase, first, last, b.t - a.t AS seconds FROM whole w JOIN n a ON a.user_id = w.user_id AND a.fix = first JOIN n b ON b.user_id = w.user_id AND b.fix = last""")
def flight_phases(spark, d):
    """Users' months as climbs (value of 50 and more), glides and search, in pieces of a day."""
    tracks = numbered(spark, d)
    flights = tracks.groupBy("user_id").agg((F.min("fix_index") + 1).alias("takeoff"), F.max("fix_index").alias("landing"))
    placed = tracks.select("user_id", "fix_index", "t", "value", (F.col("value") / METRES).alias("lat"), F.lit(0.0).alias("lon"))
    return phases.phases(placed, runs(tracks, "value >= 50"), runs(tracks, "value < 12"), flights, ["user_id"], float(PIECE), FAST).select("user_id", "phase", "first", "last", "seconds")


#: About as many metres has a degree along the equator's meridian.
METRES = 110574.2755
TURN = "((fix - 1) // 8)"


@query(f"""WITH {NUMBERED}, p AS (SELECT user_id, {TURN} // 3 AS segment, {TURN} AS circle, fix, t, 45 + value / 1e5 AS lat, 7 + (id % 97) / 1e5 AS lon FROM n),
m AS (SELECT *, avg(lat) OVER w AS lat0, avg(lon) OVER w AS lon0 FROM p WINDOW w AS (PARTITION BY user_id, circle)),
l AS (SELECT *, (lat - lat0) * 111320 AS u, (lon - lon0) * 111320 * cos(radians(lat0)) AS v FROM m),
s AS (SELECT user_id, segment, circle, lat0, lon0, count(*) AS n, min(t) AS ta, max(t) AS tb, sum(u*u) AS uu, sum(v*v) AS vv, sum(u*v) AS uv, sum(u*u*u) AS uuu, sum(v*v*v) AS vvv, sum(u*v*v) AS uvv, sum(v*u*u) AS vuu FROM l GROUP BY ALL),
c AS (SELECT *, (vv * (uuu + uvv) - uv * (vvv + vuu)) / (2 * (uu * vv - uv * uv)) AS cu, (uu * (vvv + vuu) - uv * (uuu + uvv)) / (2 * (uu * vv - uv * uv)) AS cv FROM s WHERE n >= 3 AND abs(uu * vv - uv * uv) >= 1e-10),
f AS (SELECT *, sqrt(cu*cu + cv*cv + (uu + vv) / n) AS radius, lat0 + cu / 111320 AS clat, lon0 + cv / (111320 * cos(radians(lat0))) AS clon, (ta + tb) / 2 AS mid FROM c),
w AS (SELECT *, clat - lag(clat) OVER o AS dlat, clon - lag(clon) OVER o AS dlon, (clat + lag(clat) OVER o) / 2 AS between_, mid - lag(mid) OVER o AS dt FROM f WINDOW o AS (PARTITION BY user_id, segment ORDER BY circle)),
r AS (SELECT *, sqrt(pow(dlat * 111320, 2) + pow(dlon * 111320 * cos(radians(between_)), 2)) / dt AS speed, degrees(atan2(dlon * 111320 * cos(radians(between_)), dlat * 111320)) + 180 AS direction FROM w)
SELECT user_id, circle, round(radius, 4) AS radius, CASE WHEN dt > 0 AND speed <= 30 THEN round(speed, 8) END AS drift, CASE WHEN dt > 0 AND speed <= 30 THEN round(direction - 360 * floor(direction / 360), 4) END AS direction FROM r""")
def circle_drift(spark, d):
    """Every eight fixes of a user as a turn, three turns a segment: the circle that fits, and the drift from turn to turn."""
    tracks = numbered(spark, d).select("user_id", "fix_index", "t", (45 + F.col("value") / 1e5).alias("lat"), (7 + F.col("id") % 97 / 1e5).alias("lon"))
    circle = F.floor((F.col("fix_index") - 1) / 8).cast("long").alias("circle")
    turns = tracks.groupBy("user_id", circle).agg(F.min("fix_index").alias("first"), F.max("fix_index").alias("last")).withColumn("segment", F.floor(F.col("circle") / 3).cast("long"))
    fitted = circles.fits(tracks, turns, ["user_id"])
    drift = circles.drift_winds(fitted, tracks, ["user_id"]).select("user_id", "circle", shown(F.col("speed"), 8).alias("drift"), shown(F.col("direction"), 4).alias("direction"))
    return fitted.select("user_id", "circle", shown(F.col("radius"), 4).alias("radius")).join(drift, ["user_id", "circle"], "left")


SPAN, RATE, NEAR = 172800, 3e-4, 15


@query(f"""WITH RECURSIVE {NUMBERED}, s AS (SELECT *, lag(t) OVER w AS t0, lag(value) OVER w AS z0 FROM n WINDOW w AS (PARTITION BY user_id ORDER BY fix)),
asks AS (SELECT user_id, fix AS i, t0, z0 FROM s WHERE t > t0 AND abs(value - z0) / (t - t0) > {RATE}),
back AS (SELECT a.user_id, i, a.t0, z0, min(n.fix) AS j FROM asks a JOIN n ON n.user_id = a.user_id AND n.fix >= i AND n.t > a.t0 AND n.t - a.t0 <= {SPAN} AND abs(n.value - z0) <= {NEAR} GROUP BY ALL),
held AS (SELECT user_id, min(i) AS i FROM back GROUP BY 1 UNION ALL SELECT h.user_id, (SELECT min(b.i) FROM back b WHERE b.user_id = h.user_id AND b.i > (SELECT j FROM back x WHERE x.user_id = h.user_id AND x.i = h.i)) FROM held h WHERE h.i IS NOT NULL)
SELECT n.user_id, n.fix, round(z0 + (e.value - z0) * ((n.t - b.t0) / (e.t - b.t0)), 6) AS repaired FROM held h JOIN back b USING (user_id, i) JOIN n e ON e.user_id = h.user_id AND e.fix = b.j JOIN n ON n.user_id = h.user_id AND n.fix >= b.i AND n.fix < b.j""")
def rate_excursions(spark, d):
    found = routes.rate_repairs(numbered(spark, d), ["user_id"], "value", RATE, float(SPAN), float(NEAR))
    return found.select("user_id", F.col("fix_index").alias("fix"), shown(F.col("repaired")).alias("repaired"))


# --- thermals: the first event of every half day of a user is a climb --------------------------------

DAY = 86400
USES = f"{FIXES}, uses AS (SELECT min(t) // {DAY} AS field, min(event_id) AS use, user_id AS pilot, min(t) AS start_t, min(t) + 600 + (user_id % 5) * 300 AS end_t, avg(value) * 40 AS east, (user_id % 11) * 300.0 AS north FROM fixes GROUP BY user_id, t // 43200)"


def uses(spark, d):
    one = fixes(spark, d).groupBy("user_id", F.floor(F.col("t") / 43200).alias("half")).agg(F.min("t").alias("start_t"), F.min("event_id").alias("use"), F.avg("value").alias("v"))
    return one.select(F.floor(F.col("start_t") / DAY).cast("long").alias("field"), "use", F.col("user_id").alias("pilot"), "start_t", (F.col("start_t") + 600 + F.col("user_id") % 5 * 300).alias("end_t"), (F.col("v") * 40).alias("east"), (F.col("user_id") % 11 * 300.0).alias("north"))


GROUPED = f"""{USES}, pairs AS (SELECT a.use AS u, b.use AS v FROM uses a JOIN uses b ON a.field = b.field AND a.use <> b.use AND a.start_t <= b.end_t + 120 AND b.start_t <= a.end_t + 120 AND sqrt(pow(a.east - b.east, 2) + pow(a.north - b.north, 2)) <= 800),
reach AS (SELECT use AS u, use AS v FROM uses UNION SELECT r.u, p.v FROM reach r JOIN pairs p ON r.v = p.u),
grouped AS (SELECT uses.*, grp FROM uses JOIN (SELECT u AS use, min(v) AS grp FROM reach GROUP BY 1) USING (use))"""


@query(f"""WITH RECURSIVE {GROUPED}, each AS (SELECT field, grp, avg(east) AS east, avg(north) AS north, min(start_t) AS start_t, max(end_t) AS end_t, count(DISTINCT pilot) AS pilots, count(*) AS uses FROM grouped GROUP BY ALL)
SELECT field, row_number() OVER (PARTITION BY field ORDER BY start_t, grp) AS thermal, round(east, 4) AS east, round(north, 4) AS north, start_t, end_t, pilots, uses FROM each""")
def shared_thermals(spark, d):
    found = thermals.assembled(thermals.shared(uses(spark, d), ["field"]), ["field"])
    return found.select("field", "thermal", shown(F.col("east"), 4).alias("east"), shown(F.col("north"), 4).alias("north"), "start_t", "end_t", "pilots", "uses")


@query(f"""WITH RECURSIVE {GROUPED}, m AS (SELECT *, east - avg(east) OVER w AS x, north - avg(north) OVER w AS y, count(*) OVER w AS n, max(end_t) OVER w - min(start_t) OVER w AS lasts FROM grouped WINDOW w AS (PARTITION BY field, grp)),
a AS (SELECT *, 0.5 * atan2(2 * sum(x * y) OVER w, sum(x * x) OVER w - sum(y * y) OVER w) AS angle FROM m WINDOW w AS (PARTITION BY field, grp)),
p AS (SELECT *, x * cos(angle) + y * sin(angle) AS along FROM a), q AS (SELECT *, max(along) OVER (PARTITION BY field, grp) - min(along) OVER (PARTITION BY field, grp) AS extent FROM p),
v AS (SELECT *, CASE WHEN n > 1 THEN CASE WHEN extent > 1000 THEN along WHEN lasts > 1800 THEN (start_t + end_t) / 2 END END AS value FROM q),
k AS (SELECT *, row_number() OVER w - 1 AS k, value - lag(value) OVER w AS gap FROM v WINDOW w AS (PARTITION BY field, grp ORDER BY value, use)),
b AS (SELECT field, grp, first(k ORDER BY gap DESC, k) AS cut FROM k WHERE k >= greatest(1, floor(n * 0.25)) AND k < least(n - 1, ceil(n * 0.75)) AND gap > 0 GROUP BY ALL)
SELECT field, use, grp, round(extent, 4) AS extent, CASE WHEN value IS NULL THEN '.' WHEN k < coalesce(cut, floor(n / 2)) THEN 'a' ELSE 'b' END AS side FROM k LEFT JOIN b USING (field, grp)""")
def thermal_halves(spark, d):
    """Thermals too long in place or time, halved once at the widest gap along their principal axis or in time."""
    cut = thermals.sides(thermals.shared(uses(spark, d), ["field"]), ["field"])
    return cut.select("field", "use", "grp", shown(F.col("extent"), 4).alias("extent"), "side")


@query()
def thermal_columns(spark, d):
    """Thermals apart until each is a column of its own: thermal_halves, over and over."""
    apart = thermals.columns(thermals.shared(uses(spark, d), ["field"]), ["field"])
    return thermals.assembled(apart, ["field"]).select("field", "thermal", "grp", shown(F.col("east"), 4).alias("east"), shown(F.col("north"), 4).alias("north"), "start_t", "end_t", "pilots", "uses")


SAMPLED = f"{FIXES}, s AS (SELECT event_type AS thermal, event_id AS sample, user_id AS pilot, t, (event_id * 37) % 211 - 105.0 AS east, (event_id * 53) % 199 - 99.0 AS north, (event_id % 431) * 2.0 AS alt, value / 37.3 - 1 AS rate FROM fixes)"


def sampled(spark, d):
    i = F.col("event_id")
    return fixes(spark, d).select(F.col("event_type").alias("thermal"), i.alias("sample"), F.col("user_id").alias("pilot"), "t", ((i * 37) % 211 - 105.0).alias("east"), ((i * 53) % 199 - 99.0).alias("north"), (i % 431 * 2.0).alias("alt"), (F.col("value") / 37.3 - 1).alias("rate"))


BANDS = f"""{SAMPLED}, h AS (SELECT *, floor(alt / 100)::BIGINT AS band, greatest(rate, 0) AS lift FROM s),
c AS (SELECT thermal, band, count(*) AS n, count(DISTINCT pilot) AS pilots, CASE WHEN sum(lift) > 1e-6 THEN sum(east * lift) / sum(lift) ELSE avg(east) END AS ce, CASE WHEN sum(lift) > 1e-6 THEN sum(north * lift) / sum(lift) ELSE avg(north) END AS cn FROM h GROUP BY ALL HAVING count(*) >= 15),
ab AS (SELECT *, sqrt((east - ce) * (east - ce) + (north - cn) * (north - cn)) AS away, degrees(atan2(east - ce, north - cn)) AS turn FROM h JOIN c USING (thermal, band)),
se AS (SELECT *, (floor((turn - 360 * floor(turn / 360)) / 45 + 0.5) % 8)::INTEGER AS sector FROM ab),
bands AS (SELECT thermal, band, n, pilots, ce, cn, quantile_cont(away, 0.9) AS extent_radius, sqrt(sum(away * away * lift) / sum(lift)) AS core_radius, avg(rate) AS mean_rate, max(rate) AS max_rate FROM se GROUP BY ALL)"""


@query(f"WITH {BANDS} SELECT b.thermal, b.band, n, pilots, round(ce, 4) AS east, round(cn, 4) AS north, round(core_radius, 4) AS core_radius, round(extent_radius, 4) AS extent_radius, round(mean_rate, 6) AS mean_rate, round(max_rate, 6) AS max_rate, sector, round(rate, 4) AS sector_rate FROM bands b JOIN (SELECT thermal, band, sector, avg(rate) AS rate FROM se GROUP BY ALL) USING (thermal, band)")
def thermal_bands(spark, d):
    found = thermals.bands(sampled(spark, d), ["thermal"])
    each = found.select("*", F.posexplode("sector_rate").alias("sector", "r")).filter("r is not null")
    return each.select("thermal", "band", "n", "pilots", shown(F.col("core_east"), 4).alias("east"), shown(F.col("core_north"), 4).alias("north"), *[shown(F.col(c), 4).alias(c) for c in ("core_radius", "extent_radius")], *[shown(F.col(c)).alias(c) for c in ("mean_rate", "max_rate")], "sector", shown(F.col("r"), 4).alias("sector_rate"))


@query(f"""WITH {BANDS}, w AS (SELECT thermal, sum(n) AS t, sum((band + 0.5) * 100 * n) / sum(n) AS m, sum(ce * n) / sum(n) AS e, sum(cn * n) / sum(n) AS o FROM bands GROUP BY 1),
x AS (SELECT thermal, count(*) AS bands, sum(pow((band + 0.5) * 100 - m, 2) * n) AS aa, sum(((band + 0.5) * 100 - m) * (ce - e) * n) AS ae, sum(((band + 0.5) * 100 - m) * (cn - o) * n) AS an FROM bands JOIN w USING (thermal) GROUP BY 1),
r AS (SELECT thermal, corr(alt, t) AS r FROM s GROUP BY 1),
v AS (SELECT thermal, sector, avg(rate) AS rate FROM se GROUP BY ALL),
z AS (SELECT thermal, first(sector ORDER BY rate DESC, sector) AS side, max(rate) AS best FROM v GROUP BY 1)
SELECT thermal, bands, round(degrees(atan2(ae / aa, an / aa)) - 360 * floor(degrees(atan2(ae / aa, an / aa)) / 360), 4) AS bearing, round(degrees(atan(sqrt(pow(ae / aa, 2) + pow(an / aa, 2)))), 6) AS tilt, round(r, 6) AS correlation, abs(r) > 0.85 AS confounded, side * 45.0::DOUBLE AS side, round(best, 6) AS rate, round(v.rate, 6) AS opposite
FROM x JOIN r USING (thermal) JOIN z USING (thermal) LEFT JOIN v ON v.thermal = x.thermal AND v.sector = (side + 4) % 8 WHERE bands >= 3""")
def thermal_shapes(spark, d):
    found = sampled(spark, d)
    banded = thermals.bands(found, ["thermal"])
    lean = thermals.leans(banded, found, ["thermal"])
    sides = thermals.strongest_sides(banded, ["thermal"]).select("thermal", F.col("bearing").cast("double").alias("side"), shown(F.col("rate")).alias("rate"), shown(F.col("opposite")).alias("opposite"))
    return lean.select("thermal", "bands", shown(F.col("bearing"), 4).alias("bearing"), shown(F.col("tilt")).alias("tilt"), shown(F.col("correlation")).alias("correlation"), "confounded").join(sides, "thermal")
