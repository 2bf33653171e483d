"""Queries of lookups by place, time and name, of search and of text, with their SQL; registered with the catalogue's."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.numbers import shown
from ..operators import field, joins, search
from .catalog import FIXES, FLIGHTS, W, fixes, flights, query, table
from .field import ONE, tracks


@query("""WITH a AS (SELECT s_suppkey, s_suppkey * 7919 % 100003 / 10.0 AS x, s_suppkey * 104729 % 99991 / 10.0 AS y FROM supplier), b AS (SELECT c_custkey, c_custkey * 15485863 % 100003 / 10.0 AS x, c_custkey * 32452843 % 99991 / 10.0 AS y FROM customer),
m AS (SELECT s_suppkey, c_custkey, sqrt((a.x - b.x)**2 + (a.y - b.y)**2) AS metres FROM a JOIN b ON abs(a.x - b.x) <= 400 AND abs(a.y - b.y) <= 400)
SELECT s_suppkey, first(c_custkey ORDER BY metres, c_custkey) AS c_custkey, round(min(metres), 6) AS metres FROM m WHERE metres <= 400 GROUP BY 1""")
def nearest_within(spark, d):
    """Customers as waypoints on a plane of 10 km: the nearest within 400 m of each supplier."""
    place = lambda key, p, q: ((F.col(key) * p % 100003 / 10.0).alias("x"), (F.col(key) * q % 99991 / 10.0).alias("y"))
    a = table(spark, d, "supplier").select("s_suppkey", *place("s_suppkey", 7919, 104729))
    b = table(spark, d, "customer").select("c_custkey", *place("c_custkey", 15485863, 32452843))
    found = joins.nearest_within(a, b, "s_suppkey", "c_custkey", "x", "y", 400.0)
    return found.select("s_suppkey", "c_custkey", shown(F.col("metres")).alias("metres"))


GRID = f"{FIXES}, g AS (SELECT user_id, t // 3600 AS step, max(value) AS height FROM fixes GROUP BY ALL)"


@query(f"""WITH {GRID} SELECT event_id, step, height FROM (SELECT event_id, user_id, floor(t / 3600 + 0.5)::BIGINT AS step FROM fixes) LEFT JOIN g USING (user_id, step)""")
def nearest_grid_step(spark, d):
    """The user's height at the hour nearest each event."""
    own = fixes(spark, d)
    grid = own.groupBy("user_id", F.floor(F.col("t") / 3600).cast("long").alias("step")).agg(F.max("value").alias("height"))
    return joins.nearest_step(own.select("event_id", "user_id", "t"), grid, ["user_id"], "t", 0, 3600).select("event_id", "step", "height")


@query(f"""WITH {FIXES}, asked AS (SELECT DISTINCT user_id, t // 7200 * 7200 AS t FROM fixes WHERE event_type = 'click'), shots AS (SELECT user_id, t, max(value) AS members FROM fixes WHERE event_type <> 'click' GROUP BY ALL),
m AS (SELECT a.user_id, a.t, s.t AS "at", members FROM asked a JOIN shots s ON s.user_id = a.user_id AND abs(s.t - a.t) <= 7200)
SELECT user_id, t, first("at" ORDER BY abs("at" - t), "at") AS "at", first(members ORDER BY abs("at" - t), "at") AS members FROM m GROUP BY ALL""")
def nearest_snapshot(spark, d):
    """The shot of a user nearest each asked time, within two hours."""
    own = fixes(spark, d)
    asked = own.filter("event_type = 'click'").select("user_id", (F.floor(F.col("t") / 7200) * 7200).cast("long").alias("t"))
    shots = own.filter("event_type <> 'click'").groupBy("user_id", "t").agg(F.max("value").alias("members"))
    return joins.nearest_snapshot(asked, shots, ["user_id"], "t", 7200)


@query("""WITH asked AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN 'Start ' || n_name WHEN 1 THEN lower(n_name) WHEN 2 THEN 'via ' || n_name || ' ' || p_size ELSE p_brand END AS name FROM part JOIN nation ON n_nationkey = p_partkey % 25),
u AS (SELECT name, upper(name) AS u, trim(regexp_replace(upper(name), '^(START|TURN|GOAL)\\s+', '')) AS s FROM asked),
m AS (SELECT name, n_nationkey AS number, CASE WHEN u = upper(n_name) THEN 0 WHEN s = upper(n_name) THEN 1 WHEN length(n_name) >= 3 AND contains(u, upper(n_name)) THEN 2 END AS level FROM u, nation)
SELECT name, first(number ORDER BY level, number) AS number, ['exact', 'stripped', 'contained'][min(level) + 1] AS match FROM m WHERE level IS NOT NULL GROUP BY 1""")
def waypoint_by_name(spark, d):
    """Nations as waypoints, names made of them as those asked for."""
    n = table(spark, d, "nation")
    p = table(spark, d, "part").withColumn("n_nationkey", (F.col("p_partkey") % 25).cast("int")).join(n, "n_nationkey")
    kind = F.col("p_partkey") % 4
    name = F.when(kind == 0, F.concat(F.lit("Start "), "n_name")).when(kind == 1, F.lower("n_name")).when(kind == 2, F.concat(F.lit("via "), "n_name", F.lit(" "), F.col("p_size").cast("string"))).otherwise(F.col("p_brand"))
    return joins.by_name(p.select(name.alias("name")), n.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("number")), "name", "number", ["START", "TURN", "GOAL"])


@query(f"""WITH {ONE}, f AS (SELECT user_id AS c_custkey, max(value) AS best FROM p GROUP BY 1) SELECT c_custkey, best FROM customer LEFT JOIN f USING (c_custkey)""")
def metric_values(spark, d):
    """A value for every customer, null without one."""
    pilots = table(spark, d, "customer").select("c_custkey")
    best = tracks(spark, d).groupBy(F.col("user_id").alias("c_custkey")).agg(F.max("value").alias("best")).join(pilots, "c_custkey", "left_semi")
    return joins.values_of_all(best, pilots, "c_custkey")


TERMS = ["the", "o"]


def _match_sql(weights: dict[str, float]) -> str:
    words = lambda c: f"[x FOR x IN regexp_split_to_array(lower(coalesce({c}, '')), '[^a-z0-9]+') IF x <> '']"
    hit = lambda i: f"starts_with(x, '{TERMS[i]}')" if i == len(TERMS) - 1 else f"x = '{TERMS[i]}'"
    f = ", ".join(" + ".join(f"len([x FOR x IN {words(c)} IF {hit(i)}]) * {w}" for c, w in weights.items()) + f" AS f{i}" for i in range(len(TERMS)))
    size = " + ".join(f"len({words(c)})" for c in weights)
    figures = ", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(len(TERMS)))
    score = " + ".join(f"greatest(ln((docs - n{i} + 0.5) / (n{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * size / mean))" for i in range(len(TERMS)))
    return f"WITH c AS (SELECT doc_id, ({size})::DOUBLE AS size, {f} FROM documents), g AS (SELECT count(*) AS docs, avg(size) AS mean, {figures} FROM c) SELECT doc_id, round({score}, 6) AS score FROM c, g WHERE " + " AND ".join(f"f{i} > 0" for i in range(len(TERMS)))


@query(_match_sql({"source": 10.0, "lang": 8.0, "text": 1.0}))
def search_match_all(spark, d):
    """Documents that hold every word of a query, the last as a prefix, by weighted columns."""
    found = search.match_all(table(spark, d, "documents"), "doc_id", {"source": 10.0, "lang": 8.0, "text": 1.0}, TERMS)
    return found.select("doc_id", shown(F.col("score")).alias("score"))


@query("""WITH r AS (SELECT c_custkey, rank() OVER w AS position, count(*) OVER (PARTITION BY c_nationkey) AS n, count(*) OVER (PARTITION BY c_nationkey, floor(c_acctbal / 100)) > 1 AS tied FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY floor(c_acctbal / 100) DESC)),
l AS (SELECT c_custkey, CASE WHEN tied THEN 'equal ' ELSE '' END || CASE WHEN position > 1 THEN position || CASE WHEN position % 100 BETWEEN 11 AND 13 THEN 'th' ELSE ['th', 'st', 'nd', 'rd', 'th', 'th', 'th', 'th', 'th', 'th'][position % 10 + 1] END || ' ' ELSE '' END || 'richest of ' || n AS label FROM r)
SELECT c_custkey, upper(label[1]) || label[2:] AS label FROM l""")
def rank_labels(spark, d):
    c = table(spark, d, "customer").withColumn("band", F.floor(F.col("c_acctbal") / 100))
    ranked = c.select("c_custkey", F.rank().over(W.partitionBy("c_nationkey").orderBy(F.col("band").desc())).alias("position"), F.count("*").over(W.partitionBy("c_nationkey")).alias("n"), (F.count("*").over(W.partitionBy("c_nationkey", "band")) > 1).alias("tied"))
    return ranked.select("c_custkey", text.rank_label(F.col("position"), F.col("n"), F.col("tied"), "richest").alias("label"))


@query("""WITH t AS (SELECT p_partkey, '  <b>' || p_name || '</b> & "' || p_brand || '"  ' AS raw, p_size * 977 AS s, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN 'a' || p_partkey || '@' || p_size || '.org' ELSE '' END AS mail FROM part)
SELECT p_partkey, replace(replace(replace(replace(replace(regexp_replace(raw, '<[^>]*>', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS plain,
  lower(trim(regexp_replace(raw, '\\s+', ' ', 'g'))) AS key, CASE WHEN s >= 3600 THEN s // 3600 || ':' ELSE '' END || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS took,
  CASE WHEN mail = '' THEN NULL WHEN contains(mail, '@') THEN mail[1] || '***@' || split_part(mail, '@', 2) ELSE '***' END AS masked FROM t""")
def shown_text(spark, d):
    p = table(spark, d, "part")
    raw = F.concat(F.lit("  <b>"), "p_name", F.lit('</b> & "'), "p_brand", F.lit('"  '))
    kind = F.col("p_partkey") % 3
    mail = F.when(kind == 0, F.col("p_brand")).when(kind == 1, F.concat(F.lit("a"), F.col("p_partkey").cast("string"), F.lit("@"), F.col("p_size").cast("string"), F.lit(".org"))).otherwise("")
    return p.select("p_partkey", text.plain_text(raw).alias("plain"), text.name_key(raw).alias("key"), text.duration(F.col("p_size") * 977).alias("took"), text.masked_email(mail).alias("masked"))


@query("""SELECT c_custkey, round(c_acctbal - (SELECT avg(c_acctbal) FROM customer), 4) AS above FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)""")
def scalar_subquery(spark, d):
    table(spark, d, "customer").createOrReplaceTempView("_customer")
    return spark.sql("SELECT c_custkey, round(c_acctbal - (SELECT avg(c_acctbal) FROM _customer), 4) AS above FROM _customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM _customer)")


@query("""SELECT c_custkey FROM customer c WHERE c_mktsegment <> 'BUILDING' OR EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey AND s_nationkey = 3)""")
def visible_to(spark, d):
    """Rows that are public, or that the user (nation 3) administers."""
    mine = table(spark, d, "supplier").filter("s_nationkey = 3").select(F.col("s_suppkey").alias("c_custkey")).distinct().withColumn("mine", F.lit(True))
    return table(spark, d, "customer").join(mine, "c_custkey", "left").filter("c_mktsegment <> 'BUILDING' OR mine").select("c_custkey")


FIRST_LAST = f"""{FIXES}, k AS (SELECT user_id, t, value, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM fixes), s AS (SELECT user_id, i AS a, i + 3 AS b FROM k WHERE i % 4 = 1)"""


@query(f"""WITH {FIRST_LAST} SELECT s.user_id, a AS start, b AS "end", x.t AS start_t, x.value AS start_value, y.t AS end_t, y.value AS end_value
FROM s LEFT JOIN k x ON x.user_id = s.user_id AND x.i = a LEFT JOIN k y ON y.user_id = s.user_id AND y.i = b""")
def segment_ends(spark, d):
    """Every four fixes of a track as a segment: times and heights of its ends."""
    k = fixes(spark, d).select("user_id", "t", "value", F.row_number().over(W.partitionBy("user_id").orderBy("t", "event_id")).cast("long").alias("i"))
    s = k.filter("i % 4 = 1").select("user_id", F.col("i").alias("start"), (F.col("i") + 3).alias("end"))
    return field.segment_ends(s, k, ["user_id"], "i", ["t", "value"]).select("user_id", "start", "end", "start_t", "start_value", "end_t", "end_value")


@query(f"""WITH {FLIGHTS}, t AS (SELECT task, pilot, distance FROM flights WHERE pilot % 6 <> 0), m AS (SELECT DISTINCT o_orderpriority AS task, c_custkey AS pilot, 7000.0 + c_custkey AS distance FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 3 = 0)
SELECT task, pilot, round(distance, 4) AS distance, FALSE AS by_hand FROM t UNION ALL SELECT task, pilot, distance, TRUE FROM m WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.task = m.task AND t.pilot = m.pilot)""")
def manual_flights(spark, d):
    """Flights with a track, and entries by hand for pilots without."""
    tracked = flights(spark, d).filter("pilot % 6 <> 0").select("task", "pilot", shown(F.col("distance"), 4).alias("distance"))
    by_hand = table(spark, d, "orders").filter("o_custkey % 3 = 0").select(F.col("o_orderpriority").alias("task"), F.col("o_custkey").alias("pilot")).distinct().withColumn("distance", 7000.0 + F.col("pilot"))
    held = by_hand.join(table(spark, d, "customer").select(F.col("c_custkey").alias("pilot")), "pilot", "left_semi").select("task", "pilot", "distance")
    return field.with_manual(tracked, held, ["task", "pilot"])


@query("""WITH v AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN json_extract_string(props, '$.k') WHEN event_id % 3 = 1 THEN event_type END AS raw FROM events)
SELECT event_id, least(80.0, greatest(10.0, coalesce(TRY_CAST(raw AS DOUBLE), 35.0))) AS parameter FROM v""")
def merged_parameters(spark, d):
    """Parameters from text: defaults for what is missing or no number, kept from 10 to 80."""
    kind = F.col("event_id") % 3
    raw = F.when(kind == 0, F.get_json_object("props", "$.k")).when(kind == 1, F.col("event_type"))
    return table(spark, d, "events").select("event_id", field.merged(raw, 35.0, 10, 80).alias("parameter"))


@query(f"""WITH {ONE}, m AS (SELECT user_id, t, avg(round(value * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 43200 PRECEDING AND 43200 FOLLOWING) AS mean FROM p),
s AS (SELECT user_id, mean - lag(mean) OVER (PARTITION BY user_id ORDER BY t) AS step FROM m) SELECT user_id, round(coalesce(sum(step) FILTER (step > 0), 0), 4) AS gained FROM s GROUP BY 1""")
def rising_sum(spark, d):
    """Hundredths gained by the mean of half a day before and after."""
    whole = tracks(spark, d).withColumn("value", F.round(F.col("value") * 100).cast("long"))
    found = field.rising_sum(whole, ["user_id"], "t", "value", 43200)
    return found.select("user_id", shown(F.col("gained"), 4).alias("gained"))


@query("""WITH p AS (SELECT o_custkey AS task, o_orderkey, o_totalprice % 1000 / 10.0 AS lat, o_totalprice % 777 / 10.0 AS lon FROM orders),
l AS (SELECT task, lat, lon, lag(lat) OVER w AS a, lag(lon) OVER w AS b FROM p WINDOW w AS (PARTITION BY task ORDER BY o_orderkey))
SELECT task, round(sum(CASE WHEN a IS NULL THEN 0.0 ELSE sqrt((lat - a)**2 + (lon - b)**2) END), 5) AS metres FROM l GROUP BY 1""")
def nominal_distance(spark, d):
    """A customer's orders as a task's turnpoints on a plane: its length from centre to centre."""
    p = table(spark, d, "orders").select(F.col("o_custkey").alias("task"), "o_orderkey", (F.col("o_totalprice") % 1000 / 10.0).alias("lat"), (F.col("o_totalprice") % 777 / 10.0).alias("lon"))
    found = field.nominal_distance(p, ["task"], "o_orderkey", lambda a, b, c, e: F.sqrt((c - a) * (c - a) + (e - b) * (e - b)))
    return found.select("task", shown(F.col("metres"), 5).alias("metres"))


@query("""SELECT o_orderkey, round(CASE WHEN o_totalprice > 90000 THEN 500000 / (o_totalprice - 90000) END, 6) AS glide, strftime(o_orderdate, '%Y-%m-%d') || ' ' || lower(strftime(o_orderdate, '%B')) || ' ' || year(o_orderdate) AS words FROM orders""")
def glides_and_dates(spark, d):
    """The glide to a target that each order's price stands above, and the words its date is found by."""
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, d, "orders").select("o_orderkey", shown(field.required_glide(F.lit(500000), F.col("o_totalprice"), F.lit(90000))).alias("glide"), text.date_words(iso).alias("words"))


@query(f"""WITH {FIXES}, k AS (SELECT DISTINCT user_id, (t // 86400)::BIGINT AS day, event_type FROM fixes)
SELECT n.user_id, n.day, count(b.event_type) AS kept FROM k n LEFT JOIN k b ON b.user_id = n.user_id AND b.day = n.day - 1 AND b.event_type = n.event_type GROUP BY ALL""")
def kinds_kept(spark, d):
    """How many of the kinds of a user's events of a day were there the day before: overlaps of small sets."""
    day = F.floor(F.col("t") / 86400).cast("long").alias("day")
    sets = fixes(spark, d).groupBy("user_id", day).agg(F.collect_set("event_type").alias("now"))
    before = sets.select("user_id", (F.col("day") + 1).alias("day"), F.col("now").alias("then"))
    kept = F.when(F.col("then").isNotNull(), text.overlap(F.col("now"), F.col("then"))).otherwise(0)
    return sets.join(before, ["user_id", "day"], "left").select("user_id", "day", kept.cast("long").alias("kept"))
