"""Lookups, text scalars, search words and early starts on small tables, each with its odd cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from thermion.functions import text
from thermion.operators import field, joins, search, windows
from thermion.plans import scoring


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(("raw", "degrees"), [("3603.250S", -(36 + 3.25 / 60)), ("14700.5 E", 147 + 0.5 / 60), (" -36.5 ", -36.5), ("15S", None), ("", None), ("north", None), (None, None)])
def test_coordinate(spark, raw, degrees):
    assert one(spark, text.coordinate, raw) == (pytest.approx(degrees) if degrees is not None else None)


@pytest.mark.parametrize(("raw", "seconds"), [("12:30:05Z", 45005), ("01:02", 3720), ("24:00", None), ("1:60:00", None), ("noon", None), (None, None)])
def test_time_of_day(spark, raw, seconds):
    assert one(spark, text.time_of_day, raw) == seconds


@pytest.mark.parametrize(("n", "word"), [(1, "1st"), (2, "2nd"), (3, "3rd"), (4, "4th"), (11, "11th"), (112, "112th"), (21, "21st")])
def test_ordinal(spark, n, word):
    assert one(spark, text.ordinal, n, "int") == word


def test_texts(spark):
    assert one(spark, text.plain_text, "<b>a</b> & 'b' < \"c") == "a &amp; &#39;b&#39; &lt; &quot;c"
    assert one(spark, text.plain_text, None) == ""
    assert [one(spark, text.masked_email, x) for x in ("jo@x.org", "jo", "@x.org", "", None)] == ["j***@x.org", "***", "***@x.org", None, None]
    assert one(spark, text.name_key, " Ann \t Lee ") == "ann lee"
    assert [one(spark, text.duration, x, "double") for x in (59.9, 3600.0, 36061.0)] == ["00:59", "1:00:00", "10:01:01"]


def test_query_words():
    assert search.query_words("Corryong Cup, a 3 x!") == ["corryong", "cup", "3"]
    assert search.query_words(None) == [] and len(search.query_words("aa bb cc dd ee ff")) == 5


def test_match_all(spark):
    docs = spark.createDataFrame([(1, "elliot", "task one"), (2, "elliotson", "task"), (3, None, "elliot tas"), (4, "other", None)], "id int, title string, body string")
    found = {r["id"]: r["score"] for r in search.match_all(docs, "id", {"title": 10.0, "body": 1.0}, ["elliot", "tas"]).collect()}
    assert set(found) == {1, 3} and found[1] > found[3]  # the title weighs more; only the last word is a prefix
    assert search.match_all(docs, "id", {"title": 1.0}, []).count() == 0


def test_by_name(spark):
    names = spark.createDataFrame([("ELLIOT", 0), ("Halfwy", 1), ("", 2), ("EL", 3), ("elliot", 4)], "name string, number int")
    asked = spark.createDataFrame([("elliot",), ("START Elliot",), ("the HALFWY point",), ("el",), ("e",), ("",), (None,)], "name string")
    found = {r["name"]: (r["number"], r["match"]) for r in joins.by_name(asked, names, "name", "number", ["START", "TURN"]).collect()}
    assert found == {"elliot": (0, "exact"), "START Elliot": (0, "stripped"), "the HALFWY point": (1, "contained"), "el": (3, "exact"), "": (2, "exact")}


def test_nearest(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0), (2, 99.0, 0.0), (3, None, 0.0)], "a int, e double, n double")
    b = spark.createDataFrame([(7, 3.0, 4.0), (6, -3.0, -4.0), (5, 0.0, 9.0)], "b int, e double, n double")
    assert [tuple(r) for r in joins.nearest_within(a, b, "a", "b", "e", "n", 10.0).collect()] == [(1, 6, 5.0)]
    shots = spark.createDataFrame([("g", 0, "x"), ("g", 10, "y")], "k string, t long, m string")
    asked = spark.createDataFrame([("g", 5), ("g", 11), ("g", 30), ("h", 0)], "k string, t long")
    assert sorted(tuple(r) for r in joins.nearest_snapshot(asked, shots, ["k"], "t", 10).collect()) == [("g", 5, 0, "x"), ("g", 11, 10, "y")]
    with pytest.raises(ValueError, match="not in the field"):
        joins.values_of_all(a.select("a"), b.select(F.col("b").alias("a")), "a")


def test_rates_of_short_tracks(spark):
    df = spark.createDataFrame([("a", t, float(v)) for t, v in [(0, 0), (10, 10), (20, 40), (30, 40)]] + [("b", 0, 1.0), ("c", 0, 5.0), ("c", 10, 1.0)], "k string, t long, v double")
    assert {r.k: r.seconds for r in windows.time_to_share_of_peak(df, ["k"], "t", "v", 10, 0.9).collect()} == {"a": 20, "b": None, "c": None}
    assert {r.k: r.rate for r in windows.final_rate(df, ["k"], "t", "v", 15).collect()} == {"a": 1.5, "b": None, "c": None}
    found = {r.k: (r.climb_rate, r.climb_at, r.sink_rate) for r in windows.rate_extremes(df, ["k"], "t", "v", 1, 0.5, -0.1).collect()}
    assert found == {"a": (3.0, 20, None), "c": (None, None, -0.4)}


def test_parameters_and_words(spark):
    values = [("12", 12.0), ("200", 80.0), ("-1", 10.0), ("x", 35.0), ("NaN", 35.0), ("Infinity", 35.0), (None, 35.0)]
    assert [one(spark, lambda x: field.merged(x, 35.0, 10, 80), v) for v, _ in values] == [w for _, w in values]
    assert [one(spark, text.date_words, x) for x in ("2026-01-05", "soon", "2026-13-05", None)] == ["2026-01-05 january 2026", "soon", "2026-13-05", ""]
    assert [one(spark, text.list_words, x) for x in ('["open", "sport"]', "{", None)] == ["open sport", "", ""]


def test_manual_flights(spark):
    tracked = spark.createDataFrame([("t", 1, 50.0)], "task string, pilot int, distance double")
    entered = spark.createDataFrame([("t", 1, 9.0), ("t", 2, 7.0)], "task string, pilot int, distance double")
    assert sorted(tuple(r) for r in field.with_manual(tracked, entered, ["task", "pilot"]).collect()) == [("t", 1, 50.0, False), ("t", 2, 7.0, True)]


def test_early_starts(spark):
    kind = "pilot int, early double, distance double, goal boolean, ess boolean, time double, ess_time double, leading double, penalty double"
    df = spark.createDataFrame([(i, e, 9e3, True, True, 60.0, 70.0, 1.0, None) for i, e in enumerate((None, 0.0, 10.0, 400.0))], kind)
    rows = lambda how: [(r.early_outcome, r.distance, r.goal, r.time, r.penalty) for r in scoring.early_starts(df, "early", how, 300, F.lit(4e3), 2.0).orderBy("pilot").collect()]
    free = (None, 9e3, True, 60.0, 0.0)
    assert rows("HG") == [free, free, ("penalty", 9e3, True, 60.0, 5.0), ("minimum_distance", 0.0, False, None, 0.0)]
    assert rows("PG") == [free, free, *[("launch_to_start", 4e3, False, None, 0.0)] * 2]
