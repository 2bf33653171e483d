"""Readers, writers, geodesy, detectors and streaming on tracks and tasks made here."""

from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from thermion.functions import geo
from thermion.operators import detectors
from thermion.sources import igc, tasks, waypoints
from thermion.streaming import live


def test_inverse_and_direct_agree():
    # a published line of the geodetic literature: Flinders Peak to Buninyong, nearly equal on this ellipsoid
    metres, azimuth = geo.inverse([-37.95103342], [144.42486789], [-37.65282114], [143.92649554])
    assert metres[0] == pytest.approx(54972.271, abs=0.01)
    assert azimuth[0] == pytest.approx(306.86816, abs=1e-4)
    lat, lon = geo.direct([-37.95103342], [144.42486789], azimuth, metres)
    assert (lat[0], lon[0]) == pytest.approx((-37.65282114, 143.92649554), abs=1e-8)
    same, _ = geo.inverse([10.0, np.nan], [20.0, 1], [10.0, 1], [20.0, 1])
    assert same[0] == 0 and np.isnan(same[1])


def test_igc_reader(spark, tmp_path):
    lines = ["AXXX", "HFDTE050126", "HFPLTPILOT: Ann Example ", "HFGTYGLIDERTYPE:Wing", "B2359583611150S14758521EA0000000929", "B2359593611150S14758521EA0010000930", "Bgarbage", "B0000013611160S14758521EA0000000931", "B0000003611160S14758521EV-012300931", "B2300003611160S14758521EA0000000931", "C3611150S14758521EHILL"]
    (tmp_path / "a.igc").write_text("\r\n".join(lines))
    (tmp_path / "b.igc").write_text("no date here\nB1200003611150S14758521EA0000000929\n")
    source = igc.lines(spark, str(tmp_path))
    rows = igc.fixes(source).orderBy("fix_index").collect()
    assert [r["fix_index"] for r in rows] == [0, 1, 2, 3]
    assert rows[0]["lat"] == pytest.approx(-(36 + 11.150 / 60)) and rows[0]["lon"] == pytest.approx(147 + 58.521 / 60)
    assert [r["time_ms"] - rows[0]["time_ms"] for r in rows] == [0, 1000, 2000, 82_802_000]  # one roll over midnight; the fix that a step back shows to be ahead dropped
    assert rows[2]["pressure_alt"] == -123 and not rows[2]["valid"]
    head = igc.headers(source).filter("date is not null").first()
    assert str(head["date"]) == "2026-01-05" and head["pilot"] == "Ann Example" and head["glider_type"] == "Wing"
    assert {r["malformed"] for r in igc.report(source).collect()} == {0, 1}
    assert igc.declared(source).first()["points"][0]["name"] == "HILL"
    again = igc.written_fixes(igc.fixes(source)).orderBy("fix_index").collect()
    assert again[0]["line"] == lines[4] and again[2]["line"] == lines[8]


@pytest.mark.parametrize("kind", list(waypoints.READERS))
def test_waypoints_round_trip(spark, tmp_path, kind):
    points = [("f", "HILL01", "Hill & Co <top>", -36.1858, 147.9753, 929.0, 400.0), ("f", "LAND", "Landing", 46.5, -7.25, 12.0, 400.0)]
    df = spark.createDataFrame(points, "file string, code string, name string, lat double, lon double, alt double, radius double")
    waypoints.write_waypoints(df, f"{tmp_path}/out", kind)
    back = {r["code"]: r for r in waypoints.read_waypoints(spark, f"{tmp_path}/out/*.txt").collect()}
    assert set(back) == {"HILL01", "LAND"}
    for _, code, name, lat, lon, alt, _ in points:
        assert (back[code]["lat"], back[code]["lon"], back[code]["alt"]) == pytest.approx((lat, lon, alt), abs=0.02)
        assert back[code]["name"] == name


def test_codes_become_unique(spark):
    rows = [("f", c, c, float(i), 0.0, 0.0, 0.0) for i, c in enumerate(["A b", "a_B", "A_b2", "A_b", "x,y"])]
    df = spark.createDataFrame(rows, "file string, code string, name string, lat double, lon double, alt double, radius double")
    codes = [r["code"] for r in waypoints.unique_codes(df).orderBy("lat").collect()]
    assert len({c.lower() for c in codes}) == 5 and codes[0] == "A_b" and codes[2] == "A_b2" and codes[4] == "x_y"


def test_tasks(spark, tmp_path):
    point = lambda n, kind=None: {"type": kind, "radius": 400.0, "waypoint": {"name": n, "lat": 1.0, "lon": 2.0}}
    task = {"taskType": "CLASSIC", "version": 1, "turnpoints": [point("a", "TAKEOFF"), point("b", "SSS"), point("c"), point("d", "ESS"), point("e")], "sss": {"type": "RACE", "direction": "EXIT", "timeGates": ["03:15:00Z", "03:00:00Z"]}, "goal": {"type": "LINE", "deadline": "08:00:00Z"}}
    (tmp_path / "t.json").write_text(json.dumps(task))
    (tmp_path / "bad.json").write_text("{")
    read = tasks.read_tasks(spark, str(tmp_path))
    got = {r["file"].rsplit("/", 1)[1]: r for r in tasks.outline(read).withColumn("gate", tasks.gate_of(F.col("gates"), F.lit(11_000))).collect()}
    t = got["t.json"]
    assert (t["start"], t["end"], t["goal"], t["valid"], t["gates"], t["deadline"], t["gate"]) == (1, 3, 4, True, [10_800, 11_700], 28_800, 10_800)
    assert not got["bad.json"]["valid"]
    assert tasks.turnpoints(read).count() == 5


def climbing_track():
    """Straight for 120 s, circling up for 200 s at 2 m/s, straight and down for 120 s; a fix a second."""
    lat, lon, alt, rows = -36.2, 147.9, 1000.0, []
    north, east = 1 / 110_900, 1 / 89_900
    for t in range(440):
        if 120 <= t < 320:
            angle = math.radians((t - 120) * 18)
            rows.append((1, t, float(t), lat + 60 * math.sin(angle) * north, lon + 60 * (1 - math.cos(angle)) * east, alt := alt + 2))
        else:
            lat += 10 * north
            rows.append((1, t, float(t), lat, lon, alt := alt - 1))
    return rows


def test_detectors(spark):
    tracks = spark.createDataFrame(climbing_track(), "track int, fix_index long, t double, lat double, lon double, alt double")
    climbs = detectors.climbs(tracks, ["track"])
    found = climbs.collect()
    assert len(found) == 1 and found[0]["start_t"] == pytest.approx(118, abs=8) and found[0]["end_t"] == pytest.approx(320, abs=8) and found[0]["rate"] == pytest.approx(2, abs=0.2)
    glides = detectors.glides(tracks, climbs, ["track"]).orderBy("first").collect()
    assert len(glides) == 2 and glides[0]["ratio"] == pytest.approx(10, abs=1) and not glides[0]["sinks"]
    circling = detectors.circling(tracks, ["track"]).collect()
    assert sum(r["circle"] == 0 for r in circling) == 1 and sum(r["circle"] > 0 for r in circling) >= 8
    ends = detectors.takeoff_and_landing(tracks, ["track"]).first()
    assert ends["takeoff"] == 1 and ends["landing"] == 438
    segment = next(r for r in circling if r["circle"] == 0)
    # the turn of 18 degrees a second ends at 320 s, straight flight for 15 s more ends the segment
    assert segment["first"] == pytest.approx(122, abs=3) and segment["last"] == pytest.approx(340, abs=3) and segment["turn_rate"] == pytest.approx(18, abs=2)
    assert all(r["seconds"] == pytest.approx(20, abs=1.5) and abs(r["turn_rate"]) == pytest.approx(18, abs=1) for r in circling if r["circle"] > 0 and r["first"] > 125 and r["last"] < 318)


def test_inverse_near_the_antipode():
    """Where the iteration does not settle, within a thousandth of half a meridian (20,003,931 m) and of the known geodesic."""
    from thermion.functions.geo import inverse

    metres, _ = inverse([0.0, 0.0, 0.0, -36.2], [0.0, 0.0, 0.0, 147.9], [0.5, 0.0, 0.0, 36.2], [179.7, 180.0, 1.0, -32.1])
    assert metres[0] == pytest.approx(19_936_289, rel=2e-3) and metres[1] == pytest.approx(20_003_931, rel=2e-3) and metres[3] == pytest.approx(20_003_931, rel=2e-3)
    assert metres[2] == pytest.approx(111_319.491, abs=0.01)


def test_a_spike_of_the_clock_costs_one_fix(spark):
    lines = ["HFDTE010124", *(f"B{t}3612000S14754000EA0100001050" for t in ("100000", "100001", "113000", "100002", "100003", "095900", "100004"))]
    source = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "track_file string, line_no int, line string")
    got = [r["time_ms"] // 1000 % 86400 - 36000 for r in igc.fixes(source).orderBy("fix_index").collect()]
    assert got == [0, 1, 2, 3, 4]


def test_takeoff_and_landing(spark):
    """On the ground with a jump of the receiver, off by running, low circles at the end that are no landing, and down."""
    north, rows, lat, alt = 1 / 110_900, [], -36.2, 500.0
    for t in range(400):
        if 100 <= t < 300:
            lat += 8 * north
            alt += 0.5
        rows.append((1, t, float(t), lat + (40 * north if t == 50 else 0) + (math.sin(t) * 4 * north if 300 <= t < 340 else 0), 147.9, alt if t != 20 else alt + 8))
    rows += [(2, t, float(t), -36.2, 147.9, 500.0) for t in range(100)]
    got = {r["track"]: r for r in detectors.takeoff_and_landing(spark.createDataFrame(rows, "track int, fix_index long, t double, lat double, lon double, alt double"), ["track"]).collect()}
    assert got[1]["takeoff"] == 100 and got[1]["landing"] == pytest.approx(340 + 29, abs=3)
    assert got[2]["takeoff"] is None and got[2]["landing"] is None


def test_climbs_keep_their_distance(spark):
    """Bouts of rising: the second begins within 20 s of the first, so it is entered late; the third is too short."""
    alt, rows = 0.0, []
    for t in range(400):
        alt += 2 if 20 <= t < 80 or 95 <= t < 200 or 300 <= t < 306 else -1
        rows.append((1, t, float(t), 0.0, 0.0, alt))
    found = detectors.climbs(spark.createDataFrame(rows, "track int, fix_index long, t double, lat double, lon double, alt double"), ["track"]).orderBy("climb").collect()
    assert len(found) == 2
    assert found[1]["first"] - found[0]["last"] >= 20 and found[1]["last"] == pytest.approx(204, abs=2) and found[0]["first"] == pytest.approx(15, abs=2)


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 01:00:00", 5.0), (1, "2024-01-01 09:00:00", 2.0), (2, "2024-01-02 12:00:00", 3.0)]
    df = spark.createDataFrame(rows, "pilot int, at string, value double").withColumn("at", F.to_timestamp("at"))
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = live.track_sessions(stream, "pilot", "at").writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.sql("select * from sessions where pilot = 1").collect()
    assert sorted((r["fixes"], r["high"]) for r in got) == [(1, 2.0), (2, 5.0)]
    flights = spark.createDataFrame([("t1", 1, 5.0), ("t2", 2, 6.0)], "task string, pilot int, distance double")
    spark.createDataFrame([("t1",)], "task string").write.parquet(f"{tmp_path}/up")
    touched = spark.readStream.schema("task string").parquet(f"{tmp_path}/up")
    live.rescore(touched, "task", lambda: flights, lambda d: d, f"{tmp_path}/scores", f"{tmp_path}/check").awaitTermination(120)
    assert [r["task"] for r in spark.read.parquet(f"{tmp_path}/scores").collect()] == ["t1"]
