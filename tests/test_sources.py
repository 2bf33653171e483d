"""Logs that run backwards, event and declaration records, compact tasks, the grid, the sun, grid and degree files."""

from __future__ import annotations

import base64
import json
import math
import random
import zlib
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F
from thermion.functions import projections, sun
from thermion.sources import igc, tasks, waypoints


def log(seconds, head="HFDTE050126"):
    clock = lambda s: f"{s // 3600:02d}{s // 60 % 60:02d}{s % 60:02d}"
    return "\n".join([head, *(f"B{clock(s)}3611150S14758521EA0000000929" for s in seconds)])


def test_times_never_run_backwards(spark, tmp_path):
    rng, want = random.Random(1), {}
    for f in range(40):
        t, seconds = 36_000, []
        for _ in range(rng.randint(2, 50)):
            t += rng.choice([1, 5, 5, 5, 0])
            seconds.append(t + rng.choice([0] * 6 + [400, -300, -9, 60, 7]))
        (tmp_path / f"{f}.igc").write_text(log(seconds))
        kept = []
        for s in seconds:  # a fix before the last goes, or the last one does, where it alone is out of order
            if not kept or s >= kept[-1]:
                kept.append(s)
            elif len(kept) < 2 or s >= kept[-2]:
                kept[-1] = s
        want[f] = kept
    rows = igc.fixes(igc.lines(spark, str(tmp_path))).orderBy("track_file", "fix_index").collect()
    got: dict = {}
    for r in rows:
        got.setdefault(int(r["track_file"].rsplit("/", 1)[1][:-4]), []).append(r["time_ms"] // 1000 % 86_400)
    assert got == want


DECLARED = """HFDTE050126
C050126100000050126000102 Task
C3611150S14758521EHILL
C3612000S14759000E00010009999999000000360000STARTAREA Start_one
C3613000S14800000E00000000002000000000360000TURNAREA TP_2
C3614000S14801000ELANDING B
C3615000S14802000EHOME
E101500PEVmarked it
E256100PEVno time
Enothing"""


def test_declarations_and_events(spark, tmp_path):
    (tmp_path / "a.igc").write_text(DECLARED)
    source = igc.lines(spark, str(tmp_path))
    points = igc.declared(source)
    got = points.first()["points"]
    assert [p["role"] for p in got] == ["takeoff", "start", "turnpoint", "finish", "landing"] and [p["name"] for p in got] == ["HILL", "Start one", "TP 2", "LANDING B", "HOME"]
    assert tuple(got[1]["area"]) == (1000.0, None, 0.0, 360.0, "STARTAREA") and got[2]["area"]["outer"] == 2000.0 and got[0]["area"] is None
    assert [tuple(r)[2:] for r in igc.events(source).collect()] == [(36_900, "PEV", "marked it")]
    near = spark.createDataFrame([("f", "X9", "Paddock", -36 - 14.0005 / 60, 148 + 1 / 60, 310.0, 600.0), ("f", "tp 2", "Tower", 0.0, 0.0, 99.0, None), ("f", "far", "far", -36.3, 148.0, 0.0, 1.0)], "file string, code string, name string, lat double, lon double, alt double, radius double")
    made = tasks.from_declared(points, near).select("task").first()["task"]
    assert [(t["type"], t["radius"], t["waypoint"]["name"], t["waypoint"]["altSmoothed"]) for t in made["turnpoints"]] == [("SSS", 1000.0, "Start one", None), (None, 2000.0, "Tower", 99.0), (None, 600.0, "Paddock", 310.0)]
    assert made["sss"]["direction"] == "EXIT" and made["goal"]["type"] == "CYLINDER"
    alone = tasks.from_declared(points).first()["task"]["turnpoints"]
    assert [t["radius"] for t in alone] == [1000.0, 2000.0, 400.0]


def test_delta_strings(spark):
    # the example that the format's description gives
    rows = spark.createDataFrame([([3850000, -12020000, 220000, -75000, 255200, -550300],), ([0, -1, 15, 16, -16, 17_999_999, -18_000_000],), ([],)], "v array<long>")
    got = rows.select(tasks.encoded(F.col("v")).alias("z"), "v").select("z", "v", tasks.decoded(F.col("z")).alias("back")).collect()
    assert got[0]["z"] == "_p~iF~ps|U_ulLnnqC_mqNvxq`@"
    assert all(r["back"] == r["v"] for r in got)


COMPACT = {"taskType": "CLASSIC", "version": 2, "t": [{"z": "", "n": "A", "t": 2, "lat": -36.5, "lon": 147.25, "r": 5000}, {"z": "", "n": "", "y": "E", "lat": 1.0, "lon": 2.0}], "s": {"t": 1, "d": 1, "g": ["10:00:00Z"]}, "g": {"t": 1, "d": "17:00:00Z"}, "to": "08:00:00Z"}


def test_tasks_in_every_dress(spark, tmp_path):
    whole = {"taskType": "CLASSIC", "version": 1, "earthModel": "WGS84", "turnpoints": [{"type": "TAKEOFF", "radius": 400.0, "waypoint": {"name": "Hill", "lat": -36.18577, "lon": 147.97531, "altSmoothed": 929.0}}, {"type": "SSS", "radius": 5000.0, "waypoint": {"name": "Hill", "lat": -36.18577, "lon": 147.97531}}, {"radius": 1234.0, "waypoint": {"name": "Goal", "lat": 46.5, "lon": -7.25, "altSmoothed": -3.0}}], "sss": {"type": "RACE", "direction": "EXIT", "timeGates": ["01:00:00Z"]}, "goal": {"type": "LINE", "deadline": "08:00:00Z"}}
    df = spark.createDataFrame([(json.dumps(whole),)], "v string").select(tasks.parsed(F.col("v")).alias("task")).select("task", tasks.compacted(F.col("task")).alias("short"))
    short = df.first()["short"]
    texts = {"bare": short, "qr": "XCTSK:" + short, "packed": "XCTSKZ:" + base64.b64encode(zlib.compress(short.encode())).decode(), "broken": "XCTSKZ:@@", "none": "what", "letters": json.dumps(COMPACT)}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    got = {r["file"].rsplit("/", 1)[1]: r["task"] for r in tasks.read_tasks(spark, str(tmp_path)).collect()}
    assert got["bare"] == got["qr"] == got["packed"] and got["broken"] is None and (got["none"] is None or got["none"]["turnpoints"] is None)
    for a, b in zip(whole["turnpoints"], got["bare"]["turnpoints"], strict=True):
        w = a["waypoint"]
        assert (b["type"], b["radius"], b["waypoint"]["name"], b["waypoint"]["altSmoothed"]) == (a.get("type"), a["radius"], w["name"], w.get("altSmoothed"))
        assert (b["waypoint"]["lat"], b["waypoint"]["lon"]) == pytest.approx((w["lat"], w["lon"]), abs=1e-9)
    assert got["bare"]["goal"]["type"] == "LINE" and got["bare"]["sss"]["timeGates"] == ["01:00:00Z"] and got["bare"]["sss"]["direction"] == "EXIT"
    own = got["letters"]
    assert [(t["type"], t["radius"], t["waypoint"]["name"], t["waypoint"]["lat"]) for t in own["turnpoints"]] == [("SSS", 5000.0, "A", -36.5), ("ESS", 400.0, "Unnamed", 1.0)]
    assert (own["sss"]["direction"], own["goal"]["type"], own["takeoff"]["timeOpen"], own["version"]) == ("ENTER", "LINE", "08:00:00Z", 2)


def test_grid_there_and_back(spark):
    rng = random.Random(5)
    places = [(rng.uniform(-79.9, 83.9), rng.uniform(-180, 179.9)) for _ in range(500)] + [(0.0, 0.0), (0.0, -180.0), (83.99, 179.99), (-0.0001, 3.0)]
    df = spark.createDataFrame(places, "lat double, lon double")
    grid = df.select("lat", "lon", *[c.alias(n) for n, c in projections.to_grid(F.col("lat"), F.col("lon")).items()])
    place = projections.from_grid(F.col("zone"), F.col("lat") >= 0, F.col("easting"), F.col("northing"))
    for r in grid.withColumn("place", place).select("*", F.col("place.lat").alias("lat2"), F.col("place.lon").alias("lon2")).collect():
        assert abs(r["lat2"] - r["lat"]) * 111_000 < 0.001 and abs(r["lon2"] - r["lon"]) * 111_000 * math.cos(math.radians(r["lat"])) < 0.001
        assert 1 <= r["zone"] <= 60 and r["band"] in projections.BANDS
    # published: the middle meridian's scale at the equator, and a known tower
    known = spark.createDataFrame([(43.642567, -79.387139), (0.0, 9.0)], "lat double, lon double").select(*[c.alias(n) for n, c in projections.to_grid(F.col("lat"), F.col("lon")).items()]).collect()
    assert (known[0]["zone"], known[0]["band"]) == (17, "T") and known[0]["easting"] == pytest.approx(630_084, abs=1) and known[0]["northing"] == pytest.approx(4_833_438, abs=1)
    assert (known[1]["easting"], known[1]["northing"]) == pytest.approx((500_000, 0))


def test_degree_and_grid_files_name_the_same_places(spark, tmp_path):
    geo = "$FormatGEO\nA01       N 46 18 31.78    E 013 06 45.00   225  BORDANO LANDING [A]\n# no\nbad line\n"
    utm = "$FormatUTM\nA01       33T   0354663   5130093   225  BORDANO LANDING [A]\nB 2  55H 500000 6000000\n"
    (tmp_path / "a.wpt").write_text(geo)
    (tmp_path / "b.wpt").write_text(utm)
    got = {(r["file"].rsplit("/", 1)[1], r["code"]): r for r in waypoints.read_waypoints(spark, str(tmp_path)).collect()}
    assert set(got) == {("a.wpt", "A01"), ("b.wpt", "A01"), ("b.wpt", "B 2")}
    a, b = got["a.wpt", "A01"], got["b.wpt", "A01"]
    assert (a["lat"], a["lon"]) == pytest.approx((b["lat"], b["lon"]), abs=1e-5) and (a["name"], a["alt"]) == (b["name"], b["alt"]) == ("BORDANO LANDING [A]", 225.0)
    assert got["b.wpt", "B 2"]["lat"] < 0 and got["b.wpt", "B 2"]["name"] == "B 2"


def test_the_sun(spark):
    at = lambda *x: int(datetime(*x, tzinfo=UTC).timestamp())
    rows = [(51.48, 0.0, at(2024, 6, 20), at(2024, 6, 20, 3, 43), at(2024, 6, 20, 20, 21)), (-36.55, 147.9, at(2024, 1, 15), at(2024, 1, 14, 19, 10), at(2024, 1, 15, 9, 28)), (69.65, 18.96, at(2024, 6, 20), None, None), (69.65, 18.96, at(2024, 12, 21), None, None)]
    df = spark.createDataFrame(rows, "lat double, lon double, day long, rise long, set long").withColumn("sun", sun.sun_times(F.col("lat"), F.col("lon"), F.col("day")))
    for r in df.collect():
        if r["rise"] is None:
            assert r["sun"] is None
        else:
            assert abs(r["sun"]["rise"] - r["rise"]) < 400 and abs(r["sun"]["set"] - r["set"]) < 400
    span = df.limit(1).select(sun.daylight(F.lit(-36.55), F.lit(147.9), F.lit(at(2024, 1, 15)), F.lit(at(2024, 1, 16))).alias("s"), sun.daylight(F.lit(69.65), F.lit(18.96), F.lit(at(2024, 12, 21)), F.lit(at(2024, 12, 22))).alias("none")).first()
    assert span["none"] is None and abs(span["s"]["set"] - at(2024, 1, 15, 9, 28)) < 400  # the one day's light, not the next morning's
