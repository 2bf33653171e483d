"""Metrics, routes, repaired altitudes and the air, on small inputs with known results."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from thermion.functions import air
from thermion.operators import metrics, routes


def test_route_through_cylinders(spark):
    at = lambda km, off=0.0: (-36.0 + km / 110.95, 147.0 + off)
    rows = [("a", 0, *at(0), 400.0), ("a", 1, *at(20), 1000.0), ("a", 2, *at(40), 3000.0), ("b", 0, *at(0), 400.0), ("b", 1, *at(20, 0.2), 2000.0), ("b", 2, *at(0), 1000.0)]
    got = {(r["task"], r["tp"]): r for r in routes.optimised(spark.createDataFrame(rows, "task string, tp int, plat double, plon double, radius double")).collect()}
    assert got["a", 2]["total"] == pytest.approx(37_000, rel=1e-3)  # straight on, to the near edge
    out, back = got["b", 1]["total"], got["b", 2]["leg"]
    assert out == pytest.approx(np.hypot(20_000, 0.2 * 90_160) - 2000, rel=2e-3) and back == pytest.approx(out - 1000, rel=1e-3)


def test_touching_is_shortest():
    rng = np.random.default_rng(3)
    for _ in range(50):
        c, p, q = rng.uniform(-5000, 5000, (3, 2))
        r = rng.uniform(100, 3000)
        x = routes.touching(c[None], np.array([r]), p[None], q[None])[0]
        angle = np.linspace(0, 2 * np.pi, 20_001)
        ring = c + r * np.stack([np.sin(angle), np.cos(angle)], 1)
        best = (np.hypot(*(ring - p).T) + np.hypot(*(ring - q).T)).min()
        assert np.hypot(*(x - c)) == pytest.approx(r) and np.hypot(*(x - p)) + np.hypot(*(x - q)) <= best + 0.01


def test_repaired_altitudes(spark):
    rows = [("x", i, 1000 * i, 900 + i, 950 + i) for i in range(100)] + [("dead", i, 1000 * i, 0, 950 + (500 if i == 7 else 0)) for i in range(50)]
    rows[30] = ("x", 30, 30_000, 930, 0)
    rows[40] = ("x", 40, 40_000, 940, 1990)
    df = spark.createDataFrame(rows, "track string, fix_index int, time_ms long, pressure_alt int, gnss_alt int")
    got = {(r["track"], r["fix_index"]): r["cleaned_alt"] for r in routes.repaired(df, ["track"]).filter("cleaned_alt is not null").collect()}
    # the track with a dead channel loses its spike by the rate of its other one
    assert got == {("x", 30): 980.0, ("x", 40): 990.0, ("dead", 7): 950.0}


def test_air(spark):
    df = spark.createDataFrame([(20.0, 10.0, 850.0), (10.0, 12.0, 1013.25), (None, 1.0, 500.0)], "t double, d double, p double")
    rows = df.select(air.cloud_base(F.col("t"), F.col("d")).alias("base"), air.height_of(F.col("p")).alias("h"), air.pressure_at(air.height_of(F.col("p"))).alias("p"), F.col("p").alias("q")).collect()
    assert [r["base"] for r in rows] == [1250.0, None, None] and rows[0]["h"] == pytest.approx(1457, abs=2) and rows[1]["h"] == 0
    assert all(r[2] == pytest.approx(r["q"]) for r in rows)


def test_metrics(spark):
    starts = spark.createDataFrame([("t", p, 100.0 + p, 100.0, e) for p, e in ((1, 3100.0), (2, 3400.0), (3, None))], "task string, pilot int, start_t double, official_start double, ess_t double")
    climbs = [("t", 1, 7, 200.0, 300.0, 500.0, 700.0), ("t", 2, 7, 250.0, 350.0, 500.0, 600.0), ("t", 3, None, 400.0, 500.0, 100.0, 450.0), ("t", 1, 8, 600.0, 700.0, 500.0, 800.0), ("t", 2, 8, 640.0, 740.0, 500.0, 900.0), ("t", 1, 9, 900.0, 1000.0, 500.0, 600.0), ("t", 2, 9, 960.0, 1060.0, 500.0, 600.0), ("t", 1, 7, 10.0, 20.0, 0.0, 900.0)]
    climbs = spark.createDataFrame(climbs, "task string, pilot int, thermal int, start_t double, end_t double, start_alt double, end_alt double")
    glides = [("t", 1, 1, 300.0 + 100 * i, 360.0 + 100 * i, 600.0 + 60 * i, 60.0) for i in range(6)] + [("t", 2, 1, 400.0, 500.0, 1000.0, 200.0), ("t", 2, 1, 50.0, 60.0, 9000.0, 1.0)]
    glides = spark.createDataFrame(glides, "task string, pilot int, leg int, start_t double, end_t double, metres double, lost double")
    legs = spark.createDataFrame([("t", 1, 1, 1000.0, 30_000.0, 25_000.0), ("t", 2, 1, 1300.0, 26_000.0, 25_000.0)], "task string, pilot int, leg int, seconds double, flown double, optimised double")
    bands = spark.createDataFrame([("t", 0.0, 1000.0)], "task string, lo double, hi double")
    steps = spark.createDataFrame([("t", 1, 150.0, True), ("t", 1, 160.0, False), ("t", 1, 5.0, True)], "task string, pilot int, t double, together boolean")
    rows = metrics.field_metrics(starts, climbs, glides, legs, bands, steps).collect()
    got = {(r["pilot"], r["metric"]): r["value"] for r in rows}
    assert len(got) == len(rows) and {m for _, m in got} == set(metrics.METRICS)
    assert got[1, "race.start_delay"] == 1 and got[2, "race.time_behind"] == 5 and (3, "race.time_behind") not in got
    assert got[2, "race.leg_time_lost"] == 150 and got[1, "race.leg_time_lost"] == 0
    assert got[1, "decision.low_saves"] == 0 and got[3, "decision.low_saves"] == 1
    assert got[2, "glide.speed"] == pytest.approx(36) and got[1, "glide.extra_distance"] == pytest.approx(20)
    assert got[1, "decision.km_between_climbs"] == pytest.approx(10) and got[1, "gaggle.affinity"] == 50
    assert got[2, "gaggle.marker_usage"] == pytest.approx(100) and got[1, "gaggle.marker_usage"] == 0
    assert got[1, "glide.ld_vs_field"] == pytest.approx((4500 / 360) / ((4500 / 360 + 5) / 2))
    points = spark.createDataFrame([("t", p, 100.0 * p) for p in (1, 2, 3)], "task string, pilot int, points double")
    assert {r["metric"] for r in metrics.evaluated(metrics.field_metrics(starts, climbs, glides, legs, bands, steps), points).collect()} == set(metrics.METRICS)
