"""Best progress against every fix tried, and a field scored from its tracks."""

from __future__ import annotations

import random

import numpy as np
import pytest
from thermion.operators import progress, routes, sequence
from thermion.plans import scoring

KM = 1 / 110.95
TRACKS = "task string, pilot long, fix_index long, t double, lat double, lon double"
POINTS = "task string, tp int, way string, plat double, plon double, radius double"
RULES = "task string, start int, ess int, goal int, start_way string, opens double, closes double, gates array<double>, fallback boolean"


def test_nearest_is_the_best_of_all_fixes():
    rng = np.random.default_rng(5)
    few = 0
    for k in range(60):
        n = int(rng.integers(1, 5))
        centres, radii = rng.uniform(-30_000, 30_000, (n, 2)), rng.uniform(200, 5000, n)
        fixes = np.cumsum(rng.normal(0, 300, (200, 2)), axis=0) + rng.uniform(-20_000, 20_000, 2)
        i, way, tried = progress.nearest(fixes, centres, radii, bool(k % 2))
        every = routes.route(np.concatenate([fixes[:, None], np.broadcast_to(centres, (200, n, 2))], axis=1), np.broadcast_to(np.r_[0.0, radii], (200, n + 1)))
        length = np.hypot(*np.diff(every, axis=1).transpose(2, 0, 1)).sum(1)
        assert np.hypot(*np.diff(way, axis=0).T).sum() <= length.min() + progress.CLOSE + 0.2 and np.allclose(way[0], fixes[i])
        few += tried
    assert few < 60 * 100  # bounds leave most fixes untried


@pytest.fixture(scope="module")
def field(spark):
    """A course north: out of 2 km, to 20 km, back to 10 km; five pilots, who get on at different speeds and places."""
    rng, rows = random.Random(2), []
    plans = {1: (40, 100.0), 2: (40, 80.0), 3: (18, 100.0), 4: (40, 90.0), 5: (1, 0.0)}  # turns back at km 20 or lands at the first figure
    for p, (far, speed) in plans.items():
        for i in range(700):
            s = 10.0 * i
            along = min(speed * s / 10_000, 30.0) if p != 5 else 0.5  # km flown
            km = along if along <= 20 else 40 - along
            if far < along:
                break
            rows.append(("a", p, i, s + (50.0 if p == 4 else 0.0), -36.0 + km * KM, 147.0 + rng.uniform(-1, 1) * 1e-5))
    points = [("a", 0, "exit", -36.0, 147.0, 2000.0), ("a", 1, "enter", -36.0 + 20 * KM, 147.0, 1000.0), ("a", 2, "enter", -36.0 + 10 * KM, 147.0, 1000.0)]
    rules = [("a", 0, 2, 2, "exit", None, 1e6, [150.0], False)]
    return spark.createDataFrame(rows, TRACKS), spark.createDataFrame(points, POINTS), spark.createDataFrame(rules, RULES)


def test_progress_of_those_who_land_out(spark, field):
    tracks, points, rules = field
    paths = sequence.resolved(tracks, points, rules, ["pilot"])
    got = {r["pilot"]: r for r in progress.best_progress(tracks, paths, points, rules, ["pilot"]).collect()}
    assert set(got) == {3}
    # 18 km out: 1 km to the first edge, and 8 km on to the next
    assert got[3]["remaining"] == pytest.approx(1000 + 8000, rel=0.01) and got[3]["tried"] < 200


@pytest.mark.parametrize("kind", ["PG", "HG"])
def test_a_field_from_tracks_to_points(spark, field, kind):
    tracks, points, rules = field
    scored = scoring.score_task(tracks, points, rules, "pilot", {"scoring": kind, "leading": True, "nominal_distance": 15_000.0, "minimum_distance": 1000.0, "nominal_time": 900.0})
    got = {r["pilot"]: r for r in scored.collect()}
    assert set(got) == {1, 2, 3, 4, 5} and got[5]["rank"] == 5 and got[5]["distance"] == 1000.0
    assert got[1]["distance"] == got[2]["distance"] == got[4]["distance"] == pytest.approx(27_000, rel=0.01)
    assert got[3]["distance"] == pytest.approx(18_000, rel=0.02)
    assert got[1]["best_time"] == pytest.approx(2900 - 150, abs=60)  # 20 km out and 9 back at 10 m a second, from the gate
    order = sorted((1, 2, 3, 4), key=lambda p: got[p]["rank"])
    assert order[-1] == 3 and order[0] in (1, 4)
    assert got[1]["leading_points"] > got[2]["leading_points"] > got[5]["leading_points"] == 0.0
    assert all(got[p]["time_points"] > 0 for p in (1, 2, 4)) and got[3]["time_points"] == 0
    assert got[1]["total"] > got[2]["total"] > got[3]["total"] > got[5]["total"]
