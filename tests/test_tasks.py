"""Goal lines, leading, stopped tasks and circling against plain versions over random tracks."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from thermion.functions.geo import direct
from thermion.operators import detectors, goal, leading, sequence, stopped

LINES = "task string, tp int, plat double, plon double, radius double, course double"
TRACKS = "task string, pilot long, fix_index long, t double, lat double, lon double"


def metres(lat0, lon0, lat, lon):
    e2 = 0.0066943799901413165
    w = 1 - e2 * math.sin(math.radians(lat0)) ** 2
    k = math.radians(1) * 6378137.0
    return (lon - lon0) * k * math.cos(math.radians(lat0)) / math.sqrt(w), (lat - lat0) * k * (1 - e2) / w**1.5


def walk(rng, n, step):
    lat, lon, out = -36.0, 147.0, []
    for i in range(n):
        lat, lon = lat + rng.uniform(-step, step), lon + rng.uniform(-step, step)
        out.append((i, 10.0 * i, -36 + (lat + 36) * 0.95, 147 + (lon - 147) * 0.95))
        lat, lon = out[-1][2:]
    return out


def test_line_crossings_by_small_steps(spark):
    """Each segment walked in many small steps: where the half-disc is entered and left, and the line passed."""
    rng, radius, course = random.Random(4), 300.0, 0.7
    tracks = [(p, walk(rng, 60, 0.004)) for p in range(40)]
    rows = [("a", p, *x) for p, own in tracks for x in own]
    lines = spark.createDataFrame([("a", 2, -36.0, 147.0, radius, course)], LINES)
    got = {r["pilot"]: r for r in goal.line_crossings(spark.createDataFrame(rows, TRACKS), lines, ["pilot"]).collect()}

    def place(lat, lon):
        e, n = metres(-36.0, 147.0, lat, lon)
        return e * math.sin(course) + n * math.cos(course), e * math.cos(course) - n * math.sin(course)

    inside = lambda y, x: y > 0 and math.hypot(y, x) <= radius + 5
    entered = 0
    for p, own in tracks:
        want = []
        for (_, t0, *a), (i, t, *b) in zip(own, own[1:], strict=False):
            (y0, x0), (y1, x1) = place(*a), place(*b)
            was, now = inside(y0, x0), inside(y1, x1)
            passes = (y0 > 0) != (y1 > 0)
            share = y0 / (y0 - y1) if passes else None
            beside = abs(x0 + share * (x1 - x0)) if passes else None
            if passes and beside <= radius + 5:
                kinds = [now] if was != now else [True, False] if y1 > y0 else []
                want += [(t0 + share * (t - t0), i, k, beside > radius) for k in kinds]
            elif was != now:
                lo, hi = 0.0, 1.0
                for _ in range(60):
                    mid = (lo + hi) / 2
                    lo, hi = (mid, hi) if inside(y0 + mid * (y1 - y0), x0 + mid * (x1 - x0)) == was else (lo, mid)
                want.append((t0 + lo * (t - t0), i, now, True))
        found = [tuple(c) for c in got[p]["found"]]
        assert [c[1:] for c in found] == [c[1:] for c in want]
        assert [c[0] for c in found] == pytest.approx([c[0] for c in want], abs=1e-6)
        entered += len(want)
    assert entered > 30


def points_and_goal(spark):
    lat = lambda km: -36.0 + km / 110.95
    points = spark.createDataFrame([("a", 0, "exit", lat(0), 147.0, 2000.0), ("a", 1, "enter", lat(10), 147.0, 1000.0), ("a", 2, "enter", lat(20), 147.0, 400.0)], "task string, tp int, way string, plat double, plon double, radius double")
    return lat, points, spark.createDataFrame([("a", 2)], "task string, goal int")


def test_goal_line_from_the_route(spark):
    _, points, goals = points_and_goal(spark)
    line = goal.goal_lines(points, goals).collect()
    assert [(r["tp"], r["radius"]) for r in line] == [(2, 400.0)] and line[0]["course"] == pytest.approx(0.0, abs=1e-6)
    # turnpoints about the goal's own centre give no course: the task keeps its cylinder
    same = points.withColumns({"plat": F.lit(-36.0), "radius": F.when(F.col("tp") == 2, 400.0).otherwise(0.0)})
    assert goal.goal_lines(same, goals).count() == 0


def test_paths_end_at_the_line(spark):
    lat, points, goals = points_and_goal(spark)
    lines = goal.goal_lines(points, goals)
    track = lambda p, ways: [("a", p, i, 60.0 * i, lat(k), 147.0 + e / 89.9) for i, (k, e) in enumerate(ways)]
    straight, beside = [(k, 0.0) for k in range(0, 22)], [(k, 0.6 if k > 15 else 0.0) for k in range(0, 22)]
    short = [(k, 0.0) for k in range(0, 20)] + [(19.7, 0.0)]  # in the cylinder, before the line
    rows = track(1, straight) + track(2, beside) + track(3, short)
    rules = spark.createDataFrame([("a", 0, 2, 2, "exit", None, None, None, False)], "task string, start int, ess int, goal int, start_way string, opens double, closes double, gates array<double>, fallback boolean")
    tracks = spark.createDataFrame(rows, TRACKS)
    got = {r["pilot"]: r["made_goal"] for r in sequence.resolved(tracks, points, rules, ["pilot"], lines).collect()}
    assert got == {1: True, 2: False, 3: False}
    round_goal = {r["pilot"]: r["made_goal"] for r in sequence.resolved(tracks, points, rules, ["pilot"]).collect()}
    assert round_goal == {1: True, 2: False, 3: True}


def test_metres_to_a_line(spark):
    line = ("a", 2, -36.0, 147.0, 300.0, 0.0)
    ends = [direct(-36.0, 147.0, a, 300.0) for a in (90, 270)]
    off = [direct(float(ends[0][0]), float(ends[0][1]), 90, 500.0), direct(-36.0, 147.0, 180, 2000.0), direct(-36.0, 147.0, 0, 70.0)]
    df = spark.createDataFrame([(*line, float(la), float(lo)) for la, lo in off], LINES + ", la double, lo double")
    assert [r[0] for r in df.select(goal.line_metres("la", "lo")).collect()] == pytest.approx([500.0, 2000.0, 70.0], abs=0.05)


def integral(p: float, steps: int = 20_000) -> float:
    h = p / steps
    f = lambda q: (1 - 10 ** (9 * q - 9)) ** 5 * (1 - 10 ** (-3 * q)) ** 2
    return sum(f((i + 0.5) * h) for i in range(steps)) * h


@pytest.mark.parametrize("scoring", ["HG", "PG"])
def test_leading_against_a_plain_scan(spark, scoring):
    rng, section = random.Random(8), 60.0
    rows, flights = [], []
    for p in range(12):
        start, left = 100.0 + 30 * p, section
        own = []
        for i in range(40):
            left = max(0.0, left + rng.uniform(-4, 1.5))
            own.append((start + 20.0 * i - 40, left))
        ess = next((t for t, x in own if x <= 10 and t >= start), None) if p % 3 else None
        flights.append((1, p, section, start, ess, 150.0 if p % 2 else None))
        rows += [(1, p, t, x) for t, x in own]
    flights.append((1, 99, section, 1e9, None, None))  # no fix after its start
    rows.append((1, 99, 5.0, 3.0))
    parts = leading.contributions(spark.createDataFrame(rows, "task int, pilot long, t double, left_km double"), spark.createDataFrame(flights, "task int, pilot long, section_km double, start_t double, ess_t double, gate double"), ["task", "pilot"])
    rules = spark.createDataFrame([(1, 850.0, None)], "task int, deadline double, stop double")
    got = {r["pilot"]: r["leading"] for r in leading.coefficients(parts, rules, ["task"], scoring).collect()}
    tracks = defaultdict(list)
    for _, p, t, x in rows:
        tracks[p].append((t, x))
    known = [f for f in flights if f[1] != 99]
    first = min(f[5] for f in known if f[5])
    done = max([max(t for t, _ in tracks[f[1]]) for f in known if f[4] is None] + [f[4] for f in known if f[4] is not None])
    until, want = min(done, 850.0), {}
    for _, p, _, start, ess, gate in known:
        best, before, area = section, None, 0.0
        for t, x in tracks[p]:
            if t < start or (ess is not None and t > ess):
                continue
            if before is not None and before < best:
                if scoring == "HG":
                    area += (t - start) * (best**2 - before**2)
                else:
                    area += before * (max(t, gate or t) - first) * (integral(best / section) - integral(before / section))
                best = before
            before = x
        best = min(best, before)
        if scoring == "HG":
            area += max(start - first, 0) * section**2 + (best**2 * max(until - start, 0) if ess is None else 0)
            want[p] = area / (1800 * section**2)
        else:
            area += best * (until - first) * integral(best / section) if ess is None else 0
            want[p] = area / (1800 * section)
    assert got == pytest.approx(want, rel=1e-6)


def test_windows_of_a_stopped_task(spark):
    starts = spark.createDataFrame([(1, 1, 100.0), (1, 2, 400.0), (1, 3, None), (2, 1, 100.0), (2, 2, 300.0), (3, 1, None)], "task int, pilot long, start_t double")
    rules = spark.createDataFrame([(1, 1900.0, None, 0.0), (2, 1900.0, [50.0], 0.0), (3, 1900.0, [50.0, 90.0], 0.0)], "task int, announced double, gates array<double>, goal_alt double")
    got = {(r["task"], r["pilot"]): (r["window_t"], r["window_end"]) for r in stopped.windows(starts, rules, "HG").collect()}
    assert got == {(1, 1): (400.0, 700.0), (1, 2): (400.0, 1000.0), (1, 3): (400.0, 1000.0), (2, 1): (50.0, 1000.0), (2, 2): (50.0, 1000.0), (3, 1): (None, 1000.0)}
    assert stopped.least_run(5400, "HG") == 2700 and stopped.least_run(9000, "HG") == 3600 and stopped.least_run(9000, "PG") == 0


def test_glide_from_the_stop_only(spark):
    fixes = spark.createDataFrame([(1, 1, 0.0, 9000.0, 4000.0), (1, 1, 10.0, 8000.0, 500.0), (1, 1, 20.0, 8500.0, 900.0), (1, 1, 30.0, 1.0, 0.0), (1, 2, 0.0, 700.0, 900.0), (1, 2, 5.0, 800.0, 900.0)], "task int, pilot long, t double, left double, alt double")
    windowed = spark.createDataFrame([(1, 1, 0.0, 25.0, 100.0), (1, 2, 0.0, 25.0, 100.0)], "task int, pilot long, start_t double, window_end double, goal_alt double")
    cut = stopped.cut(fixes, windowed, ["task", "pilot"])
    got = {r["pilot"]: (r["flying"], r["left"], r["bonus"], r["best_t"]) for r in stopped.glided(cut, ["task", "pilot"], "HG", "start_t").collect()}
    assert got == {1: (True, 4500.0, 4000.0, 20.0), 2: (False, 700.0, 0.0, 0.0)}


def turns(own: list[tuple]) -> list[tuple]:
    """(first, last, mean rate) of a track's segments of circling, fix by fix."""
    heading = [None]
    for (_, a, b), (_, c, d) in zip(own, own[1:], strict=False):
        p1, p2, dl = math.radians(a), math.radians(c), math.radians(d - b)
        heading.append(math.degrees(math.atan2(math.sin(dl) * math.cos(p2), math.cos(p1) * math.sin(p2) - math.sin(p1) * math.cos(p2) * math.cos(dl))))
    rates = []
    for i, (t, *_) in enumerate(own):
        j = max((j for j in range(i) if own[j][0] <= t - 5), default=0)
        turned = (heading[i] - heading[j] + 180) % 360 - 180 if j else 0.0
        rates.append(max(-50.0, min(50.0, turned / (t - own[j][0]))) if j else 0.0)
    out, first, since, held, straight = [], None, None, [], None
    for i, (t, *_) in enumerate(own):
        if abs(rates[i]) >= 4:
            straight = None
            if since is None and first is None:
                since, begun, held = t, i, []
            held.append(rates[i])
            if first is None and t - since >= 8:
                first = begun
        elif first is None:
            since = None
        elif straight is None:
            straight = t
        elif t - straight >= 15:
            out.append((first, i, sum(held) / len(held)))
            first = since = straight = None
    if first is not None:
        out.append((first, len(own) - 1, sum(held) / len(held)))
    return [x for x in out if own[x[1]][0] > own[x[0]][0]]


def test_circling_over_random_tracks(spark):
    rng, rows, tracks = random.Random(6), [], {}
    for p in range(120):
        lat, lon, way, t, own = -36.0, 147.0, rng.uniform(0, 360), 0.0, []
        turn = 0.0
        for _ in range(rng.randint(20, 120)):
            if rng.random() < 0.06:
                turn = rng.choice([0.0, 0.0, 12.0, -15.0, 5.0])
            dt = rng.choice([1.0, 1.0, 2.0, 4.0, 0.0])
            t, way = t + dt, way + turn * dt
            lat, lon = lat + 1e-4 * math.cos(math.radians(way)) * max(dt, 0.3), lon + 1e-4 * math.sin(math.radians(way)) * max(dt, 0.3)
            own.append((t, lat, lon))
        tracks[p] = own
        rows += [(p, i, *x, 0.0) for i, x in enumerate(own)]
    df = spark.createDataFrame(rows, "pilot long, fix_index long, t double, lat double, lon double, alt double")
    got = defaultdict(list)
    for r in detectors.circling(df, ["pilot"]).filter("circle = 0").orderBy("segment").collect():
        got[r["pilot"]].append((r["first"], r["last"], r["turn_rate"]))
    many = 0
    for p, own in tracks.items():
        want = turns(own)
        assert [x[:2] for x in got[p]] == [x[:2] for x in want], p
        assert [x[2] for x in got[p]] == pytest.approx([x[2] for x in want])
        many += len(want)
    assert many > 60


def test_short_tracks_neither_take_off_nor_land(spark):
    rows = [(1, i, 5.0 * i, -36.0 + 0.001 * i, 147.0, 100.0 + 40 * i) for i in range(9)] + [(2, i, 5.0 * i, -36.0 + 0.001 * i, 147.0, 100.0 + 40 * i) for i in range(12)]
    df = spark.createDataFrame(rows, "pilot long, fix_index long, t double, lat double, lon double, alt double")
    got = {r["pilot"]: (r["takeoff"], r["landing"]) for r in detectors.takeoff_and_landing(df, ["pilot"]).collect()}
    assert got[1] == (None, None) and got[2][0] is not None
