"""Phases, circles, altitude excursions and thermals against plain versions."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest
from thermion.functions.geo import direct
from thermion.operators import circles, phases, routes, thermals

TRACKS = "pilot long, fix_index long, t double, lat double, lon double"


def parts_of(times, places, climbs, rings, a, b):
    """(kind, first, last) of a flight along a meridian, fix by fix."""
    cut = [(max(f, a), min(x, b)) for f, x in climbs]
    cut = sorted(c for c in cut if c[1] > c[0])
    out, at = [], a
    for f, x in [*cut, (b, None)]:
        while at < f:
            to = next((i for i in range(at + 1, f) if times[i] >= times[at] + 60), f)
            speed = abs(places[to] - places[at]) * 110574.2755 / (times[to] - times[at]) if times[to] > times[at] else 0.0
            quick = speed >= 8 and not any(r < to and s > at for r, s in rings)
            out.append(["glide" if quick else "search", at, to])
            at = to
        if x is not None:
            out.append(["climb", f, x])
            at = x
    merged = []
    for p in out:
        if merged and merged[-1][0] == p[0]:
            merged[-1][2] = p[2]
        else:
            merged.append(p)
    return [tuple(p) for p in merged]


def test_phases_cover_the_flight(spark):
    rng, rows, climbs, rings, flights, want = random.Random(5), [], [], [], [], {}
    for p in range(30):
        n, t, lat, times, places = rng.randint(40, 200), 0.0, 0.0, [], []
        for _ in range(n):
            t += rng.choice([1.0, 5.0, 9.0, 70.0, 0.0])
            lat += rng.choice([0.0, 1e-5, 4e-4, -2e-4])
            times.append(t), places.append(lat)
        own, at = [], 0
        while at < n - 12 and rng.random() < 0.8:
            f = at + rng.randint(0, 20)
            x = f + rng.randint(1, 12)
            if x < n:
                own.append((f, x))
            at = x
        circling = [(i, i + 4) for i in range(0, n - 5, 37)]
        a, b = rng.randint(0, 5), n - 1 - rng.randint(0, 5)
        rows += [(p, i, times[i], places[i], 0.0) for i in range(n)]
        climbs += [(p, *c) for c in own]
        rings += [(p, *c) for c in circling]
        flights.append((p, a, b))
        want[p] = parts_of(times, places, own, circling, a, b)
    flights.append((99, None, None))
    spans = "pilot long, first long, last long"
    got = defaultdict(list)
    found = phases.phases(spark.createDataFrame(rows, TRACKS), spark.createDataFrame(climbs, spans), spark.createDataFrame(rings, spans), spark.createDataFrame(flights, "pilot long, takeoff long, landing long"), ["pilot"])
    for r in found.orderBy("pilot", "first", "last").collect():
        got[r["pilot"]].append((r["phase"], r["first"], r["last"]))
    assert dict(got) == want
    for p, own in got.items():
        assert all(x[2] == y[1] for x, y in zip(own, own[1:], strict=False)) and (p, own[0][1], own[-1][2]) in flights


def drifting(wind, n=24, turns=3, radius=80.0):
    """Fixes of turns flown at even speed in air that drifts north, 1 a second."""
    out = []
    for i in range(n * turns + 1):
        angle = 360.0 * i / n
        lat, lon = direct(46.0, 8.0, angle, radius)
        lat, lon = direct(float(lat), float(lon), 0.0, wind * i)
        out.append((1, i, float(i), float(lat), float(lon)))
    return spark_rows(out)


def spark_rows(rows):
    return [(*map(int, r[:2]), *map(float, r[2:])) for r in rows]


def test_circles_and_their_wind(spark):
    tracks = spark.createDataFrame(drifting(0.0), TRACKS)
    turns = spark.createDataFrame([(1, 0, k, 24 * k, 24 * k + 23) for k in range(3)] + [(1, 1, 9, 5, 6)], "pilot long, segment int, circle int, first long, last long")
    still = circles.fits(tracks, turns, ["pilot"]).collect()
    assert sorted(r["circle"] for r in still) == [0, 1, 2]  # two fixes settle no circle
    for r in still:
        assert r["radius"] == pytest.approx(80, rel=0.005) and r["rms"] < 0.5 and r["centre_lat"] == pytest.approx(46, abs=1e-5)
    blown = spark.createDataFrame(drifting(4.0), TRACKS)
    fitted = circles.fits(blown, turns.filter("segment = 0"), ["pilot"])
    drift = circles.drift_winds(fitted, blown, ["pilot"]).collect()
    assert [r["circle"] for r in sorted(drift)] == [1, 2] and all(r["speed"] == pytest.approx(4, rel=0.02) and r["direction"] == pytest.approx(180, abs=1) for r in drift)
    ground = circles.ground_winds(blown, turns.filter("segment = 0"), ["pilot"]).collect()
    assert len(ground) == 3 and all(r["speed"] == pytest.approx(4, rel=0.05) and abs(r["direction"] - 180) < 10 for r in ground)
    assert circles.ground_winds(tracks, turns, ["pilot"]).count() == 0  # even speeds tell no wind


def test_excursions_return_or_stay(spark):
    rng, rows, want = random.Random(9), [], {}
    for p in range(60):
        t, z, own = 0.0, 1000.0, []
        for i in range(rng.randint(5, 60)):
            t += rng.choice([1.0, 1.0, 1.0, 6.0, 0.0])
            z += rng.uniform(-3, 3)
            own.append((t, z + rng.choice([0.0] * 6 + [900.0, -400.0, 170.0])))
        rows += [(p, i, *x) for i, x in enumerate(own)]
        i = 1
        while i < len(own):
            (t0, z0), (t1, z1) = own[i - 1], own[i]
            far = t1 > t0 and abs(z1 - z0) / (t1 - t0) > 40
            back = next((j for j in range(i, len(own)) if far and t0 < own[j][0] <= t0 + 30 and abs(own[j][1] - z0) <= 150), None)
            if back is None:
                i += 1
                continue
            for j in range(i, back):
                want[p, j] = z0 + (own[back][1] - z0) * (own[j][0] - t0) / (own[back][0] - t0)
            i = back + 1
    got = {(r["pilot"], r["fix_index"]): r["repaired"] for r in routes.rate_repairs(spark.createDataFrame(rows, "pilot long, fix_index long, t double, alt double"), ["pilot"]).collect()}
    assert len(want) > 60 and got == pytest.approx(want)


def test_one_dead_channel_is_repaired_by_rates(spark):
    heights = [1000, 1001, 1002, 2600, 2601, 1004, 1005, 1006, 1007, 1008, 1009, 1010]
    rows = [("dead", i, 1000 * i, h, 0) for i, h in enumerate(heights)] + [("few", i, 1000 * i, h, 0) for i, h in enumerate(heights[:8])]
    fixes = spark.createDataFrame(rows, "pilot string, fix_index long, time_ms long, pressure_alt int, gnss_alt int")
    got = {(r["pilot"], r["fix_index"]): r["cleaned_alt"] for r in routes.repaired(fixes, ["pilot"]).filter("cleaned_alt is not null").collect()}
    assert got == pytest.approx({("dead", 3): 1002 + 2 / 3, ("dead", 4): 1002 + 4 / 3})


USES = "field int, use long, pilot long, start_t double, end_t double, east double, north double"


def random_uses(n=250, seed=3):
    rng = random.Random(seed)
    return [(i % 2, i, i % 17, (b := rng.uniform(0, 9000)), b + rng.uniform(60, 900), rng.uniform(-4000, 4000), rng.uniform(-1500, 1500)) for i in range(n)]


def grouped(uses):
    """use: smallest linked, by flooding."""
    near = lambda a, b: a[0] == b[0] and math.hypot(a[5] - b[5], a[6] - b[6]) <= 800 and a[3] <= b[4] + 120 and b[3] <= a[4] + 120
    of: dict = {}
    for u in sorted(uses, key=lambda u: u[1]):
        if u[1] in of:
            continue
        todo = [u]
        while todo:
            x = todo.pop()
            if x[1] not in of:
                of[x[1]] = u[1]
                todo += [y for y in uses if y[1] not in of and near(x, y)]
    return of


def test_thermals_link_in_place_and_time(spark):
    uses = random_uses()
    got = {r["use"]: r["grp"] for r in thermals.shared(spark.createDataFrame(uses, USES), ["field"]).collect()}
    assert got == grouped(uses)
    assert len(set(got.values())) > 5


def apart(own, depth=0):
    """Sets of uses: a group halved until it is short."""
    n = len(own)
    if n < 2:
        return [own]
    e, o = sum(u[5] for u in own) / n, sum(u[6] for u in own) / n
    xx, yy, xy = (sum(f(u) for u in own) for f in (lambda u: (u[5] - e) ** 2, lambda u: (u[6] - o) ** 2, lambda u: (u[5] - e) * (u[6] - o)))
    angle = math.atan2(2 * xy, xx - yy) / 2
    along = [(u[5] - e) * math.cos(angle) + (u[6] - o) * math.sin(angle) for u in own]
    if max(along) - min(along) <= 1000:
        if max(u[4] for u in own) - min(u[3] for u in own) <= 1800:
            return [own]
        along = [(u[3] + u[4]) / 2 for u in own]
    order = [u for _, u in sorted(zip(along, own, strict=True), key=lambda x: (x[0], x[1][1]))]
    value = sorted(along)
    ks = [k for k in range(max(1, n // 4), min(n - 1, math.ceil(n * 0.75))) if value[k] > value[k - 1]]
    at = max(ks, key=lambda k: (value[k] - value[k - 1], -k)) if ks else n // 2
    return apart(order[:at], depth + 1) + apart(order[at:], depth + 1)


def test_columns_come_apart(spark):
    uses = random_uses(160, 11)
    of = grouped(uses)
    want = set()
    for g in set(of.values()):
        want |= {frozenset(u[1] for u in part) for part in apart([u for u in uses if of[u[1]] == g])}
    members = thermals.columns(thermals.shared(spark.createDataFrame(uses, USES), ["field"]), ["field"])
    got = defaultdict(set)
    for r in members.collect():
        got[r["field"], r["grp"]].add(r["use"])
    assert {frozenset(s) for s in got.values()} == want and len(want) > len(set(of.values()))


def test_samples_and_cores_of_strong_lift(spark):
    track = [(1, 7, i, float(i), 1000.0 + 2 * i, 0.0) for i in range(20)] + [(1, 8, 0, 5.0, 900.0, 0.0)]
    rated = thermals.samples(spark.createDataFrame(track, "field int, use long, fix_index long, t double, alt double, east double"), spark.createDataFrame([(1, 7), (1, 8)], "field int, use long"), ["field"]).collect()
    assert len(rated) == 20 and all(r["rate"] == pytest.approx(2.0) for r in rated)  # a lone fix has no rate
    rng, rows = random.Random(2), []
    for i in range(60):
        spot = 0 if i < 25 else 400 if i < 50 else 4000 + 500 * (i - 50)
        rows.append(("a", i, 1, spot + rng.uniform(-20, 20), rng.uniform(-20, 20), 1050.0, 3.0 + i % 2, float(i)))
    rows += [("a", 100 + i, 1, 0.0, 0.0, 1050.0, 0.2, 0.0) for i in range(200)]
    found = spark.createDataFrame(rows, "thermal string, sample long, pilot int, east double, north double, alt double, rate double, t double")
    got = thermals.cores(found, ["thermal"]).orderBy("core").collect()
    assert [(r["core"], r["n"], r["band"]) for r in got] == [(0, 25, 10), (25, 25, 10)] and got[1]["east"] == pytest.approx(400, abs=10)
    assert thermals.bands(found.filter("sample < 10"), ["thermal"]).count() == 0  # too few samples
    assert thermals.leans(thermals.bands(found, ["thermal"]), found, ["thermal"]).count() == 0  # one band has no lean
