"""How near pilots who did not reach goal came to it: the fix with the shortest way left through all that they lacked.

The way left from a fix is the shortest through the remaining cylinders in order, worked out anew for the fix. It is long work,
so a flight's fixes are taken in order of a bound below it: the way to the next edge and between the cylinders, or the
straight way to goal, whichever is more. Fixes go on being tried until no bound leaves room for CLOSE metres less than the best;
a fix so near one already tried that it cannot gain that either is passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import A, FLATTENING, inverse
from .routes import route

#: Metres by which the best may be missed, and fixes tried at once.
CLOSE, AT_ONCE = 5.0, 32


def nearest(fixes: np.ndarray, centres: np.ndarray, radii: np.ndarray, leaves: bool) -> tuple[int, np.ndarray, int]:
    """(fix, its way: points from the fix through the cylinders, how many ways were worked out), in metres of one frame."""
    away = np.hypot(*(fixes - centres[0]).T)
    edge = np.maximum(0, radii[0] - away if leaves else away - radii[0])
    apart = np.maximum(0, np.hypot(*np.diff(centres, axis=0).T) - radii[1:] - radii[:-1]).sum()
    straight = np.maximum(0, np.hypot(*(fixes - centres[-1]).T) - radii[-1])
    bound = np.maximum(edge + apart, straight)
    order = np.argsort(bound, kind="stable")
    tried, lengths = np.zeros(0, int), np.zeros(0)
    ways: dict[int, np.ndarray] = {}
    best, at = np.inf, 0
    while at < len(order) and bound[order[at]] < best - CLOSE:
        own = order[at : at + AT_ONCE]
        at += len(own)
        own = own[bound[own] < best - CLOSE]
        if len(tried):
            apart_ = np.hypot(*(fixes[own][:, None] - fixes[tried][None]).transpose(2, 0, 1))
            own = own[((lengths[None] - apart_) < best - CLOSE).all(1)]
        if not len(own):
            continue
        through = np.concatenate([fixes[own][:, None], np.broadcast_to(centres, (len(own), *centres.shape))], axis=1)
        found = route(through, np.broadcast_to(np.r_[0.0, radii], (len(own), len(radii) + 1)))
        length = np.hypot(*np.diff(found, axis=1).transpose(2, 0, 1)).sum(1)
        ways |= dict(zip(own.tolist(), found, strict=True))
        tried, lengths = np.r_[tried, own], np.r_[lengths, length]
        best = min(best, length.min())
    first = int(tried[lengths <= lengths.min() + 1e-6].min())
    return first, ways[first], len(tried)


def best_progress(tracks: DataFrame, paths: DataFrame, points: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """(task, keys, fix_index, t, remaining, tried) of the flights in paths (sequence.resolved) that did not make goal.

    tracks: (task, keys, fix_index, t, lat, lon); points and rules as for `resolved`. Fixes count from the last turnpoint
    reached to the closing time. remaining: metres on the ellipsoid.
    """
    zones = points.groupBy("task").agg(F.array_sort(F.collect_list(F.struct("tp", "way", "plat", "plon", "radius"))).alias("all"))
    last = F.get("path", F.size("path") - 1)
    lacking = paths.filter("not made_goal").join(rules.select("task", "start", "goal", "closes"), "task").join(zones, "task")
    asked = lacking.select("task", *keys, F.coalesce(last["t"], F.col("start_t")).alias("since"), "closes", F.filter("all", lambda z: (z["tp"] > F.coalesce(last["tp"], F.col("start"))) & (z["tp"] <= F.col("goal"))).alias("zones"))
    after = tracks.join(asked.drop("zones"), ["task", *keys]).filter("t >= since and (closes is null or t <= closes)")
    flights = after.groupBy("task", *keys).agg(F.array_sort(F.collect_list(F.struct("fix_index", F.col("t").cast("double").alias("t"), "lat", "lon"))).alias("fixes"))  # of one flight
    rows = flights.join(asked.select("task", *keys, "zones"), ["task", *keys])
    flat = rows.select("task", *keys, *[F.col(f"fixes.{c}").alias(c) for c in ("fix_index", "t", "lat", "lon")], *[F.col(f"zones.{c}").alias(c) for c in ("plat", "plon", "radius")], (F.col("zones")[0]["way"] == "exit").alias("leaves"))
    e2 = FLATTENING * (2 - FLATTENING)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                lat0, lon0 = (np.min(r.plat) + np.max(r.plat)) / 2, (np.min(r.plon) + np.max(r.plon)) / 2
                w = 1 - e2 * np.sin(np.radians(lat0)) ** 2
                north, east = np.radians(1) * A * (1 - e2) / w**1.5, np.radians(1) * A * np.cos(np.radians(lat0)) / np.sqrt(w)
                local = lambda lat, lon: np.stack([(np.asarray(lon, float) - lon0) * east, (np.asarray(lat, float) - lat0) * north], -1)  # noqa: E731, B023
                i, way, tried = nearest(local(r.lat, r.lon), local(r.plat, r.plon), np.asarray(r.radius, float), r.leaves)
                lat, lon = lat0 + way[:, 1] / north, lon0 + way[:, 0] / east
                remaining = float(inverse(lat[:-1], lon[:-1], lat[1:], lon[1:])[0].sum())
                out.append((*(getattr(r, k) for k in ("task", *keys)), int(r.fix_index[i]), float(r.t[i]), remaining, tried))
            if out:
                yield pd.DataFrame(out, columns=["task", *keys, "fix_index", "t", "remaining", "tried"])

    kinds = ", ".join(f"{k} {tracks.schema[k].dataType.simpleString()}" for k in ("task", *keys))
    return flat.mapInPandas(run, f"{kinds}, fix_index long, t double, remaining double, tried int")
