"""The shortest way through a task's cylinders, and altitudes repaired from the other channel.

Routes: tasks are few rows each, and any number of tasks is spread by key. Touching points are moved in
turn on their circles, in metres about the task's middle, until the route stops getting shorter; lengths
are then of the ellipsoid.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import A, FLATTENING, inverse

#: Metres of gain below which a route is done; angles tried on a circle before the search narrows.
CLOSE, ANGLES, NARROWED = 0.1, 96, 30
# Fixed values of the repair: metres a channel may stray from the usual difference, half the window in milliseconds, share of zeros of a dead channel.
STRAY, HALF_WINDOW, DEAD, LEAST_FIXES = 150.0, 60_000, 0.5, 10
# And of the repair by rates: metres a second that no flight climbs or sinks, seconds within which an excursion returns, and metres within which it does.
CLIMBS_AT_MOST, EXCURSION, RETURN = 40.0, 30.0, 150.0


def nearest(centre: np.ndarray, radius: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The points of circles nearest to others, a row each."""
    way = before - centre
    far = np.hypot(way[:, 0], way[:, 1])[:, None]
    return centre + np.where(far > 0, way / np.where(far > 0, far, 1), [0.0, 1.0]) * radius[:, None]


def touching(centre: np.ndarray, radius: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The points of circles over which the ways from before to after are shortest, a row each."""
    # a segment that meets its circle needs no detour: its first meeting point
    run, back = after - before, before - centre
    a, b, c = (run * run).sum(1), (run * back).sum(1), (back * back).sum(1) - radius * radius
    root, safe = np.sqrt(np.maximum(b * b - a * c, 0)), np.where(a > 0, a, 1)
    near, far = (-b - root) / safe, (-b + root) / safe
    share = np.where((near >= 0) & (near <= 1), near, far)
    meets = (a > 0) & (b * b >= a * c) & (share >= 0) & (share <= 1)
    out = before + share[:, None] * run

    def at(angle: np.ndarray) -> np.ndarray:
        return centre[:, None] + radius[:, None, None] * np.stack([np.sin(angle), np.cos(angle)], axis=-1)

    def best(angle: np.ndarray) -> np.ndarray:
        to, on = at(angle) - before[:, None], at(angle) - after[:, None]
        return angle[np.arange(len(angle)), np.argmin(np.hypot(to[..., 0], to[..., 1]) + np.hypot(on[..., 0], on[..., 1]), axis=1)]

    miss = ~meets
    if miss.any():
        centre, radius, before, after = centre[miss], radius[miss], before[miss], after[miss]
        width = 2 * np.pi / ANGLES
        middle = best(np.broadcast_to(np.arange(ANGLES) * width, (len(centre), ANGLES)))
        for _ in range(NARROWED):
            middle, width = best(middle[:, None] + np.linspace(-width, width, 5)), width / 2
        out[miss] = at(middle[:, None])[:, 0]
    return out


def route(centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Touching points, in metres, of tasks (first axis) of as many cylinders each: the first is a centre, the last the nearest of its circle."""
    points, n = centres.astype(float).copy(), centres.shape[1]
    last, going = np.full(len(points), np.inf), np.arange(len(points))
    for _ in range(50 + 10 * n):
        own, c, r = points[going], centres[going], radii[going]
        for i in range(1, n):
            own[:, i] = touching(c[:, i], r[:, i], own[:, i - 1], own[:, i + 1]) if i + 1 < n else nearest(c[:, i], r[:, i], own[:, i - 1])
        points[going] = own
        step = np.diff(own, axis=1)
        total = np.hypot(step[..., 0], step[..., 1]).sum(1)
        gained = last[going] - total > CLOSE
        last[going] = total
        going = going[gained]
        if not len(going):
            break
    return points


def optimised(points: DataFrame) -> DataFrame:
    """(task, tp, lat, lon, leg, total) of points (task, tp, plat, plon, radius): where to touch each turnpoint, the leg to it and the way so far, in metres.

    A task becomes one row of arrays; tasks of as many turnpoints are worked on together, a batch at a time.
    """
    whole = points.groupBy("task").agg(F.array_sort(F.collect_list(F.struct("tp", "plat", "plon", "radius"))).alias("tps"))
    rows = whole.select("task", *(F.col(f"tps.{c}").alias(c) for c in ("tp", "plat", "plon", "radius")))
    e2 = FLATTENING * (2 - FLATTENING)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for n, x in batch.groupby(batch["tp"].map(len)):
                lat, lon, radius = (np.stack(x[c].to_numpy()).astype(float) for c in ("plat", "plon", "radius"))
                lat0, lon0 = ((v.min(1, keepdims=True) + v.max(1, keepdims=True)) / 2 for v in (lat, lon))
                w = 1 - e2 * np.sin(np.radians(lat0)) ** 2
                north, east = np.radians(1) * A * (1 - e2) / w**1.5, np.radians(1) * A * np.cos(np.radians(lat0)) / np.sqrt(w)
                at = route(np.stack([(lon - lon0) * east, (lat - lat0) * north], axis=-1), radius)
                la, lo = lat0 + at[..., 1] / north, lon0 + at[..., 0] / east
                legs = np.zeros_like(la)
                if n > 1:
                    legs[:, 1:] = inverse(la[:, :-1].ravel(), lo[:, :-1].ravel(), la[:, 1:].ravel(), lo[:, 1:].ravel())[0].reshape(len(la), -1)
                yield pd.DataFrame({"task": np.repeat(x["task"].to_numpy(), n), "tp": np.concatenate(x["tp"].to_numpy()), "lat": la.ravel(), "lon": lo.ravel(), "leg": legs.ravel(), "total": legs.cumsum(1).ravel()})

    kind = points.schema["task"].dataType.simpleString()
    return rows.mapInPandas(run, f"task {kind}, tp int, lat double, lon double, leg double, total double")


def rate_repairs(fixes: DataFrame, keys: list[str], height: str = "alt", rate: float = CLIMBS_AT_MOST, span: float = EXCURSION, near: float = RETURN) -> DataFrame:
    """(keys, fix_index, repaired) of fixes (keys, fix_index, t seconds, `height`) that leave their track's height and come back.

    A step faster than `rate` begins an excursion if within `span` seconds of the fix before it a height comes within `near` of
    that fix's; up to the first such fix, heights are drawn straight between the two. An excursion that begins within another, or
    at the fix that ends it, is none. Only the few steps too fast look ahead: they meet the fixes of their time by blocks of
    `span`. Which of a track's excursions hold is a fold over them.
    """
    at = W.partitionBy(*keys).orderBy("fix_index")
    t, z = F.col("t").cast("double"), F.col(height).cast("double")
    shown = fixes.select(*keys, "fix_index", t.alias("t"), z.alias("z"))
    steps = shown.withColumns({"t0": F.lag("t").over(at), "z0": F.lag("z").over(at)})
    fast = steps.filter((F.col("t") > F.col("t0")) & (F.abs(F.col("z") - F.col("z0")) / (F.col("t") - F.col("t0")) > rate))
    block = lambda c: F.floor(F.col(c) / span).cast("long")
    asks = fast.select(*keys, F.col("fix_index").alias("i"), "t0", "z0", F.explode(F.array(block("t0"), block("t0") + 1)).alias("block"))
    ahead = asks.join(shown.withColumn("block", block("t")), [*keys, "block"]).filter((F.col("fix_index") >= F.col("i")) & (F.col("t") > F.col("t0")) & (F.col("t") - F.col("t0") <= span) & (F.abs(F.col("z") - F.col("z0")) <= near))
    back = ahead.groupBy(*keys, "i", "t0", "z0").agg(F.min(F.struct(F.col("fix_index").alias("j"), "t", "z")).alias("back"))
    kind = fixes.schema["fix_index"].dataType.simpleString()
    one = F.struct("i", "t0", "z0", F.col("back.j").alias("j"), F.col("back.t").alias("t1"), F.col("back.z").alias("z1"))
    begin = F.struct(F.lit(None).cast(kind).alias("done"), F.expr(f"cast(array() as array<struct<i:{kind},t0:double,z0:double,j:{kind},t1:double,z1:double>>)").alias("out"))
    add = lambda s, x: F.when(s["done"].isNull() | (x["i"] > s["done"]), F.struct(x["j"].alias("done"), F.concat(s["out"], F.array(x)).alias("out"))).otherwise(s)
    kept = back.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("all")).select(*keys, F.explode(F.aggregate("all", begin, add, lambda s: s["out"])).alias("x"))
    spans = kept.filter("x.j > x.i").select(*keys, "x", F.explode(F.sequence(F.col("x.i"), F.col("x.j") - 1)).alias("fix_index"))
    share = (F.col("t") - F.col("x.t0")) / (F.col("x.t1") - F.col("x.t0"))
    return shown.join(spans, [*keys, "fix_index"]).select(*keys, "fix_index", (F.col("x.z0") + (F.col("x.z1") - F.col("x.z0")) * share).alias("repaired"))


def repaired(fixes: DataFrame, keys: list[str]) -> DataFrame:
    """Adds cleaned_alt to fixes (keys, fix_index, time_ms, pressure_alt, gnss_alt), null where nothing is wrong.

    With both channels alive: where satellite height is missing or strays from pressure height by 150 m more than usual within
    a minute around, pressure height and the usual difference. With one dead: excursions of the other (rate_repairs). Tracks of
    fewer than 10 fixes are left as they are.
    """
    of = W.partitionBy(*keys)
    around = of.orderBy("time_ms").rangeBetween(-HALF_WINDOW, HALF_WINDOW)
    share = lambda c: F.avg((F.col(c) == 0).cast("double")).over(of)
    known = fixes.withColumn("_alive", (share("gnss_alt") < DEAD) & (share("pressure_alt") < DEAD)).withColumn("_some", F.count("*").over(of) >= LEAST_FIXES)
    differ = known.withColumn("_differ", F.when((F.col("gnss_alt") != 0) & (F.col("pressure_alt") != 0), F.col("gnss_alt") - F.col("pressure_alt")).cast("double"))
    usual = differ.withColumn("_usual", F.percentile("_differ", 0.5).over(around))
    wrong = F.col("_alive") & (F.col("pressure_alt") != 0) & F.col("_usual").isNotNull() & ((F.col("gnss_alt") == 0) | (F.abs(F.col("_differ") - F.col("_usual")) > STRAY))
    raw = F.when(F.col("gnss_alt") != 0, F.col("gnss_alt")).otherwise(F.col("pressure_alt"))
    alone = known.filter("not _alive and _some").select(*keys, "fix_index", (F.col("time_ms") / 1000).alias("t"), raw.alias("alt"))
    by_rate = rate_repairs(alone, keys)
    both = usual.join(by_rate, [*keys, "fix_index"], "left")
    cleaned = F.when(F.col("_some"), F.when(wrong, F.col("pressure_alt") + F.col("_usual")).otherwise(F.col("repaired")))
    return both.withColumn("cleaned_alt", cleaned).drop("_alive", "_some", "_differ", "_usual", "repaired").select(*fixes.columns, "cleaned_alt")
