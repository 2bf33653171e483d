"""Gaggles: pilots who fly together, frame by frame, and the episodes that these make over time.

Which pilots are near each other is a grid join in Spark, up to the loosened gates. What depends on the
frame before (a pair once together stays linked further apart) runs per task over the links alone.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import nearby_pairs

# Fixed thresholds (metres, seconds).
ACROSS, UP, STICKY, LEAST_PILOTS, LEAST_SHARED, BRIDGE, LEAST_SECONDS = 400.0, 300.0, 1.6, 2, 2, 20.0, 60.0


def groups(links: Iterable[tuple[int, int]]) -> list[tuple[int, ...]]:
    """The components of links, each ascending, by their first pilot."""
    of: dict[int, set[int]] = {}
    for a, b in links:
        both = of.get(a, {a}) | of.get(b, {b})
        for pilot in both:
            of[pilot] = both
    return sorted({tuple(sorted(g)) for g in of.values() if len(g) >= LEAST_PILOTS})


def episodes_of(frames: Iterable[tuple[float, list[tuple[int, int, bool]]]], bridge: float = BRIDGE, least_seconds: float = LEAST_SECONDS) -> list[dict]:
    """Episodes of frames (time, links (a, b, tight)), by start: a group goes on with the episode it shares most pilots with."""
    before: dict[int, int] = {}
    opened: list[dict] = []
    done: list[dict] = []
    for t, links in frames:
        now = groups((a, b) for a, b, tight in links if tight or (a in before and before[a] == before.get(b)))
        before = {pilot: i for i, g in enumerate(now) for pilot in g}
        shared = sorted(((-len(e["now"].intersection(g)), i, j) for i, e in enumerate(opened) for j, g in enumerate(now)))
        taken: dict[int, dict] = {}
        for less, i, j in shared:
            if -less >= LEAST_SHARED and j not in taken and opened[i]["end"] < t:
                taken[j] = opened[i]
                opened[i]["end"] = t
        for j, g in enumerate(now):
            if j not in taken:
                taken[j] = {"start": t, "end": t, "all": set(), "peak": 0}
                opened.append(taken[j])
            taken[j]["now"] = set(g)
            taken[j]["all"] |= set(g)
            taken[j]["peak"] = max(taken[j]["peak"], len(g))
        done += [e for e in opened if t - e["end"] > bridge]
        opened = [e for e in opened if t - e["end"] <= bridge]
    return sorted((e for e in done + opened if e["end"] - e["start"] >= least_seconds), key=lambda e: (e["start"], sorted(e["all"])))


def gaggles(frames: DataFrame, bridge: float = BRIDGE, least_seconds: float = LEAST_SECONDS) -> DataFrame:
    """(task, episode, start_t, end_t, members, peak) of frames (task, t, pilot, east, north, alt), one row a pilot and time.

    Episodes last `least_seconds` or more; gaps up to `bridge` seconds are bridged. Pilots who do not race yet are left out by the caller.
    """
    pairs = nearby_pairs(frames, ["task", "t"], "east", "north", "pilot", ACROSS * STICKY)
    at = lambda x: frames.select("task", "t", F.col("pilot").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("east", "north", "alt")))
    both = pairs.select("task", "t", "a", "b").join(at("a"), ["task", "t", "a"]).join(at("b"), ["task", "t", "b"])
    up = F.abs(F.col("alt_a") - F.col("alt_b"))
    tight = (F.hypot(F.col("east_a") - F.col("east_b"), F.col("north_a") - F.col("north_b")) <= ACROSS) & (up <= UP)
    links = both.filter(up <= UP * STICKY).select("task", F.col("t").cast("double").alias("t"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), tight.alias("tight"))
    # frames without links count too: they end what was together
    every = links.select("task", "t", F.struct("a", "b", "tight").alias("link")).unionByName(frames.select("task", F.col("t").cast("double").alias("t")).distinct().withColumn("link", F.lit(None).cast("struct<a:bigint,b:bigint,tight:boolean>")))
    flat = every.select("task", "t", "link.a", "link.b", "link.tight")

    def run(x: pd.DataFrame) -> pd.DataFrame:
        task = x["task"].iloc[0]
        by_time: dict[float, list] = {}
        for t, a, b, tight in x.sort_values(["t", "a", "b"])[["t", "a", "b", "tight"]].itertuples(index=False):
            own = by_time.setdefault(t, [])
            if not pd.isna(a):
                own.append((int(a), int(b), bool(tight)))
        found = episodes_of(by_time.items(), bridge, least_seconds)
        return pd.DataFrame([(task, i, e["start"], e["end"], sorted(e["all"]), e["peak"]) for i, e in enumerate(found)], columns=["task", "episode", "start_t", "end_t", "members", "peak"])

    kind = frames.schema["task"].dataType.simpleString()
    return flat.groupBy("task").applyInPandas(run, f"task {kind}, episode int, start_t double, end_t double, members array<bigint>, peak int")
