"""Style clusters: percentile columns, mean absolute distance over shared columns, and Ward's linkage.

Distances are a self-join of long rows (who, metric, value). Linkage runs per group (a task's field, at
most a few hundred members) in a grouped function.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def percentile_columns(values: DataFrame, keys: list[str], metric: str, value: str) -> DataFrame:
    """values with `pct`, the share (0 to 1) of the others in the same key and metric that are lower."""
    return values.withColumn("pct", F.percent_rank().over(W.partitionBy(*keys, metric).orderBy(value)))


def pair_distances(values: DataFrame, keys: list[str], who: str, metric: str, value: str, least: int = 3) -> DataFrame:
    """(keys, a, b, distance, shared) with a < b: mean absolute difference over the metrics that both have, `least` or more."""
    a = values.select(*keys, F.col(metric).alias("m"), F.col(who).alias("a"), F.col(value).alias("va"))
    b = values.select(*keys, F.col(metric).alias("m"), F.col(who).alias("b"), F.col(value).alias("vb"))
    met = a.join(b, [*keys, "m"]).filter("a < b")
    return met.groupBy(*keys, "a", "b").agg(F.avg(F.abs(F.col("va") - F.col("vb"))).alias("distance"), F.count("*").alias("shared")).filter(F.col("shared") >= least)


def ward(d: np.ndarray, k: int) -> np.ndarray:
    """Labels (from 0, by first member) of k clusters of a distance matrix, merged by Lance and Williams' rule."""
    n = len(d)
    d2, size, alive, label = d.astype(float) ** 2, np.ones(n), np.ones(n, bool), np.arange(n)
    np.fill_diagonal(d2, np.inf)
    for _ in range(n - k):
        live = np.flatnonzero(alive)
        sub = d2[np.ix_(live, live)]
        i, j = (live[x] for x in np.unravel_index(np.argmin(sub), sub.shape))
        i, j = min(i, j), max(i, j)
        total = size[i] + size[j] + size
        d2[i] = ((size[i] + size) * d2[i] + (size[j] + size) * d2[j] - size * d2[i, j]) / total
        d2[:, i] = d2[i]
        d2[i, i] = np.inf
        size[i] += size[j]
        alive[j] = False
        d2[j] = d2[:, j] = np.inf
        label[label == j] = i
    return np.unique(label, return_inverse=True)[1]


def silhouette(d: np.ndarray, label: np.ndarray) -> float:
    total = 0.0
    for i in range(len(d)):
        own = label == label[i]
        if own.sum() < 2:
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, label == c].mean() for c in set(label.tolist()) - {label[i]})
        total += (b - a) / max(a, b) if max(a, b) > 0 else 0.0
    return total / len(d)


def style_clusters(pairs: DataFrame, keys: list[str], least: int = 8) -> DataFrame:
    """(keys, who, cluster) of pairs (keys, a, b, distance): the number of clusters (2 to 6) with the best silhouette; ties keep fewer."""

    def run(x: pd.DataFrame) -> pd.DataFrame:
        who = sorted(set(x["a"]) | set(x["b"]))
        at = {w: i for i, w in enumerate(who)}
        d = np.full((len(who), len(who)), np.nan)
        d[x["a"].map(at), x["b"].map(at)] = d[x["b"].map(at), x["a"].map(at)] = x["distance"]
        np.fill_diagonal(d, 0)
        kept = list(range(len(who)))
        while len(kept) > 1 and np.isnan(d[np.ix_(kept, kept)]).any():  # the member with the fewest distances goes
            kept.pop(int(np.isnan(d[np.ix_(kept, kept)]).sum(0).argmax()))
        own = tuple(x[k].iloc[0] for k in keys)
        if len(kept) < least:
            return pd.DataFrame(columns=[*keys, "who", "cluster"])
        d = d[np.ix_(kept, kept)]
        best = max(((silhouette(d, label), -k, label) for k in range(2, min(6, len(kept) // 3) + 1) for label in [ward(d, k)]), key=lambda b: b[:2])[2]
        return pd.DataFrame([(*own, who[i], int(c) + 1) for i, c in zip(kept, best, strict=True)], columns=[*keys, "who", "cluster"])

    kinds = ", ".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in keys)
    return pairs.groupBy(*keys).applyInPandas(run, f"{kinds}, who {pairs.schema['a'].dataType.simpleString()}, cluster int")
