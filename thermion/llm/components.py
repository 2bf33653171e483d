"""Connected components of a table of links, by alternating large-star and small-star rounds.

Each round is two grouped minima and two joins over the links; links never come to the driver. A
star's centre may hold a third of all links: minima are pre-aggregated before the shuffle, and centres of
more than their share of links (there are at most HEAVY of them) are sent to the links, not the links
to them. Every step of a round is written to shared storage, which cuts the lineage and survives lost
executors; as one plan, a round would hold its first steps dozens of times, and the driver all of that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

ROUNDS = 60
#: Centres that are broadcast in a round at most, and links below which none is.
HEAVY, FEW = 10_000, 1_000


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumnRenamed("u", "k")


def _joined(links: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """links (u, v) with m of u: centres of over total / HEAVY links, HEAVY at most, by broadcast, the others by shuffle."""
    many = max(FEW, total // HEAVY)
    heavy = F.broadcast(least.filter(F.col("n") > many).select("k", "m"))
    of_heavy = links.join(heavy, links["u"] == heavy["k"]).select("u", "v", "m")
    others = links.join(heavy, links["u"] == heavy["k"], "left_anti")
    light = least.filter(F.col("n") <= many).select("k", "m")
    return of_heavy.union(others.join(light, others["u"] == light["k"]).select("u", "v", "m"))


def connected(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes that occur in links (u, v) of one ordered type; component: the smallest node reachable.

    Defined results: links of a node to itself and repeated links are allowed, links with a null end
    are ignored, and no links give an empty result.
    """
    clean = links.filter("u is not null and v is not null")
    edges = written(clean.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    nodes = edges
    state, total = None, edges.count()
    for _ in range(ROUNDS):
        # large star: every neighbour above a node is linked to the smallest of its neighbours and itself
        both = edges.filter("u != v").select("u", "v").union(edges.filter("u != v").select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(_least(both).withColumn("m", F.least("m", "k")), "least")
        large = written(_joined(both, least, 2 * total).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        # small star: a node and its neighbours below it are linked to the smallest of them
        low = written(_least(large), "low")
        small = _joined(large, low, total).select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select(F.col("k").alias("u"), F.col("m").alias("v")))
        edges = written(small.filter("u != v").distinct(), "round")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state, total = now, now[0]
    else:
        raise RuntimeError("components have not settled")
    every = nodes.select(F.col("u").alias("node")).union(nodes.select(F.col("v").alias("node"))).distinct()
    joined = every.join(edges, every["node"] == edges["u"], "left")
    return joined.select("node", F.coalesce("v", "node").alias("component"))
