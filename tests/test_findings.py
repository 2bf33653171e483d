"""Cases that reviews of the queries found, each on a small input."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from thermion.operators import components, field, joins, thermals
from thermion.plans import catalog, logs


def join_rows(df):
    """Rows that the joins of df, which has been collected, have given."""

    def walk(node):
        name, n = node.nodeName(), 0
        if "Join" in name and node.metrics().contains("numOutputRows"):
            n = node.metrics().apply("numOutputRows").value()
        below = [node.executedPlan()] if name.startswith("AdaptiveSparkPlan") else [node.plan()] if "QueryStage" in name else [node.children().apply(i) for i in range(node.children().size())]
        return n + sum(map(walk, below))

    return walk(df._jdf.queryExecution().executedPlan())


def test_allowed_change_is_decimal(spark):
    """0.05 * 3 as doubles is more than 0.15: a change of exactly that double is no jump, the one of decimals is."""
    df = spark.createDataFrame([("a", 0, 0.0), ("a", 3, 0.1500000000000000222), ("b", 0, 0.0), ("b", 3, 0.15)], "k string, t long, v double")
    assert 0.05 * 3 > 0.15
    got = {r.k: r.jumps for r in field.quality(df, ["k"], "t", "v", 0.05, 7200).collect()}
    assert got == {"a": 1, "b": 0}
    assert field.quality(df.withColumn("t", F.col("t") + 0.5), ["k"], "t", "v", 0.05, 7200).count() == 2


def test_totals_are_added_in_file_order(spark, tmp_path):
    """Sums of doubles that end in .5 go up or down with the order; however many tasks read the table, it is the file's."""
    rng = np.random.default_rng(5)
    n = 20_000
    who, price = rng.integers(0, 300, n), rng.integers(1, 50_000_000, n) / 100
    price[:] = np.where(rng.random(n) < 0.5, np.floor(price) + 0.35, np.floor(price) + 0.15)
    rows = pa.table({"o_custkey": pa.array(who), "o_orderpriority": pa.array(["1-URGENT"] * n), "o_totalprice": pa.array(price)})
    pq.write_table(rows, tmp_path / "orders.parquet", row_group_size=500)
    want = {}
    for k, p in zip(who.tolist(), price.tolist(), strict=True):
        want[k] = want.get(k, 0.0) + p
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        got = {r.o_custkey: r.total for r in catalog.QUERIES["scores_wide"](spark, str(tmp_path)).collect()}
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert got == {k: int(np.floor(v + 0.5)) for k, v in want.items()}


def test_links_are_no_pairs(spark, monkeypatch):
    """Climbs of one large gaggle hang together by a few links, not by all pairs."""
    seen, real = [], components.connected_components

    def counted(links):
        seen.append(links.count())
        return real(links)

    monkeypatch.setattr(components, "connected_components", counted)
    monkeypatch.setattr(thermals, "connected_components", counted)
    i = F.col("id")
    uses = spark.range(2000).select(F.lit(1).alias("field"), i.alias("use"), i.alias("pilot"), (i % 7).cast("double").alias("start_t"), (i % 7 + 300).cast("double").alias("end_t"), (i * 37 % 700).cast("double").alias("east"), (i * 53 % 700).cast("double").alias("north"))
    assert {r.grp for r in thermals.shared(uses, ["field"]).select("grp").distinct().collect()} == {0}
    assert sum(seen) < 10_000


def test_components_of_places(spark):
    """By brute force: near places, chains of lone ones, equal numbers, equal places, and rows without a place, key or number."""
    rng = np.random.default_rng(8)
    rows = [(int(t), int(w), float(e), float(n)) for t, w, e, n in zip(rng.integers(0, 3, 260), rng.integers(0, 240, 260), rng.uniform(-900, 900, 260), rng.uniform(-900, 900, 260), strict=True)]
    rows += [(9, 1000 + i, 100.0 * i, -75.0 * i) for i in range(6)] + [(9, 1100 + i, 125.5 * i, 5000.0) for i in range(4)] + [(9, 1200 + i, 7000.0, 1.0) for i in range(3)]
    odd = [(9, 1300, None, 0.0), (9, 1301, float("nan"), 0.0), (9, 1302, float("inf"), 0.0), (9, 1303, float("nan"), 0.0), (None, 1304, 0.0, 0.0), (None, 1305, 0.0, 0.0), (9, None, 7000.0, 1.0)]
    of = {r[1]: r[1] for r in rows}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    linked = set()
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] != b[1] and np.sqrt((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2) <= 125:
                linked |= {a[1], b[1]}
                x, y = sorted((root(a[1]), root(b[1])))
                of[y] = x
    df = spark.createDataFrame(rows + odd, "k int, who long, east double, north double")
    found = components.near_components(df, ["k"], "who", "east", "north", 125.0, repeated=True)
    assert found.count() == len(rows + odd)
    got = {r.who: r.component for r in found.filter("not alone").collect()}
    want = {w: root(w) for w in linked}
    assert {k: (got.get(k), want.get(k)) for k in got.keys() | want.keys() if got.get(k) != want.get(k)} == {}
    assert len(set(got.values())) > 10
    assert all(r.component == r.who for r in found.filter("alone").collect())


def test_prioritised_meets_one_row(spark):
    """A row of left meets the first row of right alone, not all of its key."""
    left = spark.createDataFrame([(1, 7), (2, 7), (3, 8), (4, None), (9, 7)], "s int, n int")
    right = spark.createDataFrame([(9, 7), (1, 5), (5, 7), (6, 7), (7, None)], "c int, m int")
    args = (left, right, [("id", "s", "c"), ("nation", "n", "m")], [F.col("c")])
    assert sorted(tuple(r) for r in joins.prioritised(*args).collect()) == [(1, 7, 1, 5, "id"), (2, 7, 5, 7, "nation"), (3, 8, None, None, None), (4, None, None, None, None), (9, 7, 9, 7, "id")]
    many = spark.range(3000).select(F.col("id").alias("c"), F.lit(7).alias("m"))
    df = joins.prioritised(spark.range(4000, 7000).select(F.col("id").alias("s"), F.lit(7).alias("n")), many, args[2], args[3])
    df.collect()
    assert 0 < join_rows(df) < 10_000


def test_pairs_meet_once(spark):
    """All pairs by brute force, with equal places, edges of cells and rows without a place; a row meets five cells of nine."""
    rng = np.random.default_rng(4)
    rows = [(1, i, float(e), float(n)) for i, (e, n) in enumerate(zip(rng.integers(-30, 30, 300) * 12.0, rng.integers(-30, 30, 300) * 16.0, strict=True))]
    df = spark.createDataFrame([*rows, (1, 900, None, 0.0), (1, 901, float("nan"), 0.0), (None, 902, 0.0, 0.0)], "k int, w int, e double, n double")
    got = joins.nearby_pairs(df, ["k"], "e", "n", "w", 100.0)
    want = [(1, a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and np.sqrt((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2) <= 100]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 1000
    plan = got._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_nearest_looks_in_small_cells(spark):
    """The nearest by brute force, of crowds and of lone rows, and with ties."""
    rng = np.random.default_rng(6)
    right = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.normal(0, 40, 3000).round(1), rng.normal(0, 40, 3000).round(1), strict=True))]
    right += [(5000 + i, 1000.0 * i, 3000.0) for i in range(5)] + [(4000, 1000.0, 3000.0), (6000, None, 1.0)]
    left = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-300, 300, (200, 2)))] + [(900 + i, 990.0 * i, 2800.0) for i in range(6)] + [(999, float("nan"), 0.0)]
    want = {}
    for k, x, y in left:
        near = [(np.sqrt((x - r[1]) ** 2 + (y - r[2]) ** 2), r[0]) for r in right if r[1] is not None]
        near = min((n for n in near if n[0] <= 400), default=None)
        if near and k != 999:
            want[k] = near[::-1]
    kind = "double, y double"
    df = joins.nearest_within(spark.createDataFrame(left, f"a int, x {kind}"), spark.createDataFrame(right, f"b int, x {kind}"), "a", "b", "x", "y", 400.0)
    assert {r.a: (r.b, r.metres) for r in df.collect()} == want and len(want) > 150
    assert join_rows(df) < 100_000


def test_waypoint_formulas_stay_apart(spark):
    """A reader's columns are worked out once: no plan holds a formula in all that names it (120000 characters of the first format alone)."""
    df = logs.waypoint_formats(spark, "/root/testdata/sf0.001")
    assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 60_000
