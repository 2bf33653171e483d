"""Sheets, stored parts and logs; which way turnpoints are crossed."""

from __future__ import annotations

from pyspark.sql import functions as F
from thermion.operators import routes
from thermion.sources import sheets, tasks


def test_sheets_round_trip_in_order(spark, tmp_path):
    rows = [(i, f'say "hi", {i}' if i % 2 else None, i / 4) for i in range(50)]
    df = spark.createDataFrame(rows, "id int, note string, points double").repartition(5)
    sheets.write_sheet(df, f"{tmp_path}/s", F.desc("points"), F.col("id"))
    back = sheets.read_sheet(spark, f"{tmp_path}/s", "id int, note string, points double")
    assert sorted(map(tuple, back.collect()), key=lambda r: r[0]) == rows
    files = sorted((tmp_path / "s").glob("*.csv"))
    lines = [x for f in files for x in f.read_text().splitlines()[1:]]
    assert [int(x.split(",")[0]) for x in lines] == list(range(49, -1, -1))


def test_parts_are_replaced_and_logs_grow(spark, tmp_path):
    made = lambda x: spark.createDataFrame([(x, i, f"d{x}{i}") for i in range(3)], "task int, pilot int, state string")
    path = f"{tmp_path}/t"
    sheets.store(made(1).unionByName(made(2)), path, "task")
    sheets.store(made(2).withColumn("state", F.lit("new")).limit(1), path, "task")
    got = {(r["task"], r["pilot"], r["state"]) for r in spark.read.parquet(path).collect()}
    assert got == {(1, 0, "d10"), (1, 1, "d11"), (1, 2, "d12"), (2, 0, "new")}
    wanted = spark.createDataFrame([(0, "d10"), (1, "other"), (9, "d19")], "pilot int, state string")
    held = spark.read.parquet(path).filter("task = 1")
    assert sorted(r["pilot"] for r in sheets.stale(wanted, held, "pilot", "state").collect()) == [1, 9]
    for who in ("a", "b"):
        sheets.append_log(spark.createDataFrame([(who, "scored")], "who string, what string"), f"{tmp_path}/log")
    assert sorted(r["who"] for r in spark.read.parquet(f"{tmp_path}/log").filter("written is not null").collect()) == ["a", "b"]


def test_directions_of_turnpoints(spark):
    km = 1 / 110.95
    at = lambda tp, north, radius: ("a", tp, -36.0 + north * km, 147.0, radius)
    points = spark.createDataFrame([at(0, 0, 400.0), at(1, 0, 3000.0), at(2, 20, 1000.0), at(3, 21, 30_000.0), at(4, 0, 50_000.0)], "task string, tp int, plat double, plon double, radius double")
    rules = spark.createDataFrame([("a", 1, "exit")], "task string, start int, start_way string")
    got = {r["tp"]: r["way"] for r in tasks.directions(points, routes.optimised(points), rules).collect()}
    assert got == {0: "enter", 1: "exit", 2: "enter", 3: "exit", 4: "enter"}
    task = spark.createDataFrame([(1,)], "i int").select(F.from_json(F.lit('{"turnpoints": [{"radius": 1}, {"type": "SSS", "radius": 2}, {"radius": 3}]}'), tasks.SCHEMA).alias("t"))
    assert [x["radius"] for x in task.select(tasks.trimmed(F.col("t")).alias("t")).first()["t"]["turnpoints"]] == [2.0, 3.0]
