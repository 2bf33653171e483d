"""Interval and range joins by buckets of time, prioritised lookups and unambiguous matches."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import kept


def _buckets(begin: Column, end: Column, width: int) -> Column:
    return F.sequence(F.floor(begin / width), F.floor(end / width))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Rows of left (keys, begin, end) that overlap a row of right of the same key.

    Intervals are filed under the buckets of `width` that they touch, and meet by key and bucket; the
    semi join needs no duplicates removed but for left's own copies, which its row number tells.
    """
    a = left.withColumn("_row", F.monotonically_increasing_id()).withColumn("_bucket", F.explode(_buckets(F.col("begin"), F.col("end"), width)))
    b = right.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("begin").alias("_b"), F.col("end").alias("_e"), F.explode(_buckets(F.col("begin"), F.col("end"), width)).alias("_at"))
    met = F.col("_bucket") == F.col("_at")
    for k in keys:
        met = met & (F.col(k) == F.col(f"_{k}"))
    found = a.join(b, met & (F.col("begin") <= F.col("_e")) & (F.col("_b") <= F.col("end")), "left_semi")
    return found.dropDuplicates(["_row"]).drop("_row", "_bucket")


def preceded(left: DataFrame, right: DataFrame, keys: list[str], time: str, who: str, least: int, most: int) -> DataFrame:
    """Rows of left that another `who` preceded in right, in the same key, by between `least` and `most`.

    The range is cut into buckets of `most`: a row meets those of its own bucket and of the one before.
    """
    at = F.floor(F.col(time) / most)
    a = left.withColumn("_bucket", at)
    b = right.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(time).alias("_t"), F.col(who).alias("_who"), F.explode(F.array(at, at + 1)).alias("_at"))
    met = F.col("_bucket") == F.col("_at")
    for k in keys:
        met = met & (F.col(k) == F.col(f"_{k}"))
    passed = F.col(time) - F.col("_t")
    return a.join(b, met & (F.col(who) != F.col("_who")) & (passed >= least) & (passed <= most), "left_semi").drop("_bucket")


def prioritised(left: DataFrame, right: DataFrame, rules: list[tuple[str, str, str]], order: list[Column]) -> DataFrame:
    """left with the first match in right, by `order`, of the first rule that gives any; `match` names the rule, null where none does.

    A rule is (name, column of left, column of right), which are to be equal. Of right, only the first row of each value goes into
    a join, so that no row of left meets more than one. Right's columns must not clash.
    """
    out = left
    for i, (_, ours, theirs) in enumerate(rules):
        first = right.withColumn("_n", F.row_number().over(W.partitionBy(theirs).orderBy(*order))).filter("_n = 1")
        out = out.join(first.select(F.col(theirs).alias(f"_key{i}"), F.struct(*right.columns).alias(f"_row{i}")), F.col(ours) == F.col(f"_key{i}"), "left")
    row = F.coalesce(*[F.col(f"_row{i}") for i in range(len(rules))])
    match = F.coalesce(*[F.when(F.col(f"_key{i}").isNotNull(), F.lit(name)) for i, (name, _, _) in enumerate(rules)])
    return out.select(*left.columns, *[row[c].alias(c) for c in right.columns], match.alias("match"))


def unambiguous(left: DataFrame, right: DataFrame, name: str, left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id) of rows whose name occurs once on either side."""
    once = lambda d, i: d.groupBy(name).agg(F.countDistinct(i).alias("_n"), F.min(i).alias(i)).filter("_n = 1").drop("_n")
    return once(left, left_id).join(once(right, right_id), name).select(left_id, right_id)


#: Cells are so much longer than what they stand for that a quotient rounded up does not take a pair two cells apart.
SLACK = 1 + 1e-9


def _cell(c: str, side: float) -> Column:
    return F.floor(F.col(c) / side).cast("long")


def nearby_pairs(df: DataFrame, keys: list[str], east: str, north: str, who: str, reach: float) -> DataFrame:
    """(keys, a, b) with a < b of rows of a key within `reach`, by grid cells of that size.

    Of two cells side by side one meets the other, so that a row meets its own cell and four around it. Neither side is ever sent
    to all tasks: rows filed in five cells are more than their table's size tells.
    """
    side = reach * SLACK
    a = df.select(*keys, F.col(who).alias("_a"), F.col(east).alias("_ea"), F.col(north).alias("_na"), _cell(east, side).alias("_x"), _cell(north, side).alias("_y"))
    b = df.select(*keys, F.col(who).alias("_b"), F.col(east).alias("_eb"), F.col(north).alias("_nb"), _cell(east, side).alias("_x"), _cell(north, side).alias("_y"))
    ahead = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))]))
    b = b.withColumn("_o", ahead).withColumns({"_x": F.col("_x") + F.col("_o.i"), "_y": F.col("_y") + F.col("_o.j"), "_own": (F.col("_o.i") == 0) & (F.col("_o.j") == 0)}).drop("_o")
    de, dn = F.col("_ea") - F.col("_eb"), F.col("_na") - F.col("_nb")
    once = F.when(F.col("_own"), F.col("_a") < F.col("_b")).otherwise(F.col("_a") != F.col("_b"))
    met = a.join(b.hint("merge"), [*keys, "_x", "_y"]).filter(once & (F.sqrt(de * de + dn * dn) <= reach))
    return met.select(*keys, F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))


#: Rows of a cell that a row is looked for in, about, where rows lie close.
CROWD = 16


def nearest_within(left: DataFrame, right: DataFrame, left_id: str, right_id: str, east: str, north: str, reach: float) -> DataFrame:
    """(left_id, right_id, metres) of the nearest row of right within `reach`; ties go to the smaller id. Rows without one are left out.

    Both have east and north in metres. Left's rows look in the nine cells around them: first in cells so small that about CROWD of
    right's rows share one, where these lie closest; those that find none go on in cells twice as large, up to `reach`.
    """
    sound = F.col("_e").isNotNull() & F.col("_n").isNotNull() & (F.abs("_e") < float("inf")) & (F.abs("_n") < float("inf"))
    a = left.select(left_id, F.col(east).alias("_e"), F.col(north).alias("_n")).filter(sound & F.col(left_id).isNotNull())
    b = right.select(F.col(right_id).alias("_id"), F.col(east).alias("_e"), F.col(north).alias("_n")).filter(sound)
    b = b.groupBy("_e", "_n").agg(F.min("_id").alias("_id"))  # of rows at one place only the first can be nearest
    halvings, finest = 0, 40
    while halvings < finest:
        side = reach * SLACK / 2**halvings
        cells = b.groupBy(_cell("_e", side), _cell("_n", side)).agg(F.count("*").cast("double").alias("c"))
        crowd = cells.agg(F.sum(F.col("c") * F.col("c")) / F.sum("c")).first()[0] or 0.0
        if crowd <= 4 * CROWD:
            break
        halvings = min(finest, halvings + math.ceil(math.log(crowd / CROWD, 4)))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    found = None
    for k in range(halvings, -1, -1):
        near = reach / 2**k
        side = near * SLACK
        asks = a.withColumn("_o", around).select(left_id, F.col("_e").alias("_le"), F.col("_n").alias("_ln"), (_cell("_e", side) + F.col("_o.i")).alias("_x"), (_cell("_n", side) + F.col("_o.j")).alias("_y"))
        filed = b.withColumns({"_x": _cell("_e", side), "_y": _cell("_n", side)})
        de, dn = F.col("_le") - F.col("_e"), F.col("_ln") - F.col("_n")
        met = asks.hint("merge").join(filed, ["_x", "_y"]).withColumn("_m", F.sqrt(de * de + dn * dn)).filter(F.col("_m") <= near)
        best = met.groupBy(left_id).agg(F.min(F.struct("_m", "_id")).alias("_b"))
        if k:
            best = kept(best)
            a = kept(a.join(best.select(left_id), left_id, "left_anti"))
        found = best if found is None else found.unionByName(best)
        if k and a.isEmpty():
            break
    return found.select(left_id, F.col("_b._id").alias(right_id), F.col("_b._m").alias("metres"))


def nearest_step(left: DataFrame, grid: DataFrame, keys: list[str], time: str, origin: int, step: int) -> DataFrame:
    """left with the grid row of its key at the step nearest its time (halves go up), else nulls. grid: keys, step, values."""
    at = F.floor((F.col(time) - origin) / step + 0.5).cast("long")
    return left.withColumn("step", at).join(grid, [*keys, "step"], "left")


def nearest_snapshot(asked: DataFrame, shots: DataFrame, keys: list[str], time: str, tolerance: int) -> DataFrame:
    """(keys, time, at, the rest of shots): for each asked (keys, time), the shot nearest in time within `tolerance`, the earlier of two.

    Shots are filed under their bucket of `tolerance` and its neighbours, so that it is an equi-join.
    """
    rest = [c for c in shots.columns if c not in (*keys, time)]
    bucket = F.floor(F.col(time) / tolerance).cast("long")
    filed = shots.select(*keys, F.struct(F.col(time).alias("at"), *rest).alias("_shot"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_bucket"))
    met = asked.select(*keys, time).distinct().withColumn("_bucket", bucket).join(filed, [*keys, "_bucket"])
    away = F.abs(F.col("_shot.at") - F.col(time))
    best = met.filter(away <= tolerance).groupBy(*keys, time).agg(F.min_by("_shot", F.struct(away, F.col("_shot.at"))).alias("_shot"))
    return best.select(*keys, time, "_shot.*")


def by_name(asked: DataFrame, names: DataFrame, name: str, number: str, prefixes: list[str], least: int = 3) -> DataFrame:
    """(name, number, match) of the first of `names` (name, number: order in the file) that an asked name means.

    The same name comes first, then the same without a leading word of `prefixes`, then a name of at least
    `least` letters inside the asked one. Cases don't matter. Inside means equal to one of its parts, so that
    is an equi-join too.
    """
    upper = F.upper(F.col(name))
    own = asked.select(name).distinct().withColumn("_u", upper).withColumn("_s", F.trim(F.regexp_replace("_u", "^(" + "|".join(prefixes) + r")\s+", "")))
    # only parts as long as some name can be one: a few lengths, whatever the asked names' own
    lengths = sorted(r[0] for r in names.select(F.length(upper)).distinct().collect() if r[0] is not None and r[0] >= least)
    places = F.sequence(F.lit(1), F.greatest(F.length("_u"), F.lit(1)))

    def of(n: int) -> Column:
        return F.transform(F.filter(places, lambda i: i + n - 1 <= F.length("_u")), lambda i: F.substring(F.col("_u"), i, F.lit(n)))

    parts = F.flatten(F.array(*map(of, lengths))) if lengths else F.array().cast("array<string>")
    keyed = own.select(name, F.explode(F.concat(F.array(F.struct(F.lit(0).alias("level"), F.col("_u").alias("key")), F.struct(F.lit(1).alias("level"), F.col("_s").alias("key"))), F.transform(F.array_distinct(parts), lambda p: F.struct(F.lit(2).alias("level"), p.alias("key"))))).alias("k")).select(name, "k.*")
    known = names.groupBy(upper.alias("key")).agg(F.min(number).alias(number))  # the first of equal names
    best = keyed.join(known, "key").groupBy(name).agg(F.min(F.struct("level", number)).alias("_b"))
    label = F.element_at(F.array(F.lit("exact"), F.lit("stripped"), F.lit("contained")), F.col("_b.level") + 1)
    return best.select(name, F.col(f"_b.{number}").alias(number), label.alias("match"))


def values_of_all(values: DataFrame, pilots: DataFrame, key: str) -> DataFrame:
    """pilots with their values, null where a metric gives none; raises where it gives one for nobody in the field."""
    strangers = values.join(pilots, key, "left_anti").limit(1).count()
    if strangers:
        raise ValueError(f"a value for a {key} that is not in the field")
    return pilots.join(values, key, "left")


def matched(roster: DataFrame, ranked: DataFrame, row: str, civl: str, name: str, best: str) -> DataFrame:
    """(row, civl, best, matched_by) of roster (row, civl id or null, name) in ranked (civl, name, rank `best`, several rows a pilot).

    A row with an id has that pilot, or none. A row without has the pilot of its name, if the name is of one pilot alone, no other
    row has that pilot's id, and no other row without an id claims the pilot. Of a pilot's ranks the best counts.
    """
    pilots = ranked.groupBy(civl).agg(F.min(F.struct(best, name)).alias("_p")).select(F.col(civl).alias("_civl"), F.col(f"_p.{best}").alias(best), F.col(f"_p.{name}").alias("_name"))
    by_id = roster.filter(F.col(civl).isNotNull()).join(pilots, F.col(civl) == F.col("_civl")).select(row, F.col("_civl").alias(civl), best, F.lit("id").alias("matched_by"))
    key = lambda c: F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))
    once = pilots.withColumn("_key", key(F.col("_name"))).groupBy("_key").agg(F.count("*").alias("_n"), F.min("_civl").alias("_civl"), F.min(best).alias(best)).filter("_n = 1")
    used = roster.filter(F.col(civl).isNotNull()).select(F.col(civl).alias("_civl")).distinct()
    without = roster.filter(F.col(civl).isNull()).select(row, key(F.col(name)).alias("_key"))
    claims = without.join(once, "_key").join(used, "_civl", "left_anti")
    alone = claims.groupBy("_civl").agg(F.count("*").alias("_k"), F.min(row).alias(row), F.min(best).alias(best)).filter("_k = 1")
    return by_id.unionByName(alone.select(row, F.col("_civl").alias(civl), best, F.lit("name").alias("matched_by")))


def overlaid(scored: DataFrame, official: DataFrame, keys: list[str], rank: str) -> DataFrame:
    """scored with `official`, the published rank of the same keys (null: none), and `moved`, how many places the own rank is below it."""
    theirs = official.select(*keys, F.col(rank).alias("official"))
    return scored.join(theirs, keys, "left").withColumn("moved", F.col(rank) - F.col("official"))


def event_list(parts: list[tuple[DataFrame, str, str]], tracks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind, place, and the fix's columns) of parts (rows, the column that holds a fix, kind): everything that happens in a flight, by time and kind."""
    rows = None
    for df, fix, kind in parts:
        own = df.select(*keys, F.col(fix).alias("fix_index"), F.lit(kind).alias("kind")).filter("fix_index is not null")
        rows = own if rows is None else rows.unionByName(own)
    return rows.join(tracks, [*keys, "fix_index"]).withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy("t", "kind")))


def in_box(df: DataFrame, lat: str, lon: str, box: tuple[float, float, float, float]) -> DataFrame:
    """df with `in_view`: whether a row lies in the box (south, west, north, east)."""
    south, west, north, east = box
    return df.withColumn("in_view", F.col(lat).between(south, north) & F.col(lon).between(west, east))


def nearest_approach(tracks: DataFrame, points: DataFrame, task: str, keys: list[str], fix: str, point: str) -> DataFrame:
    """(task, keys, point, away, fix): how near each track (task, keys, fix, x, y) came to any of its task's points (task, point, x, y), a task's points being one array; ties go to the first point, then fix."""
    held = points.groupBy(task).agg(F.collect_list(F.struct(F.col("x").alias("px"), F.col("y").alias("py"), F.col(point).alias("p"))).alias("_points"))
    away = lambda q: F.struct(F.hypot(F.col("x") - q["px"], F.col("y") - q["py"]).alias("away"), q["p"].alias(point))
    near = tracks.join(held, task).select(task, *keys, fix, F.array_min(F.transform("_points", away)).alias("n"))
    best = near.groupBy(task, *keys).agg(F.min(F.struct("n.away", f"n.{point}", fix)).alias("b"))
    return best.select(task, *keys, f"b.{point}", "b.away", f"b.{fix}")
