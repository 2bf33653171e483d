"""Aggregates that the built-in ones do not give: rank correlation, circular means, fits, exact shares and difficulty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .windows import average_rank


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, n, rho): rank correlation with mean ranks for ties; pairs with a null are left out, rho is null below 3 pairs or without spread."""
    kept = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    ranked = average_rank(average_rank(kept, keys, x, "_x"), keys, y, "_y")
    rho = F.corr("_x", "_y")
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.when((F.count("*") >= 3) & ~F.isnan(rho), rho).alias("rho"))


def circular_mean(degrees: Column, weight: Column) -> tuple[Column, Column]:
    """(direction 0 to 360, length) of the vector mean of directions."""
    east, north = F.avg(F.sin(F.radians(degrees)) * weight), F.avg(F.cos(F.radians(degrees)) * weight)
    return F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0)), F.hypot(east, north)


def largest_remainder(df: DataFrame, keys: list[str], value: str, order: list[str], whole: int = 100, name: str = "share") -> DataFrame:
    """Whole shares that add up to `whole` in each key: floors, and one more for the largest remainders."""
    of = W.partitionBy(*keys)
    exact = df.withColumn("_e", F.col(value) * whole / F.sum(value).over(of)).withColumn("_f", F.floor("_e"))
    short = exact.withColumn("_short", whole - F.sum("_f").over(of)).withColumn("_r", F.row_number().over(of.orderBy((F.round(F.col("_e") - F.col("_f"), 9)).desc(), *order)))
    return short.withColumn(name, (F.col("_f") + (F.col("_r") <= F.col("_short")).cast("long")).cast("long")).drop("_e", "_f", "_short", "_r")


def circle_fit(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, n, cx, cy, radius) of the algebraic least-squares circle, from sums of powers about the mean."""
    of = W.partitionBy(*keys)
    u, v = F.col("_u"), F.col("_v")
    z = u * u + v * v
    shifted = df.withColumn("_mx", F.avg(x).over(of)).withColumn("_my", F.avg(y).over(of)).withColumn("_u", F.col(x) - F.col("_mx")).withColumn("_v", F.col(y) - F.col("_my"))
    sums = shifted.groupBy(*keys).agg(F.count("*").alias("n"), F.first("_mx").alias("mx"), F.first("_my").alias("my"), F.sum(u * u).alias("uu"), F.sum(v * v).alias("vv"), F.sum(u * v).alias("uv"), F.sum(u * z).alias("uz"), F.sum(v * z).alias("vz"), F.avg(z).alias("z"))
    det = (F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")) * 2
    a = (F.col("uz") * F.col("vv") - F.col("vz") * F.col("uv")) / det
    b = (F.col("vz") * F.col("uu") - F.col("uz") * F.col("uv")) / det
    solved = sums.filter(F.abs(det) > 1e-9).withColumn("a", a).withColumn("b", b)
    return solved.select(*keys, "n", (F.col("mx") + F.col("a")).alias("cx"), (F.col("my") + F.col("b")).alias("cy"), F.sqrt(F.col("z") + F.col("a") * F.col("a") + F.col("b") * F.col("b")).alias("radius"))


def weighted_slope(x: Column, y: Column, w: Column) -> Column:
    """Slope of the weighted regression of y on x, as an aggregate; null without spread."""
    n, sx, sy = F.sum(w), F.sum(w * x), F.sum(w * y)
    spread = n * F.sum(w * x * x) - sx * sx
    return F.when(F.abs(spread) > 1e-9, (n * F.sum(w * x * y) - sx * sy) / spread)


def distance_difficulty(flights: DataFrame, keys: list[str], minimum: float = 5_000.0) -> DataFrame:
    """(keys, slot, relative, score) of the difficulty of each 100 m slot of a field.

    flights: keys, distance (m), goal (boolean). Landings are counted in slots; a slot's difficulty is the
    number of landings in the next `look` slots, `look` being 30 for a field that lands 1 km apart or closer and
    growing with the spacing; relative difficulty adds up to a half, and a slot's score adds up all before it.
    """
    least = int(minimum // 100)
    slot = F.greatest(F.floor(F.col("distance") / 100), F.lit(least)).cast("long")
    out = flights.filter(~F.col("goal"))
    field = flights.groupBy(*keys).agg(
        F.max("distance").alias("best"),
        F.sum((~F.col("goal")).cast("long")).alias("landed"),
        F.coalesce(F.max(F.when(~F.col("goal"), slot)), F.lit(least)).cast("long").alias("last"),
    )
    look = F.greatest(F.lit(30), F.floor(30 * (F.col("best") / 1000) / F.greatest("landed", F.lit(1)) + 0.5)).cast("long")
    field = field.withColumn("size", (F.floor((F.col("last") + 10) / 10) * 10).cast("long")).withColumn("look", look)
    none = field.filter("landed = 0").select(*keys, F.lit(least).cast("long").alias("slot"), F.lit(1).cast("long").alias("n"))
    landings = out.groupBy(*keys, slot.alias("slot")).agg(F.count("*").alias("n")).unionByName(none)
    # each landing makes the slots before it harder: spread, then added up; no frame depends on the field
    spread = landings.join(field, keys).withColumn("slot", F.explode(F.sequence(F.greatest(F.lit(0), F.col("slot") - F.col("look") + 1), F.col("slot"))))
    hard = spread.groupBy(*keys, "slot").agg(F.sum("n").alias("difficulty"))
    grid = field.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)).alias("slot"))
    filled = grid.join(hard, [*keys, "slot"], "left").withColumn("difficulty", F.coalesce("difficulty", F.lit(0)))
    of = W.partitionBy(*keys)
    relative = filled.withColumn("relative", 0.5 * F.col("difficulty") / F.sum("difficulty").over(of))
    total = F.sum("relative").over(of.orderBy("slot").rowsBetween(W.unboundedPreceding, 0))
    seed = F.sum(F.when(F.col("slot") <= least, F.col("relative"))).over(of)
    return relative.select(*keys, "slot", "difficulty", "relative", F.when(F.col("slot") <= least, seed).otherwise(total).alias("score"))


def combined_wind(df: DataFrame, keys: list[str], direction: str, speed: str) -> DataFrame:
    """(keys, direction, speed, n): the direction of the vector mean, the median of the speeds (a vector mean's length shrinks with scatter)."""
    towards, _ = circular_mean(F.col(direction), F.col(speed))
    return df.groupBy(*keys).agg(towards.alias("direction"), F.percentile(speed, F.lit(0.5)).alias("speed"), F.count("*").alias("n"))


def leg_occupancy(passes: DataFrame, keys: list[str], pilot: str, order: str, time: str) -> DataFrame:
    """(keys, leg, from, to, pilots): when each leg was flown at all, and by how many. passes: keys, pilot, order of the turnpoint, time."""
    w = W.partitionBy(*keys, pilot).orderBy(order)
    legs = passes.select(*keys, F.col(order).alias("leg"), F.col(time).alias("_a"), F.lead(time).over(w).alias("_b")).filter("_b IS NOT NULL")
    return legs.groupBy(*keys, "leg").agg(F.min("_a").alias("from"), F.max("_b").alias("to"), F.count("*").alias("pilots"))
