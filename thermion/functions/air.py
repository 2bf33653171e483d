"""Scalars of the air: cloud base, standard pressure and height, wind between levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metres of cloud base a degree of spread; the standard atmosphere.
METRES_PER_DEGREE, SCALE, EXPONENT, SEA_LEVEL = 125.0, 44330.77, 0.1902632, 1013.25


def cloud_base(temperature: Column, dew_point: Column) -> Column:
    """Metres above ground; null without a spread."""
    spread = temperature - dew_point
    return F.when(spread > 0, METRES_PER_DEGREE * spread)


def height_of(pressure: Column) -> Column:
    return SCALE * (1 - F.pow(pressure / SEA_LEVEL, F.lit(EXPONENT)))


def pressure_at(height: Column) -> Column:
    return SEA_LEVEL * F.pow(1 - height / SCALE, F.lit(1 / EXPONENT))


#: Metres above the ground at which wind is looked up where nothing else is said.
FLYING_HEIGHT = 1000.0


def usable(levels: Column) -> Column:
    """Of an array of struct<height, speed, direction>, those with a wind."""
    return F.filter(levels, lambda x: x["speed"].isNotNull() & x["direction"].isNotNull())


def nearest_level(levels: Column, height: Column) -> Column:
    """The level with a wind nearest to a height, the first of equals; null without any."""
    gaps = F.transform(usable(levels), lambda x, i: F.struct(F.abs(x["height"] - height).alias("gap"), i.alias("i"), x.alias("level")))
    return F.array_min(gaps)["level"]


def flying_level(levels: Column, ground: Column, above: float = FLYING_HEIGHT) -> Column:
    """The level nearest to flying height above the ground (unknown: sea level)."""
    return nearest_level(levels, F.coalesce(ground, F.lit(0.0)) + above)


def wind_at(levels: Column, height: Column) -> Column:
    """struct<speed, direction it blows from> at a height: vectors between the levels below and above it; beyond the lowest and highest, theirs."""
    vector = F.transform(usable(levels), lambda x: F.struct(x["height"].alias("h"), (x["speed"] * F.sin(F.radians(x["direction"]))).alias("u"), (x["speed"] * F.cos(F.radians(x["direction"]))).alias("v")))
    own = F.array_sort(vector)
    below, above = F.filter(own, lambda x: x["h"] < height), F.filter(own, lambda x: x["h"] >= height)
    hi, lo = F.coalesce(F.get(above, F.lit(0)), F.get(own, F.size(own) - 1)), F.coalesce(F.get(below, F.size(below) - 1), F.get(own, F.lit(0)))

    def between(p: Column) -> Column:
        t = F.when(p["hi"]["h"] > p["lo"]["h"], F.least(F.greatest((height - p["lo"]["h"]) / (p["hi"]["h"] - p["lo"]["h"]), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        u, v = p["lo"]["u"] + (p["hi"]["u"] - p["lo"]["u"]) * t, p["lo"]["v"] + (p["hi"]["v"] - p["lo"]["v"]) * t
        return F.when(p["hi"].isNotNull(), F.struct(F.sqrt(u * u + v * v).alias("speed"), F.pmod(F.degrees(F.atan2(u, v)), F.lit(360.0)).alias("direction")))

    return F.transform(F.array(F.struct(lo.alias("lo"), hi.alias("hi"))), between)[0]
