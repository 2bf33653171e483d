"""Sunrise and sunset as column expressions, in seconds since 1970: the published sunrise equation, good to a minute or three."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400
# Fixed values of the equation: noon of 2000-01-01, the sun's mean anomaly and its daily motion, the terms of its centre, its perihelion, of transit and tilt, and the height of its middle at rise, degrees and days.
NOON_2000 = 946_728_000
ANOMALY, DAILY, CENTRE, PERIHELION = 357.5291, 0.98560028, (1.9148, 0.02, 0.0003), 102.9372
TRANSIT, TILT, RISES_AT = (0.0053, -0.0069), 23.4397, -0.833


def sun_times(lat: Column, lon: Column, midnight: Column) -> Column:
    """struct<rise, set> of the solar day about the noon of a UTC day; null where the sun does not rise or does not set."""
    noon = F.round((midnight - NOON_2000) / DAY + 0.5) - lon / 360
    anomaly = (F.lit(ANOMALY) + noon * DAILY) % 360
    m = F.radians(anomaly)
    along = (anomaly + CENTRE[0] * F.sin(m) + CENTRE[1] * F.sin(2 * m) + CENTRE[2] * F.sin(3 * m) + 180 + PERIHELION) % 360
    transit = noon + TRANSIT[0] * F.sin(m) + TRANSIT[1] * F.sin(2 * F.radians(along))
    height = F.sin(F.radians(along)) * F.sin(F.radians(F.lit(TILT)))
    share = (F.sin(F.radians(F.lit(RISES_AT))) - F.sin(F.radians(lat)) * height) / (F.cos(F.radians(lat)) * F.cos(F.asin(height)))
    half = F.degrees(F.acos(share)) / 360
    at = lambda days: F.lit(float(NOON_2000)) + days * DAY
    return F.when(share.between(-1, 1), F.struct(at(transit - half).alias("rise"), at(transit + half).alias("set")))


def daylight(lat: Column, lon: Column, begin: Column, end: Column) -> Column:
    """struct<rise, set> of the one day whose light a span of seconds shares most of; the first of equals, null where it shares none."""
    days = F.sequence(F.floor(begin / DAY) - 1, F.floor(end / DAY) + 1)
    tried = F.filter(F.transform(days, lambda d: sun_times(lat, lon, d * DAY)), lambda s: s.isNotNull())
    shared = lambda s: F.least(end, s["set"]) - F.greatest(begin, s["rise"])
    kept = F.filter(F.transform(tried, lambda s: F.struct(shared(s).alias("shared"), (-s["rise"]).alias("first"), s.alias("sun"))), lambda x: x["shared"] > 0)
    return F.array_max(kept)["sun"]
