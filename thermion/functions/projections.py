"""The transverse Mercator grid of sixty zones, there and back, as column expressions: series in the ellipsoid's third flattening."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import FLATTENING, A

N = FLATTENING / (2 - FLATTENING)
#: Radius of the circle as long as a meridian, and the root of the eccentricity's square.
MEAN = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
E = 2 * N**0.5 / (1 + N)
# Fixed values of the grid: scale on the middle meridian, metres added east, and north in the southern half.
SCALE, FALSE_EAST, FALSE_NORTH = 0.9996, 500_000.0, 10_000_000.0
BANDS = "CDEFGHJKLMNPQRSTUVWX"
# Fixed coefficients of the published series, to the fourth power: forward, back, and from conformal to geodetic latitude.
FORWARD = (N / 2 - 2 / 3 * N**2 + 5 / 16 * N**3 + 41 / 180 * N**4, 13 / 48 * N**2 - 3 / 5 * N**3 + 557 / 1440 * N**4, 61 / 240 * N**3 - 103 / 140 * N**4, 49561 / 161280 * N**4)
BACK = (N / 2 - 2 / 3 * N**2 + 37 / 96 * N**3 - 1 / 360 * N**4, 1 / 48 * N**2 + 1 / 15 * N**3 - 437 / 1440 * N**4, 17 / 480 * N**3 - 37 / 840 * N**4, 4397 / 161280 * N**4)
LATITUDE = (2 * N - 2 / 3 * N**2 - 2 * N**3 + 116 / 45 * N**4, 7 / 3 * N**2 - 8 / 5 * N**3 - 227 / 45 * N**4, 56 / 15 * N**3 - 136 / 35 * N**4, 4279 / 630 * N**4)


def zone_of(lon: Column) -> Column:
    return F.least(F.greatest(F.floor((lon + 180) / 6) + 1, F.lit(1)), F.lit(60)).cast("int")


def band_of(lat: Column) -> Column:
    """The letter of the eight degrees of latitude."""
    i = F.least(F.greatest(F.floor((lat + 80) / 8), F.lit(0)), F.lit(len(BANDS) - 1)).cast("int")
    return F.substr(F.lit(BANDS), i + 1, F.lit(1))


def _middle(zone: Column) -> Column:
    return zone * 6 - 183


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once however often body names it."""
    return F.transform(F.array(value), body)[0]


def to_grid(lat: Column, lon: Column) -> dict[str, Column]:
    """zone, band, easting, northing of a place in degrees."""
    zone = zone_of(lon)

    def cylinder(g: Column) -> Column:
        x, y = F.atan2(g["t"], F.cos(g["dl"])), F.atanh(F.sin(g["dl"]) / F.sqrt(1 + g["t"] * g["t"]))
        return F.struct(x.alias("x"), y.alias("y"))

    def metres(p: Column) -> Column:
        x, y = p["x"], p["y"]
        east, north = y, x
        for j, c in enumerate(FORWARD, 1):
            east, north = east + c * F.cos(x * (2 * j)) * F.sinh(y * (2 * j)), north + c * F.sin(x * (2 * j)) * F.cosh(y * (2 * j))
        return F.struct((FALSE_EAST + SCALE * MEAN * east).alias("easting"), (SCALE * MEAN * north).alias("northing"))

    s = F.sin(F.radians(lat))
    globe = F.struct(F.sinh(F.atanh(s) - E * F.atanh(s * E)).alias("t"), F.radians(lon - _middle(zone)).alias("dl"))
    placed = _once(_once(globe, cylinder), metres)
    return {"zone": zone, "band": band_of(lat), "easting": placed["easting"], "northing": placed["northing"] + F.when(lat < 0, FALSE_NORTH).otherwise(0.0)}


def from_grid(zone: Column, northern: Column, easting: Column, northing: Column) -> Column:
    """struct<lat, lon> in degrees."""

    def turned(p: Column) -> Column:
        u, v = p["x"], p["y"]
        for j, c in enumerate(BACK, 1):
            u, v = u - c * F.sin(p["x"] * (2 * j)) * F.cosh(p["y"] * (2 * j)), v - c * F.cos(p["x"] * (2 * j)) * F.sinh(p["y"] * (2 * j))
        return F.struct(u.alias("u"), v.alias("v"))

    def globe(g: Column) -> Column:
        return F.struct(F.asin(F.sin(g["u"]) / F.cosh(g["v"])).alias("q"), F.degrees(F.atan2(F.sinh(g["v"]), F.cos(g["u"]))).alias("dl"))

    def geodetic(g: Column) -> Column:
        lat = g["q"]
        for j, c in enumerate(LATITUDE, 1):
            lat = lat + c * F.sin(g["q"] * (2 * j))
        return F.struct(F.degrees(lat).alias("lat"), g["dl"].alias("lon"))

    scaled = F.struct(((northing - F.when(northern, 0.0).otherwise(FALSE_NORTH)) / (SCALE * MEAN)).alias("x"), ((easting - FALSE_EAST) / (SCALE * MEAN)).alias("y"))
    place = _once(_once(_once(scaled, turned), globe), geodetic)
    return F.struct(place["lat"].alias("lat"), (_middle(zone) + place["lon"]).alias("lon"))
