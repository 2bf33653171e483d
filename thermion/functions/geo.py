"""Geodesy: expressions on the sphere and in local metres, and the ellipsoid's inverse and direct problem.

The ellipsoid needs iteration: a vectorised pandas function runs it for whole batches, with a mask
of rows still moving.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# WGS84
A, B = 6378137.0, 6356752.314245
FLATTENING = 1 / 298.257223563


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in degrees, -180 to 180."""
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.degrees(F.atan2(F.sin(d) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d)))


def metres_per_degree(lat: Column) -> tuple[Column, Column]:
    """Metres of a degree of latitude and of longitude at lat, on the ellipsoid."""
    e2 = FLATTENING * (2 - FLATTENING)
    w = 1 - e2 * F.pow(F.sin(F.radians(lat)), F.lit(2))
    return F.radians(F.lit(1.0)) * A * (1 - e2) / F.pow(w, F.lit(1.5)), F.radians(F.lit(1.0)) * A * F.cos(F.radians(lat)) / F.sqrt(w)


def east_north(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Metres east and north of a nearby origin."""
    north, east = metres_per_degree(lat0)
    return (lon - lon0) * east, (lat - lat0) * north


def inverse(lat1, lon1, lat2, lon2, rounds: int = 100, close: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """(metres, initial azimuth in degrees 0 to 360) by the ellipsoid's inverse formula; NaN for null ends.

    Near the antipode the iteration does not settle; such rows get the closed first-order formula.
    """
    lat1, lon1, lat2, lon2 = (np.asarray(x, float) for x in (lat1, lon1, lat2, lon2))
    u1, u2 = (np.arctan((1 - FLATTENING) * np.tan(np.radians(x))) for x in (lat1, lat2))
    dl = np.radians(lon2 - lon1)
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam, moving = dl.copy(), np.isfinite(dl + u1 + u2)
    with np.errstate(all="ignore"):
        for _ in range(rounds):
            sl, cl = np.sin(lam), np.cos(lam)
            ss = np.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl)
            cs = s1 * s2 + c1 * c2 * cl
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss > 0, c1 * c2 * sl / ss, 0.0)
            ca2 = 1 - sa * sa
            c2m = np.where(ca2 > 0, cs - 2 * s1 * s2 / ca2, 0.0)
            c = FLATTENING / 16 * ca2 * (4 + FLATTENING * (4 - 3 * ca2))
            new = dl + (1 - c) * FLATTENING * sa * (sigma + c * ss * (c2m + c * cs * (2 * c2m * c2m - 1)))
            step, lam = np.abs(new - lam), np.where(moving, new, lam)
            moving = moving & (step > close)
            if not moving.any():
                break
        sl, cl = np.sin(lam), np.cos(lam)
        v = ca2 * (A * A - B * B) / (B * B)
        big = 1 + v / 16384 * (4096 + v * (-768 + v * (320 - 175 * v)))
        small = v / 1024 * (256 + v * (-128 + v * (74 - 47 * v)))
        d = small * ss * (c2m + small / 4 * (cs * (2 * c2m * c2m - 1) - small / 6 * c2m * (4 * ss * ss - 3) * (4 * c2m * c2m - 3)))
        metres = np.where(ss == 0, 0.0, B * big * (sigma - d))
        azimuth = np.degrees(np.arctan2(c2 * sl, c1 * s2 - s1 * c2 * cl)) % 360
    gone = ~np.isfinite(dl + u1 + u2)
    unsettled = (moving | (np.abs(lam) > np.pi)) & ~gone
    if unsettled.any():
        metres = np.where(unsettled, first_order(lat1, lon1, lat2, lon2), metres)
    return np.where(gone, np.nan, metres), np.where(gone, np.nan, azimuth)


def first_order(lat1, lon1, lat2, lon2) -> np.ndarray:
    """Metres on the ellipsoid to first order in its flattening: the great circle's length and Lambert's two corrections."""
    p, q = (np.radians(lat1) + np.radians(lat2)) / 2, (np.radians(lat1) - np.radians(lat2)) / 2
    half = np.radians(np.asarray(lon2, float) - lon1) / 2
    sp, cp, sq, cq = np.sin(p) ** 2, np.cos(p) ** 2, np.sin(q) ** 2, np.cos(q) ** 2
    sh, ch = np.sin(half) ** 2, np.cos(half) ** 2
    s, c = sq * ch + cp * sh, cq * ch + sp * sh
    with np.errstate(all="ignore"):
        angle = np.arctan2(np.sqrt(s), np.sqrt(c))
        ratio = np.sqrt(s * c) / angle
        metres = 2 * angle * A * (1 + FLATTENING * ((3 * ratio - 1) / (2 * c) * sp * cq - (3 * ratio + 1) / (2 * s) * cp * sq))
    return np.where((s == 0) | (c == 0), 0.0, metres)


def direct(lat, lon, azimuth, metres, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(lat, lon) reached from a point by azimuth (degrees) and distance."""
    lat, lon, azimuth, metres = (np.asarray(x, float) for x in (lat, lon, azimuth, metres))
    a1, tu = np.radians(azimuth), (1 - FLATTENING) * np.tan(np.radians(lat))
    cu, su = 1 / np.hypot(1, tu), tu / np.hypot(1, tu)
    sigma1 = np.arctan2(tu, np.cos(a1))
    sa = cu * np.sin(a1)
    ca2 = 1 - sa * sa
    v = ca2 * (A * A - B * B) / (B * B)
    big = 1 + v / 16384 * (4096 + v * (-768 + v * (320 - 175 * v)))
    small = v / 1024 * (256 + v * (-128 + v * (74 - 47 * v)))
    sigma = metres / (B * big)
    for _ in range(rounds):
        c2m, ss, cs = np.cos(2 * sigma1 + sigma), np.sin(sigma), np.cos(sigma)
        d = small * ss * (c2m + small / 4 * (cs * (2 * c2m**2 - 1) - small / 6 * c2m * (4 * ss**2 - 3) * (4 * c2m**2 - 3)))
        new = metres / (B * big) + d
        if np.nanmax(np.abs(new - sigma), initial=0) < 1e-12:
            break
        sigma = new
    c2m, ss, cs = np.cos(2 * sigma1 + sigma), np.sin(sigma), np.cos(sigma)
    t = su * ss - cu * cs * np.cos(a1)
    lat2 = np.arctan2(su * cs + cu * ss * np.cos(a1), (1 - FLATTENING) * np.hypot(sa, t))
    lam = np.arctan2(ss * np.sin(a1), cu * cs - su * ss * np.cos(a1))
    c = FLATTENING / 16 * ca2 * (4 + FLATTENING * (4 - 3 * ca2))
    dl = lam - (1 - c) * FLATTENING * sa * (sigma + c * ss * (c2m + c * cs * (2 * c2m**2 - 1)))
    return np.degrees(lat2), (lon + np.degrees(dl) + 540) % 360 - 180


@F.pandas_udf(T.DoubleType())
def ellipsoid_metres(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    metres = inverse(lat1, lon1, lat2, lon2)[0]
    return pd.Series(metres).where(~np.isnan(metres), None)
