"""The published scoring formula as column expressions: validities, weights and points.

Distances are metres and times seconds unless a name says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the sporting code (2026 edition), and the usual parameters of a competition.
NOMINAL_LAUNCH = 0.96
NOMINAL_GOAL = 0.3
DISTANCE_WEIGHT = (0.9, -1.665, 1.713, -0.587)
LAUNCH = (0.0, 0.028, 2.917, -1.944)
TIME = (-0.271, 2.912, -2.098, 0.457)
ARRIVAL = (0.2, 0.037, 0.13, 0.633)
LEADING_RATIO = {"HG": 0.175, "PG": 0.26}
DEFAULTS = {"nominal_distance": 70_000.0, "nominal_time": 5_400.0, "minimum_distance": 5_000.0, "scoring": "HG", "leading": False, "arrival": False}


def cubic(c: tuple[float, ...], x: Column) -> Column:
    return F.lit(c[0]) + x * c[1] + x * x * c[2] + x * x * x * c[3]


def unit(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def launch_validity(flying: Column, present: Column, nominal: float = NOMINAL_LAUNCH) -> Column:
    return F.when(present > 0, unit(cubic(LAUNCH, F.least(F.lit(1.0), flying / (present * nominal))))).otherwise(0.0)


def distance_validity(sum_over_minimum: Column, flying: Column, best: Column, nominal_distance: float, minimum: float, nominal_goal: float = NOMINAL_GOAL) -> Column:
    area = ((1 + nominal_goal) * (nominal_distance - minimum) + F.greatest(F.lit(0.0), nominal_goal * (best - nominal_distance))) / 2
    return F.when((flying > 0) & (area > 0), unit(sum_over_minimum / (flying * area))).otherwise(0.0)


def time_validity(best_time: Column, best_distance: Column, nominal_time: float, nominal_distance: float) -> Column:
    ratio = F.when(best_time.isNotNull(), best_time / nominal_time).otherwise(best_distance / nominal_distance)
    return unit(cubic(TIME, F.least(F.lit(1.0), ratio)))


def weights(goal_ratio: Column, at_ess: Column, scoring: str = "HG", leading: bool = True, arrival: bool = True) -> dict[str, Column]:
    distance = cubic(DISTANCE_WEIGHT, goal_ratio)
    rest = 1 - distance
    arr = rest / 8 if scoring == "HG" and arrival else F.lit(0.0)
    lead = F.lit(0.0) if not leading else rest * LEADING_RATIO[scoring] if scoring == "HG" else F.when(goal_ratio == 0, rest).otherwise(rest * LEADING_RATIO[scoring])
    time = F.greatest(F.lit(0.0), rest - lead - arr)
    if scoring == "HG":  # nobody at the end of the speed section: nothing is handed on
        time, arr = F.when(at_ess == 0, 0.0).otherwise(time), F.when(at_ess == 0, 0.0).otherwise(arr)
    return {"distance": distance, "time": time, "leading": lead, "arrival": arr}


def speed_fraction(time: Column, best: Column) -> Column:
    """Times in seconds; the formula works in hours."""
    t, b = time / 3600, best / 3600
    return F.when(time <= best, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.pow((t - b) / F.sqrt(b), F.lit(5 / 6))))


def arrival_fraction(position: Column, at_ess: Column) -> Column:
    return cubic(ARRIVAL, 1 - (position - 1) / at_ess)


def leading_fraction(coefficient: Column, least: Column) -> Column:
    away = F.cbrt(F.pow(coefficient - least, F.lit(2)) / least)
    return F.when(coefficient.isNull() | (least <= 0), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - away))


def stopped_validity(best_km: Column, mean_km: Column, deviation_km: Column, launch_to_ess_km: Column, landed: Column, launched: Column, at_ess: Column) -> Column:
    spread = F.sqrt(F.greatest((best_km - mean_km) / (launch_to_ess_km - best_km + 1) * F.sqrt(deviation_km / 5), F.lit(0.0)))
    return F.when(at_ess > 0, 1.0).otherwise(F.least(F.lit(1.0), spread + F.pow(landed / launched, F.lit(3))))


def leading_weight_terms() -> list[tuple[float, int]]:
    """(factor, exponent) of the powers of ten that the leading weight (1 - 10^(9q-9))^5 (1 - 10^(-3q))^2 expands to."""
    from math import comb

    return [((-1) ** (j + k) * comb(5, j) * comb(2, k) * 10.0 ** (-9 * j), 9 * j - 3 * k) for j in range(6) for k in range(3)]


def leading_weight_integral(p: Column) -> Column:
    """Integral of the leading weight from 0 to the share p of the speed section that is left."""
    from math import log

    total = F.lit(0.0)
    for factor, e in leading_weight_terms():
        total = total + (p * factor if e == 0 else (F.pow(F.lit(10.0), p * e) - 1) * (factor / (e * log(10))))
    return total


def leading_area(tracks, keys: list[str], time: str, left_km: str, section_km: str):
    """(keys, area) of tracks (keys, time since the first start, km left to the end of the speed section): classic and weighted leading areas.

    The best distance so far only falls; each fall counts with the time at which it was reached.
    """
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys).orderBy(time)
    before = F.least(F.min(left_km).over(w.rowsBetween(W.unboundedPreceding, -1)), F.col(section_km))
    now = F.least(F.coalesce(before, F.col(section_km)), F.col(left_km))
    steps = tracks.select(*keys, time, section_km, F.greatest(F.coalesce(before, F.col(section_km)), F.lit(0.0)).alias("b0"), F.greatest(now, F.lit(0.0)).alias("b1"))
    weighted = F.col("b1") * (leading_weight_integral(F.col("b0") / F.col(section_km)) - leading_weight_integral(F.col("b1") / F.col(section_km))) * F.col(time)
    return steps.groupBy(*keys).agg(
        (F.sum(F.col(time) * (F.col("b0") * F.col("b0") - F.col("b1") * F.col("b1"))) / (1800 * F.first(section_km) * F.first(section_km))).alias("classic"),
        (F.sum(weighted) / (1800 * F.first(section_km))).alias("weighted"),
    )
