"""Statistics of small samples as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two-sided 5 % points of the normal distribution and of Student's t with 1 and 2 degrees of freedom.
Z = 1.959964
T1, T2 = 12.706, 4.303


def t_critical(df: Column) -> Column:
    """Two-sided 5 % point of Student's t; from 3 degrees on by the Cornish-Fisher expansion to the third order."""
    terms = ((Z**3 + Z) / 4, (5 * Z**5 + 16 * Z**3 + 3 * Z) / 96, (3 * Z**7 + 19 * Z**5 + 17 * Z**3 - 15 * Z) / 384)
    far = F.lit(Z)
    for i, c in enumerate(terms):
        far = far + c / F.pow(df, F.lit(i + 1))
    return F.when(df == 1, T1).when(df == 2, T2).otherwise(far)


def noise_floor(n: Column) -> Column:
    """|rank correlation| that shuffled ranks of n pairs exceed one time in twenty; null below 3 pairs."""
    t = t_critical(n - 2)
    return F.when(n >= 3, F.least(F.lit(1.0), t / F.sqrt(n - 2 + t * t)))


def verdict(size: Column, n: Column) -> Column:
    """What a rank correlation of that absolute size over n pairs says."""
    return F.when(n < 8, "n too small").when(size < noise_floor(n), "within noise").when(size >= 0.5, "strong").when(size >= 0.3, "moderate").otherwise("weak")
