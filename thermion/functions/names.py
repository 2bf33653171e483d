"""Names of people: keys and how alike two names are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with marks and the letters they are compared as.
MARKED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿšžčćđłńśźżąęěřůťďňőű"
PLAIN = "aaaaaaceeeeiiiinoooooouuuuyyszccdlnszzaeerutdnou"


def tokens(name: Column) -> Column:
    """Lower-case words without marks."""
    plain = F.translate(F.lower(F.coalesce(name, F.lit(""))), MARKED, PLAIN)
    return F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def affinity(a: Column, b: Column) -> Column:
    """2: the same words in any order; 1: the same last word and one first word begins with the other's, an initial; 0: neither."""
    x, y = tokens(a), tokens(b)
    some = (F.size(x) > 0) & (F.size(y) > 0)
    last = F.get(x, F.size(x) - 1) == F.get(y, F.size(y) - 1)
    p, q = F.get(x, F.lit(0)), F.get(y, F.lit(0))
    initial = (F.size(x) > 1) & (F.size(y) > 1) & (((F.length(p) == 1) & q.startswith(p)) | ((F.length(q) == 1) & p.startswith(q)))
    return F.when(some & (F.array_sort(x) == F.array_sort(y)), 2).when(some & last & initial, 1).otherwise(0)
