"""Document fingerprints from closed syncmers, with positional matching.

A text is cut into units of at most UNIT letters of a word. A run of K units is an anchor if the
least hash among its runs of S units is that of the first or of the last one: that depends on the
run alone, so a passage has the same anchors wherever it stands. The fingerprint keeps, of all
anchors, the KEPT smallest hashes with the place of their first occurrence, in order of place.

Likeness of two fingerprints: of the KEPT smallest hashes of both together, the share that both have
at one shift of places (within SHIFT units).

The KEPT hashes are what a fingerprint is, a bottom sketch of the text's anchors whatever its length, and
not a bound on candidates: likeness is defined on the sketches, so nothing is left to a further way.

The next document is found without a global order in one task: ids are dealt to ranges by
quantiles (one id that holds many rows, and null ids, to ranges by the text's hash), each range also gets
the first row of the next one as a guest, and the window runs within ranges.

Defined results: null text is empty; texts without an anchor have their whole sequence of units as
the only one, so equal texts have equal fingerprints; ties of equal ids are ordered by the hash of
the text; null ids come last; a single document is its own next; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import let, table, written

UNIT, K, S, KEPT, SHIFT = 4, 5, 2, 48, 64
_PLACE = 31  # bits of a place in a packed anchor: no text has more units
_MOST = (1 << _PLACE) - 1
#: A range of one id, or of null ids, is cut by this many top bits of the text's hash.
_CUT = 8


def anchors(text: Column) -> Column:
    """The kept anchors of a text, ascending: hash (32 bits) and place (31 bits) in one long."""

    def of_units(h: Column) -> Column:
        n = F.size(h)

        def of_runs(s: Column) -> Column:
            inner = lambda i: F.least(*[s[i + j] for j in range(1, K - S)])
            places = F.filter(F.sequence(F.lit(0), n - K), lambda i: F.least(s[i], s[i + K - S]) <= inner(i))
            packed = lambda i: F.shiftleft(F.shiftrightunsigned(F.xxhash64(*[s[i + j] for j in range(K - S + 1)]), 32), _PLACE) + i
            return let(F.sort_array(F.transform(places, packed)), first_of_each)

        runs = F.transform(F.sequence(F.lit(0), n - S), lambda i: F.xxhash64(*[h[i + j] for j in range(S)]))
        whole = F.array(F.shiftleft(F.shiftrightunsigned(F.xxhash64(h), 32), _PLACE))
        return F.when(n < K, whole).otherwise(let(let(runs, of_runs), lambda a: F.when(F.size(a) > 0, a).otherwise(whole)))

    def first_of_each(a: Column) -> Column:
        new = F.filter(a, lambda x, i: (i == 0) | (F.shiftright(x, _PLACE) != F.shiftright(a[F.greatest(i - 1, F.lit(0))], _PLACE)))
        return F.slice(new, 1, KEPT)

    units = F.transform(F.regexp_extract_all(text, F.lit(rf"[^\x20\x09-\x0D]{{1,{UNIT}}}"), 0), lambda u: F.xxhash64(u))
    return let(units, of_units)


def spelled(a: Column) -> Column:
    """A fingerprint as a string: 8 hex digits of the hash and 8 of the place for each anchor, in order of place."""
    by_place = F.array_sort(F.transform(a, lambda x: F.shiftleft(x.bitwiseAND(_MOST), 32) + F.shiftright(x, _PLACE)))
    digits = F.transform(by_place, lambda x: F.concat(F.lpad(F.hex(x.bitwiseAND(0xFFFFFFFF)), 8, "0"), F.lpad(F.hex(F.shiftright(x, 32)), 8, "0")))
    return F.lower(F.array_join(digits, ""))


def likeness(a: Column, b: Column) -> Column:
    """Likeness (0 to 1) of two fingerprints (arrays of packed anchors)."""
    hashes = lambda x: F.transform(x, lambda v: F.shiftright(v, _PLACE))
    place = lambda v: v.bitwiseAND(_MOST)

    def shared(every: Column, of_b: Column) -> Column:
        least = F.slice(F.array_sort(every), 1, KEPT)
        last = F.array_max(least)
        both = F.filter(a, lambda v: (F.shiftright(v, _PLACE) <= last) & F.map_contains_key(of_b, F.shiftright(v, _PLACE)))
        shifts = F.transform(both, lambda v: place(v) - F.element_at(of_b, F.shiftright(v, _PLACE)))
        most = let(shifts, lambda d: F.array_max(F.transform(d, lambda x: F.size(F.filter(d, lambda y: F.abs(x - y) <= SHIFT)))))
        return F.coalesce(most, F.lit(0)) / F.size(least)

    of_b = F.map_from_arrays(hashes(b), F.transform(b, place))
    differ = let(F.array_union(hashes(a), hashes(b)), lambda u: let(of_b, lambda m: shared(u, m)))
    return F.when(a == b, 1.0).otherwise(differ)


def _ranges(docs: DataFrame) -> Column:
    """Number of the range of (doc_id, text_hash): ids descending, null ids last, then hashes ascending. Ids that several quantiles fall on, and null ids, have ranges of their own, cut by hash."""
    n = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col("doc_id").cast("double").alias("doc_id"))
    found = ids.approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (4 * n))
    often = {x for x, k in Counter(found).items() if k > 1}
    cuts = sorted({*found, *(math.nextafter(x, math.inf) for x in often)})
    bucket = _search(F.col("doc_id").cast("double"), cuts)
    # buckets count down from the highest cut: an id on cuts[i] alone is in bucket len(cuts) - i - 1
    alone = [len(cuts) - 1 - i for i, x in enumerate(cuts) if x in often] + [len(cuts) + 1]
    by_hash = F.shiftright("text_hash", 64 - _CUT) + (1 << (_CUT - 1))
    return let(bucket, lambda b: (b * (1 << _CUT) + F.when(b.isin(alone), by_hash).otherwise(0)).cast("int"))


def _search(x: Column, cuts: list[float]) -> Column:
    """Number of the cuts above x, by binary search in nested comparisons; null: one more than all."""
    found = F.lit(0)
    at, steps = F.lit(cuts) if cuts else None, len(cuts).bit_length()
    def further(size: int):
        # cuts ascend: skip `size` of them if the last of those is at most x
        return lambda f: F.when((f + size <= len(cuts)) & (F.get(at, f + size - 1) <= x), f + size).otherwise(f)

    for step in reversed(range(steps)):
        found = let(found, further(1 << step))
    return F.when(x.isNull(), len(cuts) + 1).otherwise(len(cuts) - found).cast("int")


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_chars, anchors, next_text, next_anchors): next by descending doc_id, after the last the first."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("text_hash", F.xxhash64("text"))
    rows = rows.withColumn("bucket", _ranges(rows))
    # descending ids without negation: the complement of a long reverses its order
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.bitwise_not(F.col("doc_id").cast("long")).alias("down"), "text_hash")
    firsts = rows.groupBy("bucket").agg(F.min(place).alias("f"))  # a row a range
    last = F.max("bucket").over(W.partitionBy())
    goes_to = F.coalesce(F.lag("bucket").over(W.orderBy("bucket")), last)
    guests = written(firsts.select(F.bitwise_not(F.col("f.down")).alias("first_id"), F.col("f.text_hash").alias("first_hash"), goes_to.alias("goes_to")), "guests")
    shown = lambda d, bucket, guest: d.select("doc_id", "text", "text_hash", bucket.alias("bucket"), F.lit(guest).alias("guest"))
    visits = rows.join(guests, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash"))).dropDuplicates(["goes_to"])
    every = shown(rows, F.col("bucket"), 0).union(shown(visits, F.col("goes_to"), 1))
    marked = every.select("*", anchors(F.col("text")).alias("anchors"))
    w = W.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), "text_hash")
    led = marked.select("*", F.lead("text").over(w).alias("next_text"), F.lead("anchors").over(w).alias("next_anchors")).filter("guest = 0")
    return led.select("doc_id", "text", F.length("text").cast("long").alias("n_chars"), "anchors", "next_text", "next_anchors")


def op7_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half))
    out = docs.select("doc_id", "n_chars", "anchors", "next_anchors", edited.alias("edited")).withColumn("edited_anchors", anchors(F.col("edited")))
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        spelled(F.col("anchors")).alias("fingerprint"),
        spelled(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"),
        likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"),
    )
