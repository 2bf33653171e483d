"""Best-fit packing of token sequences by patterns.

Documents become pieces of at most `capacity` tokens; only longer documents are cut. Packing needs
no more of a piece than its length, so it works on the histogram of lengths (at most `capacity`
rows, whatever the input):

1. enumerate patterns of one to three lengths that fill a sequence exactly;
2. fit repeat counts to the histogram by non-negative least squares (projected gradient);
3. round them down, never above what the histogram still holds;
4. pack the residual counts best-fit, longest first, whole counts at a time.

The result is a plan: patterns with repeat counts. Pieces of a length are numbered and take that
length's places in the plan in order. Numbering is in two steps, so no task needs all pieces of one
length: pieces of (length, bucket) are ranked, and buckets of a length are added up; the number of
buckets of a length follows its count in the histogram.

Defined results: null text is empty and gives one piece, the end id; null and repeated ids are rows
like any other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written
from .tokens import default_path, encoded

CAPACITY, END_ID = 2048, 0
#: Pieces that one task ranks at once: at most, and at least where the table has so many.
RANKED, FEW = 50_000, 256
#: Exact triples that take part in the fit, at most: the most frequent lengths' (a bound of the fit; what it leaves is packed best-fit).
TRIPLES = 400_000
#: Steps of the projected gradient.
STEPS = 150

Plan = list[tuple[tuple[int, ...], int]]


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of docs (doc_id, text)."""
    tokenizer, end, width = tokenizer or default_path(), struct.pack("<I", end_id), 4 * capacity
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded(batch.column(1).to_pylist(), tokenizer), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), width)):
                    own = ids[at : at + width]
                    rows.append((doc_id, k, at // 4, len(own) // 4, zlib.crc32(own)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _patterns(hist: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of three lengths, 0 for none, that add up to capacity; only of lengths that occur."""
    have = np.flatnonzero(hist)
    has = hist > 0
    two = have[(have * 2 >= capacity) & (have < capacity)]
    two = two[has[capacity - two]]
    out = [np.stack([two, capacity - two, 0 * two], 1)]
    common = have[np.argsort(-hist[have], kind="stable")][: int((6 * TRIPLES) ** 0.5)]
    common = np.sort(common[common < capacity])[::-1]
    for a in common:
        b = common[(common <= a) & (common < capacity - a)]
        c = capacity - a - b
        keep = (c <= b) & has[c]
        out.append(np.stack([np.full(keep.sum(), a), b[keep], c[keep]], 1))
    return np.concatenate(out)


def _fit(patterns: np.ndarray, hist: np.ndarray) -> np.ndarray:
    """Non-negative least squares of repeat counts by projected gradient with momentum; A is given by the patterns' lengths."""
    h = hist.astype(float).copy()
    h[0] = 0
    used = lambda x: np.bincount(patterns.ravel(), np.repeat(x, patterns.shape[1]), len(h)) * (np.arange(len(h)) > 0)
    back = lambda r: np.where(patterns > 0, r[patterns], 0).sum(1)
    bound = back(used(np.ones(len(patterns)))).max()  # largest row sum of A'A, an upper bound of its norm
    # each pattern's own bound makes the steps of rare lengths longer than those of crowded ones
    step = 1 / np.maximum(back(used(np.ones(len(patterns)))), 1) if bound else 1
    x = y = np.zeros(len(patterns))
    for k in range(STEPS):
        new = np.maximum(0, y - step * back(used(y) - h))
        y = np.maximum(0, new + k / (k + 3) * (new - x))
        x = new
    return x


def plan(hist: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """Patterns with repeat counts that use up hist (pieces by length, index 0 to capacity) exactly."""
    left = hist.astype(np.int64).copy()
    out: Plan = []
    if left[capacity]:
        out.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    patterns = _patterns(left, capacity)
    if len(patterns):
        x = _fit(patterns, left)
        for i in np.argsort(-x, kind="stable"):
            if (n := int(x[i])) < 1:
                break
            lengths, times = np.unique(patterns[i][patterns[i] > 0], return_counts=True)
            if (n := min(n, *(left[lengths] // times).tolist())) > 0:
                left[lengths] -= n * times
                out.append((tuple(sorted(map(int, np.repeat(lengths, times)), reverse=True)), n))
    return out + _best_fit(left, capacity)


def _best_fit(left: np.ndarray, capacity: int) -> Plan:
    """Best-fit decreasing on counts: the fullest sequences that still have room take pieces of a length, as many at once as there are."""
    free: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]
    for length in range(capacity, 0, -1):
        n, room = int(left[length]), length
        while n:
            while room <= capacity and not free[room]:
                room += 1
            if room > capacity:
                each = min(capacity // length, n)
                full, rest = divmod(n, each)
                for size, count in ((each, full), (rest, 1)):
                    if size and count:
                        free[capacity - size * length].append(((length,) * size, count))
                break
            pattern, count = free[room].pop()
            took = min(n, count)
            if took < count:
                free[room].append((pattern, count - took))
            free[room - length].append(((*pattern, length), took))
            n -= took
            room = max(length, room - length) if room - length >= length else room
    return [x for own in free for x in own]


def _places(plan: Plan, capacity: int) -> dict[str, np.ndarray]:
    """Runs of places by (length, first rank): how pieces of a length fill the plan in order of rank."""
    rows, first, seen = [], 0, np.zeros(capacity + 1, np.int64)
    for pattern, n in plan:
        offset = 0
        for length in pattern:
            rows.append((length, int(seen[length]), first, offset))
            seen[length] += n
            offset += length
        first += n
    rows.sort()
    return {k: np.array(v, np.int64) for k, v in zip(("length", "rank", "sequence", "offset"), zip(*rows, strict=True), strict=True)} if rows else {}


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """parts (a stored table with doc_id, piece, length) with sequence_id and offset."""
    hist = np.zeros(capacity + 1, np.int64)
    for length, n in parts.groupBy("length").count().collect():  # at most `capacity` rows
        hist[length] = n
    runs = _places(plan(hist, capacity), capacity)
    # several buckets a partition, so that no length makes a task long
    each = max(FEW, min(RANKED, int(hist.sum()) // (8 * int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    buckets = F.element_at(F.lit([int(-(-n // each)) or 1 for n in hist]), F.col("length").cast("int") + 1)
    dealt = parts.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), buckets).cast("long"))
    totals = dealt.groupBy("length", "_bucket").count()
    before = W.partitionBy("length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)
    base = totals.select("length", "_bucket", (F.sum("count").over(before) - F.col("count")).alias("_base"))
    rank = F.row_number().over(W.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = dealt.withColumn("_rank", rank.cast("long")).join(base, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_base")).drop("_bucket", "_base")
    names = ranked.columns
    sent = parts.sparkSession.sparkContext.broadcast(runs)  # three rows a pattern at most: TRIPLES bounds it

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = sent.value
        stride = int(runs["rank"].max()) + 1 if runs else 1
        starts = runs["length"] * stride + runs["rank"] if runs else None
        for batch in batches:
            if not batch.num_rows:
                continue
            length, own = (batch.column(names.index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            run = np.searchsorted(starts, length * stride + np.minimum(own, stride - 1), "right") - 1
            more = [pa.array(runs["sequence"][run] + own - runs["rank"][run]), pa.array(runs["offset"][run])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long").drop("_rank")


def op9_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = written(pieces(table(spark, sf_dir, "documents")), "pieces")
    return pack(parts).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
