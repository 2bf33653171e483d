"""Exact top-k by inner product in a bit-sliced index.

Components are quantised to floor(scale * x). The index is a table of blocks of at most BLOCK rows;
a block keeps, for each attribute, its minimum and the bits of (value - minimum), one bitmap over the
block's rows for each bit.

A query adds up its score for all rows of a block by bitmap arithmetic alone: the product of a query
component and an attribute is the attribute's slices shifted by the set bits of the component's
magnitude (complemented slices, where the component is negative), and all slices of equal weight are
reduced by carry-save adders, from the lowest weight up. The sum's slices are then walked from the
most significant one down: rows with the bit set are in, if they are no more than still wanted, or
else only they remain candidates. What is left at the end are boundary rows with equal scores; they
are resolved by id. The best k of each block meet in one ranking for each query.

Blocks and chunks of queries meet in the cells of a grid: a block goes to all cells of its row, a
chunk to all cells of its column, so every pair meets in one cell, and any number of either spreads
evenly. The grid's size follows the cluster's cores and not the data, so what is moved grows with the
blocks and chunks and not with their product; a cell streams its pairs.

Whole numbers of any size: vectors with a component of LARGE and more in magnitude have blocks of their
own, and whatever does not fit 64 bits is added up in Python's integers.

Defined results: vectors that are null or hold null or non-finite components take no part; shorter
vectors are padded with zeros; rows with equal ids are rows of their own, each query excluding only its
own row; null ids are no queries and come last among ties; scores beyond the range of a long are ranked
exactly and given as its nearest end; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written

SCALE, K, EVERY = 1024, 10, 100
BLOCK, CHUNK, LARGE = 1 << 15, 64, 1 << 30
#: Cells of the grid for each core, about.
CELLS = 6
LONG = np.iinfo(np.int64)

INDEX = "block long, ids array<long>, low binary, width array<int>, slices binary"
QUERY = "chunk string, vec_id array<long>, block array<long>, place array<int>, size int, vectors binary"


def finite(vectors: DataFrame) -> DataFrame:
    """(vec_id, x array<double>) of the vectors that take part."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.col("embedding").isNotNull() & ~F.coalesce(F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(True))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").withColumn("x", x).filter(fine)
    return kept.select("vec_id", "x")


def quantised(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x): as 64-bit integers, or Python's where they do not fit."""
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    if not y.size or np.abs(y).max() < 1 << 62:
        return y.astype(np.int64)
    whole = [int(v) if np.isfinite(v) else int(u) * scale for u, v in zip(x.ravel().tolist(), y.ravel().tolist(), strict=True)]
    return np.array(whole, object).reshape(x.shape)


def _packed(v: np.ndarray) -> bytes:
    return b"q" + v.astype("<i8").tobytes() if v.dtype != object else b"w" + " ".join(map(str, v.ravel())).encode()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i8", offset=1) if data[:1] == b"q" else np.array([int(x) for x in data[1:].split()], object)


def _bitmap(bits: np.ndarray) -> np.ndarray:
    """(rows, n) of 0 and 1 -> (n, words) of 64-bit words."""
    rows, n = bits.shape
    padded = np.zeros((n, -(-rows // 64) * 64), np.uint8)
    padded[:, :rows] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


class Block:
    """Bit slices of up to BLOCK rows: slices[start[d] + j] is bit j of attribute d above its minimum."""

    def __init__(self, ids: np.ndarray, low: np.ndarray, width: np.ndarray, slices: np.ndarray):
        self.ids, self.low, self.width, self.slices = ids, low, width, slices
        self.start = np.cumsum(width) - width

    @classmethod
    def of(cls, ids: list[int | None], vectors: list[np.ndarray], scale: int = SCALE) -> "Block":
        rows = np.zeros((len(vectors), max(map(len, vectors), default=0)))
        for row, v in zip(rows, vectors, strict=True):
            row[: len(v)] = v
        x = quantised(rows, scale)
        low = x.min(0)
        width = np.array([int(v).bit_length() for v in x.max(0) - low], np.int64)
        parts = [_bitmap((((x[:, d] - low[d])[:, None] >> np.arange(width[d])) & 1).astype(np.uint8)) for d in range(x.shape[1]) if width[d]]
        slices = np.concatenate(parts) if parts else np.zeros((0, -(-len(ids) // 64)), np.uint64)
        return cls(np.array([LONG.max if i is None else i for i in ids], np.int64), low, width, slices)  # null ids: last among ties

    def vector(self, row: np.ndarray, size: int) -> np.ndarray:
        """The exact components of some rows, from their bits."""
        bits = (self.slices[:, row >> 6] >> (row & 63).astype(np.uint64)) & np.uint64(1)
        out = np.zeros((len(row), size), np.int64 if self.low.dtype != object else object)
        for d in range(min(size, len(self.low))):
            own = bits[self.start[d] : self.start[d] + self.width[d]].astype(np.int64).astype(out.dtype)
            out[:, d] = self.low[d] + (own << np.arange(self.width[d]).astype(out.dtype)[:, None]).sum(0)
        return out

    def scores(self, q: np.ndarray) -> tuple[int, list[np.ndarray]]:
        """(least, slices): each row's inner product with q is least plus the number that its bits in the slices give."""
        q = q[: len(self.low)]
        low, width = self.low[: len(q)], self.width[: len(q)]
        whole = [int(v) for v in q]
        # for negative components, (2^width - 1) - u is added |q| times instead of u being subtracted
        least = sum(v * int(m) + (v * ((1 << int(w)) - 1) if v < 0 else 0) for v, m, w in zip(whole, low, width, strict=True))
        # each slice of an attribute, at each set bit of the component's magnitude, has a weight
        longest = max((abs(v).bit_length() for v in whole), default=0)
        set_bits = (np.array([abs(v) for v in whole], q.dtype)[:, None] >> np.arange(longest).astype(q.dtype)) & 1 if longest else np.zeros((len(q), 0))
        d, shift = np.nonzero(set_bits.astype(bool))
        n = width[d]
        j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        weight, row, flipped = np.repeat(shift, n) + j, np.repeat(self.start[d], n) + j, np.repeat(q[d] < 0, n)
        order = np.argsort(weight, kind="stable")
        weight, row, mask = weight[order], row[order], np.where(flipped[order], ~np.uint64(0), np.uint64(0))
        top = int(weight[-1]) if len(weight) else -1
        cuts = np.searchsorted(weight, np.arange(top + 2))
        out, carried, level = [], [], 0
        while level <= top or carried:
            at = np.zeros((0, self.slices.shape[1]), np.uint64)
            if level <= top:
                own = slice(cuts[level], cuts[level + 1])
                at = self.slices[row[own]] ^ mask[own, None]
            if carried:
                at = np.concatenate([at, *carried])
            carried = []
            while len(at) > 1:
                n = len(at) // 3
                if n:
                    a, b, c = at[:n], at[n : 2 * n], at[2 * n : 3 * n]
                    half = a ^ b
                    carried.append((a & b) | (half & c))
                    at = np.concatenate([half ^ c, at[3 * n :]])
                else:
                    carried.append(at[:1] & at[1:])
                    at = at[:1] ^ at[1:]
            out.append(at[0] if len(at) else np.zeros(self.slices.shape[1], np.uint64))
            level += 1
        return least, out

    def best(self, q: np.ndarray, k: int, without: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the k best rows, ties to smaller ids; `without` is left out."""
        least, slices = self.scores(q)
        rest = np.zeros(self.slices.shape[1] * 64, np.uint8)
        rest[: len(self.ids)] = 1
        if without is not None:
            rest[without] = 0
        rest = np.packbits(rest, bitorder="little").view(np.uint64)
        sure, wanted = np.zeros_like(rest), k
        for s in reversed(slices):
            among = rest & s
            n = int(np.bitwise_count(among).sum())
            if n <= wanted:
                sure |= among
                wanted -= n
                rest = rest & ~s
            else:
                rest = among
            if not wanted:
                break
        rows = lambda m: np.flatnonzero(np.unpackbits(m.view(np.uint8), bitorder="little"))
        tied = rows(rest) if wanted else np.zeros(0, np.int64)
        chosen = np.concatenate([rows(sure), tied[np.argsort(self.ids[tied], kind="stable")[:wanted]]]).astype(np.int64)
        kind = np.int64 if len(slices) < 62 and abs(least) < 1 << 62 else object
        total = np.full(len(chosen), least, kind)
        for w, s in enumerate(slices):
            total += ((s[chosen >> 6] >> (chosen & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64).astype(kind) << w
        return chosen, total

    @classmethod
    def read(cls, ids: pa.ListScalar, low: bytes, width: list[int], slices: bytes) -> "Block":
        ids = ids.values.to_numpy(zero_copy_only=False)
        return cls(ids, _unpacked(low), np.array(width, np.int64), np.frombuffer(slices, np.uint64).reshape(-1, -(-len(ids) // 64)))


def build_index(vectors: DataFrame, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """The stored index of vectors (vec_id, embedding), a row a block."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held: dict[bool, tuple[list, list]] = {False: ([], []), True: ([], [])}

        def done(ids: list, rows: list) -> pa.RecordBatch:
            b = Block.of(ids, rows, scale)
            row = {"block": (part << 32) + seq, "ids": b.ids.tolist(), "low": _packed(b.low), "width": b.width.tolist(), "slices": b.slices.tobytes()}
            return pa.RecordBatch.from_pylist([row], pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("low", pa.binary()), ("width", pa.list_(pa.int32())), ("slices", pa.binary())]))

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = v.values.to_numpy(zero_copy_only=False)
                ids, rows = held[bool(len(x)) and float(np.abs(x).max()) * scale >= LARGE]
                ids.append(i)
                rows.append(x)
                if len(ids) == block:
                    yield done(ids, rows)
                    ids.clear(), rows.clear()
                    seq += 1
        for ids, rows in held.values():
            if ids:
                yield done(ids, rows)
                seq += 1

    # small input partitions are read together, so that blocks are full; large ones are many anyway
    rows, cores = finite(vectors), vectors.sparkSession.sparkContext.defaultParallelism
    blocks = -(-vectors.count() // block)
    return written(rows.coalesce(max(1, cores, blocks)).mapInArrow(build, INDEX), "index")


def queries_of(index: DataFrame, every: int = EVERY, chunk: int = CHUNK) -> DataFrame:
    """Chunks of queries: the rows of the index whose id is divisible by `every`."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("chunk", pa.string()), ("vec_id", pa.list_(pa.int64())), ("block", pa.list_(pa.int64())), ("place", pa.list_(pa.int32())), ("size", pa.int32()), ("vectors", pa.binary())])
        for batch in batches:
            for block, ids, low, width, slices in zip(*batch.columns, strict=True):
                b = Block.read(ids, low.as_py(), width.as_py(), slices.as_py())
                rows = np.flatnonzero((b.ids % every == 0) & (b.ids != LONG.max))
                for k, at in enumerate(range(0, len(rows), chunk)):
                    own = rows[at : at + chunk]
                    size = len(b.low)
                    yield pa.RecordBatch.from_pylist([{"chunk": f"{block}-{k}", "vec_id": b.ids[own].tolist(), "block": [block.as_py()] * len(own), "place": own.tolist(), "size": size, "vectors": _packed(b.vector(own, size))}], schema)

    return written(index.mapInArrow(take, QUERY), "queries")


def _key(score: int) -> bytes:
    """Orders scores that leave the range of a long; those within it are equal."""
    if LONG.min <= score <= LONG.max:
        return b"\1"
    size = abs(score).bit_length() // 8 + 1
    own = size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return b"\2" + own if score > 0 else b"\0" + bytes(255 - x for x in own)


def _grid(index: DataFrame, queries: DataFrame) -> tuple[int, int]:
    """(rows, columns) of about CELLS cells a core, of the shape that copies the fewest bytes: blocks go to all columns, chunks to all rows."""
    blocks, block_bytes = index.agg(F.count("*"), F.sum(F.length("slices") + 8 * F.size("ids"))).first()
    chunks, chunk_bytes = queries.agg(F.count("*"), F.sum(F.length("vectors"))).first()
    cells = CELLS * index.sparkSession.sparkContext.defaultParallelism
    across = (cells * (chunk_bytes or 1) / (block_bytes or 1)) ** 0.5
    across = int(min(max(across, cells / max(1, blocks), 1), max(1, chunks)))
    return max(1, min(blocks, -(-cells // across))), across


def search(index: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) of every query of a stored table against every block of a stored index."""
    down, across = _grid(index, queries)
    cells = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    filed = index.withColumnRenamed("block", "block_id").withColumn("down", F.pmod(F.xxhash64("block_id"), F.lit(down)).cast("int")).withColumn("across", cells(across))
    asked = queries.withColumnRenamed("block", "own_block").withColumn("across", F.pmod(F.xxhash64("chunk"), F.lit(across)).cast("int")).withColumn("down", cells(down))
    pairs = filed.repartition(down * across, "down", "across").join(asked.repartition(down * across, "down", "across").hint("merge"), ["down", "across"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, b = None, None
        for batch in batches:
            for block, ids, low, width, slices, vec_id, own_block, place, size, vectors in zip(*batch.columns, strict=True):
                block = block.as_py()
                if block != last:  # a block's pairs follow one another
                    last, b = block, Block.read(ids, low.as_py(), width.as_py(), slices.as_py())
                out = []
                for query, home, at, q in zip(vec_id.as_py(), own_block.as_py(), place.as_py(), _unpacked(vectors.as_py()).reshape(-1, size.as_py()) if size.as_py() else np.zeros((len(vec_id), 0), np.int64), strict=True):
                    chosen, total = b.best(q, k, at if home == block else None)
                    out += [(query, home, at, int(v), min(max(int(s), LONG.min), LONG.max), _key(int(s))) for v, s in zip(b.ids[chosen], total, strict=True)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "far" else pa.int64()) for n, c in zip(FOUND, zip(*out, strict=True), strict=True)], names=FOUND)

    found = pairs.select("block_id", "ids", "low", "width", "slices", "vec_id", "own_block", "place", "size", "vectors").mapInArrow(run, "query_id long, home long, place long, id long, score long, far binary")
    by = W.partitionBy("query_id", "home", "place").orderBy(F.col("far").desc(), F.col("score").desc(), "id")
    ranked = found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.when(F.col("id") != LONG.max, F.col("id")).alias("vec_id"), "score")


FOUND = ["query_id", "home", "place", "id", "score", "far"]


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(table(spark, sf_dir, "embeddings"))
    return search(index, queries_of(index))


OP3_SQL = """
WITH q AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS n, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM q a JOIN q b ON a.n <> b.n WHERE a.vec_id % 100 = 0),
ranked AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 10
"""
