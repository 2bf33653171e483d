"""Sorted-string-table shards of token ids, and lookups in them.

A shard holds documents in ascending key order:

    header   b"TSST1\\n"
    blocks   zstd frames; entries of (shared key bytes, further key bytes, value bytes as varints,
             further key bytes, value); a key is stored whole at the start of a block only
    index    a row for each block: (first key, offset, size, entries) - sparse: binary-searched
    bloom    double-hashed bits over all keys
    footer   fixed size: places of index and bloom, counts, smallest and largest key, item size, magic

A key is b"\\0" for a null id, or b"\\1" and the id as 8 big-endian bytes with its sign bit flipped,
so byte order is ascending id order, nulls first. A value is the ids as little-endian unsigned
16-bit integers where the tokenizer's vocabulary and the end id allow, else 32-bit.

Writing: documents are range-partitioned by (id, hash of the text) - equal ids, however many, spread
over partitions - sorted within them and streamed into shards of a bounded size, each under a new
name on shared storage; only shards that the returned manifest names count, so a repeated task
leaves at most an unused file. Reading streams block by block. No task holds more than a block (or
one document) of a shard.

Defined results: null text is empty; null ids come first; rows with equal ids are all kept, in order
of their text's hash; an empty table gives an empty manifest; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh_path, table, written
from .tokens import default_path, encoded, item_size

MAGIC = b"TSST1\n"
FOOTER = struct.Struct("<QQQQQQHH9s9sB6s")
BLOOM_BITS, BLOOM_HASHES = 10, 7
END_ID = 2
#: Keys at which lookups are cut into strips, at most.
POINTS = 4096
MANIFEST = "path string, part int, seq int, docs long, tokens long, min_key binary, max_key binary"


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class ShardWriter:
    """add(key, ids) in key order, then close()."""

    def __init__(self, path: str, item: int, block_bytes: int):
        system, name = _filesystem(path)
        system.create_dir(name.rpartition("/")[0], recursive=True)
        self.out, self.path, self.item, self.block_bytes = system.open_output_stream(name), path, item, block_bytes
        self.zstd = zstandard.ZstdCompressor(level=1)
        self.block, self.held, self.entries, self.first, self.last = [], 0, 0, b"", b""
        self.index: list[tuple[bytes, int, int, int]] = []
        self.hashes: list[int] = []
        self.at = self.docs = self.tokens = 0
        self.min_key = b""
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, key: bytes, ids: bytes) -> None:
        """ids: as little-endian 32-bit integers."""
        value = ids if self.item == 4 else self._narrow(np.frombuffer(ids, "<u4"))
        shared = 0
        if self.entries:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        self.block.append(_varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:])
        self.block.append(value)
        self.held += len(value) + len(key)
        self.entries += 1
        self.min_key = self.min_key or key
        self.last = key
        self.hashes.append(xxhash.xxh64_intdigest(key))
        self.docs += 1
        self.tokens += len(ids) // 4
        if self.held >= self.block_bytes:
            self._flush()

    @staticmethod
    def _narrow(ids: np.ndarray) -> bytes:
        if len(ids) and ids.max() >= 1 << 16:
            raise ValueError(f"id {ids.max()} takes more than 16 bits")
        return ids.astype("<u2").tobytes()

    def _flush(self) -> None:
        if self.entries:
            data = self.zstd.compress(b"".join(self.block))
            self.index.append((self.first, self.at, len(data), self.entries))
            self._put(data)
            self.block, self.held, self.entries = [], 0, 0

    def close(self) -> dict:
        self._flush()
        index_at = self.at
        self._put(b"".join(struct.pack("<B", len(k)) + k + struct.pack("<QQQ", *x) for k, *x in self.index))
        bloom_at, m = self.at, max(64, self.docs * BLOOM_BITS)
        bits = np.zeros((m + 7) // 8, np.uint8)
        h = np.array(self.hashes, np.uint64)
        for i in range(BLOOM_HASHES):
            at = ((h >> np.uint64(32)) + np.uint64(i) * (h & np.uint64(0xFFFFFFFF))) % np.uint64(m)
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8))
        self._put(bits.tobytes())
        self._put(FOOTER.pack(index_at, bloom_at - index_at, bloom_at, m, self.docs, self.tokens, len(self.min_key), len(self.last), self.min_key, self.last, self.item, MAGIC))
        self.out.close()
        return {"path": self.path, "docs": self.docs, "tokens": self.tokens, "min_key": self.min_key, "max_key": self.last}


class ShardReader:
    """Footer at once; index, Bloom filter and blocks on demand."""

    def __init__(self, path: str):
        system, name = _filesystem(path)
        self.file, self.path = system.open_input_file(name), path
        size = self.file.size()
        f = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if f[-1] != MAGIC:
            raise ValueError(f"{path} is no shard")
        self.index_at, self.index_size, self.bloom_at, self.bloom_bits, self.docs, self.tokens = f[:6]
        self.min_key, self.max_key, self.item = f[8][: f[6]], f[9][: f[7]], f[10]
        self._index: list[tuple[bytes, int, int, int]] | None = None
        self._bloom: bytes | None = None

    def index(self) -> list[tuple[bytes, int, int, int]]:
        if self._index is None:
            data, at, self._index = self.file.read_at(self.index_size, self.index_at), 0, []
            while at < len(data):
                n = data[at]
                self._index.append((data[at + 1 : at + 1 + n], *struct.unpack_from("<QQQ", data, at + 1 + n)))
                at += 25 + n
        return self._index

    def may_hold(self, key: bytes) -> bool:
        if self._bloom is None:
            self._bloom = self.file.read_at((self.bloom_bits + 7) // 8, self.bloom_at)
        h = xxhash.xxh64_intdigest(key)
        places = (((h >> 32) + i * (h & 0xFFFFFFFF)) % self.bloom_bits for i in range(BLOOM_HASHES))
        return all(self._bloom[p >> 3] >> (p & 7) & 1 for p in places)

    def block(self, at: int, size: int) -> Iterator[tuple[bytes, bytes]]:
        data, at, key = zstandard.ZstdDecompressor().decompress(self.file.read_at(size, at)), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            more, at = _read_varint(data, at)
            length, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + more]
            at += more
            yield key, data[at : at + length]
            at += length

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for _, at, size, _ in self.index():
            yield from self.block(at, size)

    def ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, "<u2" if self.item == 2 else "<u4")

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """All values of the id: footer range, Bloom filter, binary search, then its blocks."""
        key = key_of(doc_id)
        if not self.docs or not self.min_key <= key <= self.max_key or not self.may_hold(key):
            return []
        firsts = [x[0] for x in self.index()]
        b = max(0, bisect_right(firsts, key) - 1)
        while b and firsts[b] == key:  # equal ids may begin in an earlier block
            b -= 1
        found = []
        while b < len(firsts) and firsts[b] <= key:
            found += [self.ids(v) for k, v in self.block(*self.index()[b][1:3]) if k == key]
            b += 1
        return found


def write_shards(docs: DataFrame, to: str, tokenizer: str | None = None, end_id: int | None = END_ID, shard_bytes: int = 32 << 20, block_bytes: int = 64 << 10, item: int | None = None) -> DataFrame:
    """Encode docs (doc_id, text) and write shards below the folder `to`; returns the manifest, one row a shard. item: bytes of an id, 2 or 4; None: as the tokenizer needs."""
    tokenizer = tokenizer or default_path()
    item = item or item_size(tokenizer, end_id)
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        writer, seq, rows = None, 0, []

        def done():
            rows.append(writer.close() | {"part": part, "seq": seq})

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded(batch.column(1).to_pylist(), tokenizer), strict=True):
                if writer is None:
                    writer = ShardWriter(f"{to}/shard-{part:06d}-{seq:04d}-{attempt}.sst", item, block_bytes)
                writer.add(key_of(doc_id), ids + end)
                if writer.at >= shard_bytes:
                    done()
                    writer, seq = None, seq + 1
        if writer is not None:
            done()
        schema = pa.schema([("path", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64()), ("min_key", pa.binary()), ("max_key", pa.binary())])
        yield pa.RecordBatch.from_pylist(rows, schema)

    by = [F.col("doc_id").asc_nulls_first(), F.col("hash").asc()]
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash")).repartitionByRange(*by).sortWithinPartitions(*by)
    return written(dealt.select("doc_id", "text").mapInArrow(write, MANIFEST), "manifest")


def read_shards(manifest: DataFrame, tasks: int = 512) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files the manifest names."""

    def footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"path": x["path"], "part": x["part"], "seq": x["seq"], "tokens": [ShardReader(p).tokens for p in x["path"]]})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard, rows = ShardReader(path), []
                for key, value in shard:
                    ids = shard.ids(value)
                    rows.append((id_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 8192:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    before = W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, 0)  # a row a shard
    n = max(1, min(tasks, manifest.count()))
    # dealt out before a footer is read, and kept apart by number: a task for each few shards
    totals = manifest.select("path", "part", "seq").repartition(n, "path").mapInPandas(footers, "path string, part int, seq int, tokens long")
    placed = totals.withColumn("start", F.sum("tokens").over(before) - F.col("tokens"))
    return placed.select("path", "start").repartition(n, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, keys: DataFrame, tasks: int = 64) -> DataFrame:
    """(doc_id, ids array<int>) for the ids of keys (doc_id): each shard's footer range, Bloom filter and sparse index decide what is read.

    At most POINTS smallest keys of shards, evenly spaced, cut the keys into strips; a key meets the shards of its strip only.
    """
    step = -(-manifest.count() // POINTS)
    ranked = manifest.select("min_key", F.row_number().over(W.orderBy("min_key")).alias("n"))  # a row a shard
    points = sorted(r["min_key"] for r in ranked.filter(F.col("n") % max(1, step) == 0).collect())

    def strips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high = (pa.array([bisect_right(points, k) for k in c.to_pylist()], pa.int32()) for c in batch.columns[-2:])
            yield pa.RecordBatch.from_arrays([*batch.columns, low, high], names=[*batch.schema.names, "low", "high"])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = pa.array([key_of(i) for i in batch.column(0).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), key, pa.array([bisect_right(points, k) for k in key.to_pylist()], pa.int32())], names=["doc_id", "key", "strip"])

    def get(x: pd.DataFrame) -> pd.DataFrame:
        shard = ShardReader(x["path"].iloc[0])
        rows = [(k, v.astype(np.int32)) for k in x["doc_id"] for v in shard.get(None if pd.isna(k) else int(k))]
        return pd.DataFrame({"doc_id": pd.array([None if pd.isna(k) else int(k) for k, _ in rows], "Int64"), "ids": [v for _, v in rows]})

    wanted = keys.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().mapInArrow(keyed, "doc_id long, key binary, strip int")
    shards = manifest.select("path", "min_key", "max_key").mapInArrow(strips, "path string, min_key binary, max_key binary, low int, high int")
    spread = shards.withColumn("strip", F.explode(F.sequence("low", "high"))).drop("low", "high")
    near = wanted.join(spread, "strip").filter((F.col("key") >= F.col("min_key")) & (F.col("key") <= F.col("max_key")))
    return near.select("path", "doc_id").repartition(tasks, "path").groupBy("path").applyInPandas(get, "doc_id long, ids array<int>")


def op2_sstable_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_shards(table(spark, sf_dir, "documents"), fresh_path(spark, "shards"))
    return read_shards(manifest)
