"""Substring dedup by content-defined chunking.

A gear rolling hash runs over a text's UTF-8 bytes: each byte shifts the hash by a bit and adds its
entry of a fixed table, so 16 bits of hash depend on the last 16 bytes alone. A chunk ends where the
hash is a local maximum, not below those of the APART bytes before and after (or after MOST bytes). So
chunks are alike in length (50 bytes on average), a passage of a hundred bytes and more holds whole ones,
and insertions before it shift nothing. A word repeated over and over gives equal short chunks; they are
joined to pieces of APART bytes.

Chunks are known by a 64-bit digest, numbered where a document holds one again, so that a line repeated ten
times is met where others repeat it too and not only where it stands once. Of the texts that hold a
digest, the one with the least row key (a hash of id and text) keeps it. Counts and keepers are pre-aggregated, so a passage that a third of all
documents hold is one row a task; the join has one row a digest on its other side, so Spark can split
the first. Chunks are worked out twice instead of stored: they are smaller to make than to move.

A digest's keeper need not hold the rest of a passage: others may hold pieces of it. So at every chunk the
WORDS + 1 words from there are a window with a digest of its own: who holds that holds more than WORDS
words, whoever its keeper is. Windows find every shared passage that has so many words behind the first
chunk's start within it; the chunks' own digests find those of a few words less as well.

Adjoining chunks that others keep make a run. Runs are anchors only: the bytes around them are compared
with those of each text that keeps one of their chunks, at the same shift, up to the bytes that differ,
so digests that agree by chance decide nothing. The edges of a shared passage lie within the chunks
beside a run, since a chunk shared to its ends would be in the run; a run without a window that holds no
more than WORDS words with these is never compared. A passage counts if more than WORDS words of it are the same.

A passage is missed if it has no more than WORDS words behind the start of its first chunk (it is shorter
than WORDS and a chunk, some ten words), and either holds no whole chunk (the test plants passages of 51 words of two
to four letters and asks for 190 of 200; of passages of 51 words from the tables none of 4,000 missed) or has only
chunks that occur elsewhere too, in texts that hold no more than WORDS words of it in a row.

Defined results: null and empty texts have no chunks; null and repeated ids are told apart by their
texts; repeated rows are one document; passages repeated within one document alone don't count; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written

#: Bytes that a hash depends on (a power of two), bytes between ends of chunks at least, and bytes of a chunk at most.
REACH, APART, MOST = 16, 24, 1024
#: A passage has more words than these.
WORDS = 50
#: Bytes beside the chunks of one keeping document that are compared with it, within a run and its neighbours.
BESIDE = 1024
#: Bytes hashed at once: bounds the memory of a long text.
STEP = 1 << 20
#: The gear table: a 16-bit number for each byte, from a rule.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 7) & 0xFFFF for b in range(256)], np.uint16)
#: Bytes between words, and bytes of letters and digits.
SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
LETTER = [b >= 128 or chr(b).isalnum() for b in range(256)]


def _hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash behind each byte: after each of these lines it covers twice as many bytes."""
    h, covered = GEAR[data], 1
    while covered < REACH and covered < len(h):
        more = h.copy()
        more[covered:] += h[:-covered] << np.uint16(covered)
        h, covered = more, covered * 2
    return h


def _window_max(h: np.ndarray, size: int) -> np.ndarray:
    """The maximum of h[i : i + size] for each i."""
    m, covered = h.copy(), 1
    while covered < size:
        step = min(covered, size - covered)
        if step < len(m):
            wider = m.copy()
            np.maximum(m[:-step], m[step:], out=wider[:-step])
            m = wider
        covered += step
    return m


def ends(data: bytes) -> list[int]:
    """Where the chunks of the bytes end."""
    cuts: list[int] = []
    every = np.frombuffer(data, np.uint8)
    for at in range(0, len(data), STEP):
        back, to = max(0, at - REACH - APART), min(len(data), at + STEP + APART)
        h = _hashes(every[back:to])
        after = _window_max(h, APART + 1)
        before = np.zeros_like(h)
        before[1:] = _window_max(h[::-1], APART)[::-1][:-1]
        top = np.flatnonzero((h >= after) & (h >= before)) + back
        cuts += (top[(top >= at) & (top < at + STEP)] + 1).tolist()
    out, last = [], 0
    for cut in [*cuts, len(data)]:
        while cut - last > MOST:
            last += MOST
            out.append(last)
        if cut > last:
            out.append(cut)
            last = cut
    return out


def row_key(doc_id: Column, text: Column) -> Column:
    """What tells documents apart; equal rows are one document."""
    return F.xxhash64(doc_id.cast("long"), doc_id.isNull(), text)


#: Of each chunk: bytes to the furthest edge of a passage that ends before its neighbour does, words that begin in it, and up to these edges.
BESIDES = ("before", "after", "words", "words_before", "words_after")


def _parts(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, stops, digests) of the chunks: equal short neighbours joined, equal digests numbered."""
    stops = np.array(ends(data), np.int64)
    starts = np.r_[0, stops[:-1]]
    own = [data[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
    digest = np.array(list(map(xxhash.xxh3_64_intdigest, own)), np.uint64)
    size = stops - starts
    again = np.r_[False, (digest[1:] == digest[:-1]) & (size[1:] == size[:-1]) & (size[1:] < APART)]
    if again.any():
        at = np.arange(len(size))
        nth = at - np.maximum.accumulate(np.where(again, 0, at))
        starts = starts[nth % -(-APART // size) == 0]
        stops = np.r_[starts[1:], len(data)]
        digest = np.array([xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)], np.uint64)
    order = np.argsort(digest, kind="stable")
    held = digest[order]
    at = np.arange(len(held))
    nth = at - np.maximum.accumulate(np.where(np.r_[True, held[1:] != held[:-1]], at, 0))
    digest[order] = held ^ (nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return starts, stops, digest.view(np.int64)


def _batched(make, schema: pa.Schema):
    """A function for mapInArrow: the columns that make(text's bytes) gives for each (key, text), with the key first, in batches of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def out() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = (text.as_py() or "").encode()
                if data:
                    columns = make(data)
                    held.append((np.full(len(columns[0]), key, np.int64), *columns))
                    rows += len(columns[0])
                if rows > 20_000:
                    yield out()
                    held, rows = [], 0
        if held:
            yield out()

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(row_key(F.col("doc_id"), F.col("text")).alias("key"), "text")


#: Bits of the sizes that go along with a digest's place: a text's bytes fit 31.
SIZES = {"length": 11, "behind": 11, "reach": 31}
#: Tells the digests of windows from those of chunks.
APART_FROM_CHUNKS = 0x5851F42D4C957F2D


def _windows(data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(chunks, starts, stops, digests) of the WORDS + 1 words that begin at or behind each chunk's start, where a text still has so many."""
    space = SPACE[np.frombuffer(data, np.uint8)]
    begins = np.flatnonzero(~space & np.r_[True, space[:-1]])
    stops = np.flatnonzero(~space & np.r_[space[1:], True]) + 1
    first = np.searchsorted(begins, starts)
    # chunks that begin within one word have one window, the last one's: less than a chunk behind its start
    chunk = np.flatnonzero((first + WORDS < len(begins)) & np.r_[first[1:] != first[:-1], True])
    a, b = begins[first[chunk]], stops[first[chunk] + WORDS]
    digest = np.array([xxhash.xxh3_64_intdigest(data[x:y]) ^ APART_FROM_CHUNKS for x, y in zip(a.tolist(), b.tolist(), strict=True)], np.uint64).view(np.int64)
    return chunk, a, b, digest


def digests(docs: DataFrame) -> DataFrame:
    """(key, digest, at) of all chunks and windows."""
    schema = pa.schema([("key", pa.int64()), ("digest", pa.int64()), ("at", pa.int64())])

    def make(data: bytes) -> tuple[np.ndarray, ...]:
        starts, _, digest = _parts(data)
        _, a, _, windows = _windows(data, starts)
        return np.r_[digest, windows], np.r_[starts, a]

    return _keyed(docs).mapInArrow(_batched(make, schema), "key long, digest long, at long")


def places(docs: DataFrame) -> DataFrame:
    """(key, digest, start, sizes, besides) of all chunks and windows, these with their chunk's start.

    sizes: SIZES in their bits: the chunk's length, and of a window how far behind the chunk's start it begins and
    how far it reaches from there (0: a chunk). besides: BESIDES in 12 bits each, 0 for windows.
    """
    schema = pa.schema([("key", pa.int64()), ("digest", pa.int64()), ("start", pa.int64()), ("sizes", pa.int64()), ("besides", pa.int64())])

    def make(data: bytes) -> tuple[np.ndarray, ...]:
        starts, stops, digest = _parts(data)
        low = np.maximum(np.r_[0, starts[:-1]] - REACH - APART, 0)
        high = np.minimum(np.r_[stops[1:], len(data)] + APART + 1, len(data))
        space = SPACE[np.frombuffer(data, np.uint8)]
        begun = np.r_[0, np.cumsum(~space & np.r_[True, space[:-1]], dtype=np.int64)]
        fields = (starts - low, high - stops, begun[stops] - begun[starts], begun[starts] - begun[low] + 1, begun[high] - begun[stops])
        besides = sum(np.minimum(x, 4095) << 12 * i for i, x in enumerate(fields))
        chunk, a, b, windows = _windows(data, starts)
        size = stops - starts
        own = size[chunk] | a - starts[chunk] << SIZES["length"] | b - a << SIZES["length"] + SIZES["behind"]
        return np.r_[digest, windows], np.r_[starts, starts[chunk]], np.r_[size, own], np.r_[besides, np.zeros(len(chunk), np.int64)]

    return _keyed(docs).mapInArrow(_batched(make, schema), "key long, digest long, start long, sizes long, besides long")


RUN = ["key", "run_start", "run_end"]


def runs(docs: DataFrame) -> DataFrame:
    """(key, run_start, run_end, low, high, at, to, kept, kept_at): each chunk and window that another document keeps, in its run of adjoining ones; low and high: between which a passage about the run must lie."""
    keeps = digests(docs).groupBy("digest").agg(F.min_by("at", "key").alias("kept_at"), F.min("key").alias("kept"), F.max("key").alias("last"))
    shared = keeps.filter("kept != last").drop("last")
    met = places(docs).join(shared, "digest").filter("key != kept").distinct()  # repeated rows are one document
    bits = lambda k, since: F.shiftright("sizes", since).bitwiseAND(F.lit((1 << SIZES[k]) - 1))
    reach = bits("reach", SIZES["length"] + SIZES["behind"])
    met = met.withColumns({"length": bits("length", 0), "at": F.col("start") + bits("behind", SIZES["length"]), "reach": reach})
    own = W.partitionBy("key").orderBy("start", "reach", "digest")
    field = {k: F.shiftright("besides", 12 * i).bitwiseAND(F.lit(4095)) for i, k in enumerate(BESIDES)}
    end = F.col("start") + F.col("length")
    fresh = F.coalesce(F.lag("start").over(own) != F.col("start"), F.lit(True))
    begins = F.when(~fresh | (F.lag(end).over(own) == F.col("start")), 0).otherwise(1)
    numbered = met.withColumn("fresh", fresh).withColumn("begins", begins).withColumn("run", F.sum("begins").over(own))
    of_run = W.partitionBy("key", "run")
    most = F.sum(F.when(F.col("fresh"), field["words"]).otherwise(0)).over(of_run) + F.max(field["words_before"]).over(of_run) + F.max(field["words_after"]).over(of_run)
    # a window holds enough words by itself, and what goes on around it may lie in chunks that this document keeps
    window = F.col("reach") > 0
    low = F.when(window, F.col("start") - BESIDE).otherwise(F.col("start") - field["before"])
    to = F.when(window, F.col("at") + F.col("reach")).otherwise(end)
    high = F.when(window, F.col("at") + F.col("reach") + BESIDE).otherwise(end + field["after"])
    spread = numbered.select("key", F.min("start").over(of_run).alias("run_start"), F.max(end).over(of_run).alias("run_end"), F.greatest(F.min(low).over(of_run), F.lit(0)).alias("low"), F.max(high).over(of_run).alias("high"), "at", to.alias("to"), "kept", "kept_at", ((most > WORDS) | F.max(window).over(of_run)).alias("enough"))
    return spread.filter("enough").drop("enough")


def same(ours: bytes, theirs: bytes, before: tuple[int, int] = (32, 32), after: tuple[int, int] = (32, 32)) -> tuple[int, int, int]:
    """(words, start, end) of the stretch of equal bytes with the most words, of two slices laid side by side; words cut at an edge in either don't count. before, after: the bytes beside the slices (a space, where a text ends)."""
    n = min(len(ours), len(theirs))
    a, b = np.frombuffer(ours, np.uint8), np.frombuffer(theirs, np.uint8)
    edges = np.flatnonzero(np.diff(np.r_[False, a[:n] == b[:n], False].astype(np.int8)))
    size = edges[1::2] - edges[::2]
    if not len(size):
        return 0, 0, 0
    best = (-1, 0, 0)
    # over WORDS words take more than twice as many bytes
    for i in np.flatnonzero(size > 2 * WORDS).tolist() or [int(size.argmax())]:
        x, y = int(edges[2 * i]), int(edges[2 * i + 1])
        held = ours[x:y].split()
        words = len(held)
        for word, end, at, outside in ((held[:1], ours[x], x - 1, before), (held[-1:], ours[y - 1], y, after)):
            # cut: within letters, or nothing but the marks of a word that differs
            if word and not SPACE[end]:
                beside = [s[at] if 0 <= at < len(s) else out for s, out in zip((ours, theirs), outside, strict=True)]
                marks = not any(LETTER[c] for c in word[0])
                words -= any((marks and not SPACE[c]) or (LETTER[end] and LETTER[c]) for c in beside)
        best = max(best, (max(0, words), x, y), key=lambda m: m[0])
    return best


def _with_beside(data: bytes, leads: bool, n: int) -> tuple[bytes, int, int]:
    """n bytes, and those before (if data leads with it) and after."""
    own = data[leads:]
    return own[:n], data[0] if leads else 32, own[n] if len(own) > n else 32


FOUND = "doc_id long, key long, run_start long, run_end long, kept_id long, kept_key long, shift long, passage_start long, passage_end long, n_words int"


def compared(spread: DataFrame, docs: DataFrame) -> DataFrame:
    """FOUND for each run and each document and shift that keeps chunks of it: the longest stretch of words that both hold there, if over WORDS."""
    shift = F.col("at") - F.col("kept_at")
    by_shift = spread.groupBy(*RUN, "low", "high", "kept", shift.alias("shift")).agg(F.min("at").alias("a"), F.max("to").alias("b"))
    asked = written(by_shift.select(*RUN, "kept", "shift", F.greatest("low", F.col("a") - BESIDE, "shift").alias("a"), F.least("high", F.col("b") + BESIDE).alias("b")), "asked")
    # both sides' bytes in one pass over the texts, with a byte more on either side: where it is missing, the text ends
    ours = asked.select(*RUN, "kept", "shift", "a", "b", F.lit(True).alias("ours"), F.col("key").alias("of"), F.col("a").alias("from"))
    theirs = asked.select(*RUN, "kept", "shift", "a", "b", F.lit(False).alias("ours"), F.col("kept").alias("of"), (F.col("a") - F.col("shift")).alias("from"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("doc_id"), F.col("text")).alias("of"), F.col("text").cast("binary").alias("text"))
    slice_ = F.substring("text", F.greatest(F.col("from"), F.lit(1)).cast("int"), (F.col("b") - F.col("a") + 1 + (F.col("from") > 0).cast("int")).cast("int"))
    slices = ours.union(theirs).join(texts, "of").select(*RUN, "kept", "shift", "a", "b", F.when(F.col("ours"), F.struct("doc_id", slice_.alias("s"))).alias("ours"), F.when(~F.col("ours"), F.struct("doc_id", slice_.alias("s"))).alias("theirs"))
    both = slices.groupBy(*RUN, "kept", "shift", "a", "b").agg(F.max("ours").alias("ours"), F.max("theirs").alias("theirs"))
    rows = both.select(F.col("ours.doc_id").alias("doc_id"), *RUN, F.col("theirs.doc_id").alias("kept_id"), F.col("kept").alias("kept_key"), "shift", "a", "b", F.col("ours.s").alias("ours"), F.col("theirs.s").alias("theirs"))
    schema = pa.schema([(f.split()[0], pa.int32() if f.endswith("int") else pa.int64()) for f in FOUND.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, key, s, e, kept_id, kept, by, a, b, ours, theirs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                (o, p, q), (t, u, v) = _with_beside(ours, a > 0, b - a), _with_beside(theirs, a > by, b - a)
                words, x, y = same(o, t, (p, u), (q, v))
                if words > WORDS:
                    out.append((doc_id, key, s, e, kept_id, kept, by, a + x, a + y, words))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, FOUND)


def passages(docs: DataFrame) -> DataFrame:
    """The passages of over WORDS words that documents share: (doc_id, passage_start, passage_end, n_words, keeps, kept_id, copies).

    keeps false: a duplicate (of each run, the stretch of the most words that one keeping document holds), kept
    by kept_id. keeps true: the same passage where it stays; copies: how many duplicates it has there. Places are bytes.
    """
    found = written(compared(written(runs(docs), "runs"), docs), "found")
    row = F.struct("n_words", (F.col("passage_end") - F.col("passage_start")).alias("size"), "kept_key", "shift", "passage_start", "doc_id", "kept_id")
    best = found.groupBy(*RUN).agg(F.max(row).alias("m")).select("key", "m.*")
    duplicates = best.select("doc_id", "passage_start", (F.col("passage_start") + F.col("size")).alias("passage_end"), "n_words", F.lit(False).alias("keeps"), "kept_id", F.lit(0).cast("long").alias("copies"))
    at = F.col("passage_start") - F.col("shift")
    keepers = best.groupBy("kept_key", "kept_id", at.alias("passage_start"), (at + F.col("size")).alias("passage_end")).agg(F.max("n_words").alias("n_words"), F.count("*").alias("copies"))
    return duplicates.union(keepers.select(F.col("kept_id").alias("doc_id"), "passage_start", "passage_end", "n_words", F.lit(True).alias("keeps"), "kept_id", "copies"))


def op5_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of passages() over all documents."""
    return passages(table(spark, sf_dir, "documents"))
