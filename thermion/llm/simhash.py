"""SimHash near-duplicates by multi-index hashing.

1. Each text becomes a 64-bit fingerprint of its 4-word shingles.
2. Equal fingerprints are one node, with the smallest doc_id that has it: groups of exact copies are
   gone before any link is looked for.
3. The 64 bits are cut into `segments` parts. By the pigeonhole rule, two fingerprints within `radius`
   bits agree in some part up to a small distance: with radius = parts * a + b, the first b + 1 parts
   are looked up in balls of radius a and the others in balls of a - 1 (exactly, if that is 0).
   Every node is filed under its parts ("centre") and asks at all keys of its balls.
4. Keys meet in a shuffle and are read in order, a run of rows a key; complete distances are verified
   by XOR and bit counts, and a run yields a star for each group it links, never all its pairs.
5. Runs of more than RUN rows are dealt out by pairs of blocks of their rows, so that no task holds
   more than a few thousand rows of a key; all pairs of blocks are verified.
6. Components of the links; documents get theirs by fingerprint.

At 10^9 different fingerprints, take segments = 2: keys of 32 bits (562 a node).

Near copies of a given similarity (`similar`, which the pipeline uses) are further apart than a few bits
of 64: shingle sets of Jaccard 0.8 differ in 15 of 100 bits, give or take what a short fingerprint
blurs. So their fingerprints have WIDE words of 64 bits, and segments are met by balls on both sides: every
node is filed under all keys within one bit of its segment, so segments within two bits share a key. The
length of a segment follows the number of nodes, so that unrelated nodes seldom share a key, and the
number of segments follows from the share of pairs at the similarity that have to meet (MEET).
Complete distances are verified as before, with a radius that CAUGHT standard deviations of the
distance at the similarity stay within. Pairs somewhat less similar pass that too, so the similarity of what
is left is then worked out from the texts' sets of shingles: no link is below it.

What fingerprints do not propose (pairs beyond the radius or without a common key, and in a run of more than 48
nodes all but a star) is found by an exact way (`_missed`), so that the groups are those of all pairs of the
similarity. Two sets of the similarity share one of their first n - ceil(similarity * n) + 1 shingles in any order
common to all; frequent shingles come last in it. Only nodes of different groups are compared: in runs of up to
SHORT nodes of a shingle as pairs (at the first shingle that both have, where what is left of both sets can
still hold what they must share), in longer ones whole sets against each other in a task, of which a star
for each group is left. A node is a set of shingles: texts of one fingerprint and different sets are verified like others.

Defined results: null, empty and blank texts have fingerprint zero, linked like any other; null ids
take part but name no component unless all ids are null (component null); repeated rows are rows
like any other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written
from .components import connected

WIDTH, RADIUS, SEGMENTS, SEED = 4, 4, 3, 42
#: Of `similar`: words of a shingle and of a fingerprint, Jaccard similarity, share of pairs that meet, standard deviations of their distance.
SHINGLE, WIDE, SIMILARITY, MEET, CAUGHT = 5, 4, 0.8, 0.98, 1.7
#: Rows of one key that a task takes at once.
RUN = 4096
#: Documents, about, in which frequent shingles are looked for, how many must hold one, and how many shingles are kept: they order shingles, results do not depend on them.
FIT, SEEN, FREQUENT = 16_384, 4, 1 << 18
#: Nodes that share a shingle and are compared as pairs; of more, nodes and shingles that a task compares at once.
SHORT, MOST, VOLUME = 48, 2048, 1 << 20
#: Sets that share a shingle, up to which they are counted one by one, and columns of a block of the others.
RARE, COLUMNS = 64, 4096
#: Shingles of a node, before one that it shares, that tell whether a pair has met already; results do not depend on it.
BEFORE = 4
#: What rounding may take from a similarity.
SLACK = 1e-9
#: Pairs of one node that a task verifies at once, about.
FEW = 256
#: Shingles hashed at once: bounds the memory of a long text.
STEP = 1 << 18
#: Pairs of small runs verified at once.
PAIRS = 1 << 18


def _words_of(text: str | None, width: int, words: int, digest) -> list[int]:
    own = (text or "").encode("utf-8", "replace").lower().split()
    if not own:
        return [0] * words
    joined = b" ".join(own)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(own) - width + 1)
    last = ends[min(width, len(own)) - 1 :]
    counts = np.zeros(64 * words, np.int64)
    for at in range(0, n, STEP // words):
        pairs = zip(starts[at : at + STEP // words][: n - at].tolist(), last[at : at + STEP // words].tolist(), strict=False)
        h = np.frombuffer(b"".join([digest(joined[a:b]) for a, b in pairs]), np.uint8).reshape(-1, 8 * words)
        # one byte's bits at a time stay in the processor's cache; counts of a few hundred rows fit 16 bits
        bits = np.unpackbits(h, axis=1, bitorder="little")
        counts += np.add.reduceat(bits, np.arange(0, len(bits), 256), axis=0, dtype=np.uint16).sum(0, dtype=np.int64)
    packed = np.packbits(counts * 2 > n, bitorder="little").tobytes()
    return [int.from_bytes(packed[i : i + 8], "little") for i in range(0, len(packed), 8)]


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """SimHash of the text's shingles of `width` words (fewer words: the whole sequence; none: 0)."""
    return _words_of(text, width, 1, lambda s: xxhash.xxh64_intdigest(s, SEED).to_bytes(8, "little"))[0]


def wide_fingerprint(text: str | None, width: int = SHINGLE) -> list[int]:
    """The same of WIDE words of 64 bits."""
    return _words_of(text, width, WIDE, lambda s: b"".join([xxhash.xxh3_128_digest(s, seed) for seed in range(WIDE // 2)]))


def _ids(fp: np.ndarray) -> np.ndarray:
    """A 64-bit name of each row of words; of single words, the words."""
    h = fp[:, 0].astype(np.uint64)
    for k in range(1, fp.shape[1]):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + fp[:, k].astype(np.uint64)
    return h.astype(np.int64)


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, text_hash, fp long) of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array([fingerprint(t.as_py(), width) for t in batch.column(2)], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.int64())], names=["doc_id", "text_hash", "fp"])

    return _texts(docs).mapInArrow(run, "doc_id long, text_hash long, fp long")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def _parts(segments: int) -> list[tuple[int, int]]:
    """(shift, bits) of each part, from the lowest."""
    sizes = [64 // segments + (i < 64 % segments) for i in range(segments)]
    return [(sum(sizes[:i]), n) for i, n in enumerate(sizes)]


def _probes(fp: Column, radius: int, segments: int) -> Column:
    """All (part, key, centre) of a fingerprint: part and key in one long, the centre flagged."""
    a, b = divmod(radius, segments)
    asked = []
    for i, (shift, n) in enumerate(_parts(segments)):
        reach = a if i <= b else a - 1
        key = F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << n) - 1))
        masks = [sum(1 << x for x in flip) for k in range(reach + 1) for flip in combinations(range(n), k)] if reach >= 0 else [0]
        asked += [(i, key, masks)]

    def filed(i: int, key: Column, masks: list[int]) -> Column:
        return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: F.struct(F.lit(i).cast("short").alias("part"), key.bitwiseXOR(m).alias("key"), (m == 0).alias("centre")))

    return F.concat(*[filed(*x) for x in asked])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The bits by which each row of words of a differs from each of b."""
    d = np.zeros((len(a), len(b)), np.uint16)
    for k in range(a.shape[1]):
        d += np.bitwise_count((a[:, None, k] ^ b[None, :, k]).view(np.uint64))
    return d


def _stars(a: np.ndarray, b: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each row to the smallest of its group, for the bipartite graph `near` between a and b."""
    rows, columns = near.any(1), near.any(0)
    a, b, near = a[rows], b[columns], near[rows][:, columns]
    if not len(a):
        return a, a
    of_a, of_b = a.copy(), b.copy()
    top = np.iinfo(np.int64).max
    while True:
        new_b = np.minimum(of_b, np.where(near, of_a[:, None], top).min(0))
        new_a = np.minimum(of_a, np.where(near, new_b[None, :], top).min(1))
        if (new_a == of_a).all() and (new_b == of_b).all():
            break
        of_a, of_b = new_a, new_b
    return np.concatenate([a, b]), np.concatenate([of_a, of_b])


def _verified(fp: np.ndarray, centre: np.ndarray, run: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of sorted whole runs; run: number of each row's run; fp: rows of words."""
    ids = _ids(fp)
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    sizes = np.diff(np.r_[starts, len(run)])
    of = np.repeat(np.arange(len(starts)), sizes)
    small = (sizes > 1) & (sizes <= 48) & (np.add.reduceat(centre, starts) > 0)
    # small runs, some thousands of pairs at once: each centre against the rows of its run, two centres once
    at = np.flatnonzero(small[of] & centre)
    n = sizes[of[at]]
    for some in np.split(at, np.searchsorted(np.cumsum(n), np.arange(PAIRS, n.sum(), PAIRS))) if len(at) else []:
        if not len(some):
            continue
        n = sizes[of[some]]
        left = np.repeat(some, n)
        right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[of[some]], n)
        once = (right > left) | ~centre[right]
        left, right = left[once], right[once]
        d = np.bitwise_count((fp[left] ^ fp[right]).view(np.uint64)).sum(1, dtype=np.int64)
        keep = (ids[left] != ids[right]) & (d <= radius)
        yield ids[left[keep]], ids[right[keep]]
    for i in np.flatnonzero(sizes > 48):
        rows = slice(starts[i], starts[i] + sizes[i])
        held = centre[rows]
        if held.any():
            yield _stars(ids[rows][held], ids[rows], _distances(fp[rows][held], fp[rows]) <= radius)


def _read_runs(batches: Iterator[pa.RecordBatch], radius: int, most: int, words: int) -> Iterator[pa.RecordBatch]:
    """From rows (part, key, ..., words, centre) sorted by (part, key, ...): links (u, v); rows of runs above `most` pass on as they are (v null)."""
    names = ["u", "v", "part", "key", "centre", *(f"w{k}" for k in range(words))]
    kinds = [pa.int64(), pa.int64(), pa.int16(), pa.int64(), pa.bool_(), *[pa.int64()] * words]
    held: list[np.ndarray] = []
    hot, keys = None, -1 - words

    def links(x: np.ndarray) -> Iterator[pa.RecordBatch]:
        run = np.cumsum(np.r_[False, (x[1:, :keys] != x[:-1, :keys]).any(1)])
        found = list(_verified(x[:, keys:-1].copy(), x[:, -1] == 1, run, radius))
        if found:
            u, v = (np.concatenate(c) for c in zip(*found, strict=True))
            u, v = np.maximum(u, v), np.minimum(u, v)
            pair = np.unique(np.stack([u, v], 1)[u != v], axis=0)
            if len(pair):
                none = pa.nulls(len(pair))
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), *(none.cast(k) for k in kinds[2:])], names=names)

    def passed(x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(_ids(x[:, keys:-1])), pa.nulls(len(x)).cast(pa.int64()), pa.array(x[:, 0].astype(np.int16)), pa.array(x[:, 1].copy()), pa.array(x[:, -1] == 1), *(pa.array(x[:, keys + k].copy()) for k in range(words))], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        x = np.stack([c.cast(pa.int64()).to_numpy(zero_copy_only=False) for c in batch.columns], 1)
        if hot is not None:  # the rest of a run that was too long
            more = (x[:, :keys] == hot).all(1)
            n = len(x) if more.all() else int(np.argmin(more))
            if n:
                yield passed(x[:n])
            if n == len(x):
                continue
            x, hot = x[n:], None
        held.append(x)
        x = np.concatenate(held) if len(held) > 1 else x
        last = (x[:, :keys] == x[-1, :keys]).all(1)
        cut = len(x) - (len(x) if last.all() else int(np.argmin(last[::-1])))
        if cut:
            yield from links(x[:cut])
        x = x[cut:]
        held = [x]
        if len(x) > most:
            yield passed(x)
            hot, held = x[-1, :keys], []
    if held and len(held[0]):
        yield from links(held[0])


def _met(asked: DataFrame, radius: int, run: int, words: int) -> DataFrame:
    """Links (u, v) of rows (part, key, w0, ..., centre) that share a key and are within `radius` bits."""
    own = [f"w{k}" for k in range(words)]
    schema = "u long, v long, part short, key long, centre boolean, " + ", ".join(f"{w} long" for w in own)
    sorted_ = asked.select("part", "key", *own, "centre").repartition("part", "key").sortWithinPartitions("part", "key")
    out = written(sorted_.mapInArrow(lambda b: _read_runs(b, radius, run, words), schema), "links")
    links, rest = out.filter("v is not null").select("u", "v"), out.filter("v is null")
    if rest.isEmpty():
        return links
    # long runs: every row meets every block of its key's rows in the pairs of blocks that its own takes part in
    blocks = rest.groupBy("part", "key").agg(F.ceil(F.count("*") * 2 / run).cast("int").alias("n"))
    dealt = rest.join(blocks, ["part", "key"]).withColumn("own", F.pmod(F.xxhash64("u"), F.col("n")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("a"), F.greatest(o, F.col("own")).alias("b")))
    spread = dealt.withColumn("p", F.explode(pairs)).select("part", "key", "p.a", "p.b", *own, F.col("centre").cast("byte").alias("centre"))
    met = spread.repartition("part", "key", "a", "b").sortWithinPartitions("part", "key", "a", "b")
    more = written(met.mapInArrow(lambda b: _read_runs(b, radius, 1 << 62, words), schema), "links")
    return links.union(more.select("u", "v"))


def linked(nodes: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, run: int = RUN) -> DataFrame:
    """Links (u, v) whose components are those of all pairs of nodes (fp, distinct) within `radius` bits."""
    asked = nodes.select("fp", F.explode(_probes(F.col("fp"), radius, segments)).alias("p")).select("p.part", "p.key", F.col("fp").alias("w0"), F.col("p.centre").cast("byte").alias("centre"))
    return _met(asked, radius, run, 1)


def shape(n: int, similarity: float = SIMILARITY) -> tuple[int, int, int]:
    """(radius, bits, segments) for n nodes: see the head of the module."""
    shared = 2 * similarity / (1 + similarity)  # the cosine of two sets of one size
    p = math.acos(min(1.0, shared)) / math.pi
    size = 64 * WIDE
    bits = min(32, max(16, (n - 1).bit_length() - 1 if n > 1 else 16))
    within = sum(math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(3))
    wanted = math.ceil(math.log(1 - MEET) / math.log(1 - within)) if within < 1 else 1
    return round(size * p + CAUGHT * (size * p * (1 - p)) ** 0.5), bits, min(wanted, (_halves(bits) // 2) ** 2)


def _halves(bits: int) -> int:
    """How many half segments the words of a wide fingerprint have."""
    return WIDE * (64 // -(-bits // 2))


def linked_wide(nodes: DataFrame, similarity: float = SIMILARITY, run: int = RUN) -> DataFrame:
    """Links (u, v) of nodes (fp, w0, ...): most pairs of at least the similarity are linked, and none beyond the radius."""
    radius, bits, segments = shape(nodes.count(), similarity)
    halves, half = _halves(bits), -(-bits // 2)
    masks = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(bits)])

    def half_key(i: int, n: int) -> Column:
        return F.shiftrightunsigned(F.col(f"w{i % WIDE}"), half * (i // WIDE)).bitwiseAND(F.lit((1 << n) - 1))

    def filed(i: int) -> Column:
        # segments are pairs of halves: disjoint ones first, then each half again beside another
        again, k = divmod(i, halves // 2)
        key = half_key(2 * k, half).bitwiseOR(F.shiftleft(half_key((2 * k + 1 + 2 * again) % halves, bits - half), half))
        return F.transform(masks, lambda m: F.struct(F.lit(i).cast("short").alias("part"), key.bitwiseXOR(m).alias("key")))

    own = [f"w{k}" for k in range(WIDE)]
    asked = nodes.select(*own, F.explode(F.concat(*[filed(i) for i in range(segments)])).alias("p")).select("p.part", "p.key", *own, F.lit(1).cast("byte").alias("centre"))
    return _met(asked, radius, run, WIDE)


def _grouped(fps: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp, component_id) from the rows' fingerprints, the nodes with their first ids, and the nodes' links."""
    groups = connected(links)
    grouped = nodes.select("fp", "first_id").join(groups, nodes["fp"] == groups["node"], "left").select("fp", "first_id", F.coalesce("component", "fp").alias("group"))
    named = written(grouped, "groups")
    ids = named.groupBy("group").agg(F.min("first_id").alias("component_id"))
    of_fp = named.join(ids, "group").select(F.col("fp").alias("of"), "component_id")
    return fps.join(of_fp, fps["fp"] == of_fp["of"]).select("doc_id", "text_hash", "fp", "component_id")


def near_duplicates(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """(doc_id, text_hash, fp, component_id) of every row of docs (doc_id, text)."""
    fps = written(fingerprints(docs, width), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    return _grouped(fps, nodes, linked(nodes.select("fp"), radius, segments))


def shingle_set(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """The different shingles' hashes, ascending."""
    own = (text or "").encode("utf-8", "replace").lower().split()
    if not own:
        return np.zeros(0, np.uint64)
    joined = b" ".join(own)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
    last = ends[min(width, len(own)) - 1 :].tolist()
    starts = [0, *(ends[: len(last) - 1] + 1).tolist()]
    return np.unique(np.fromiter((xxhash.xxh3_64_intdigest(joined[a:b]) for a, b in zip(starts, last, strict=True)), np.uint64, len(last)))


def _frequent(docs: DataFrame, width: int) -> np.ndarray:
    """Shingles that SEEN of about FIT documents hold, from the least to the most frequent."""
    share = max(1, docs.count() // FIT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, n = np.unique(np.concatenate([shingle_set(t.as_py(), width) for t in batch.column(0)] or [np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(held.view(np.int64)), pa.array(n.astype(np.int64))], names=["token", "n"])

    counted = docs.filter(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    found = counted.filter(F.col("n") >= SEEN).orderBy(F.desc("n"), "token").limit(FREQUENT).select("token").toArrow()
    return found.column(0).to_numpy()[::-1].astype(np.int64).view(np.uint64)


def needed(n: int, similarity: float) -> int:
    """How many shingles a set of n shares with any set of the similarity, at least."""
    return math.ceil(similarity * n - SLACK)


def prefix(own: np.ndarray, tokens: np.ndarray, ranks: np.ndarray, similarity: float) -> np.ndarray:
    """Those shingles of a set of which any set of the similarity has one among its own: the first in the order of ranks (of ascending tokens; others come before them), then of hashes."""
    n = min(len(own), len(own) - needed(len(own), similarity) + 1)
    at = np.searchsorted(tokens, own)
    often = tokens[np.minimum(at, len(tokens) - 1)] == own if len(tokens) else np.zeros(len(own), bool)
    first = own[~often][:n]
    if len(first) == n:
        return first
    return np.concatenate([first, own[often][np.argsort(ranks[at[often]])[: n - len(first)]]])


def sketch(own: np.ndarray) -> np.ndarray:
    """How many shingles of a set fall into each cell by their hashes (255 at most), four to eight a cell."""
    cells = 1 << max(5, (len(own) // 8).bit_length())
    return np.minimum(np.bincount((own & np.uint64(cells - 1)).astype(np.int64), minlength=cells), 255).astype(np.uint8)


def differ(a: np.ndarray, b: np.ndarray) -> int:
    """By how many shingles two sets differ at least, by their sketches."""
    a, b = (a, b) if len(a) > len(b) else (b, a)
    a = a.reshape(-1, len(b)).sum(0, dtype=np.int64)
    return int(np.abs(a - b).sum())


def signatures(docs: DataFrame, width: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_hash, fp, name, w0, ..., n, prefix, sketch) of every row of docs (doc_id, text): fp names its set of n shingles, name its wide fingerprint."""
    frequent = _frequent(docs, width)
    order = np.argsort(frequent)
    known = docs.sparkSession.sparkContext.broadcast((frequent[order], order))
    names = [f"w{k}" for k in range(WIDE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            sets = [shingle_set(t, width) for t in texts]
            w = np.array([wide_fingerprint(t, width) for t in texts], np.uint64).astype(np.int64).reshape(-1, WIDE)
            fp = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
            first = pa.array([prefix(x, *known.value, similarity).view(np.int64) for x in sets], pa.list_(pa.int64()))
            n = pa.array([len(x) for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp), pa.array(_ids(w), pa.int64()), *(pa.array(w[:, k].copy(), pa.int64()) for k in range(WIDE)), n, first, pa.array([sketch(x).tobytes() for x in sets], pa.binary())], names=["doc_id", "text_hash", "fp", "name", *names, "n", "prefix", "sketch"])

    return _texts(docs).mapInArrow(run, "doc_id long, text_hash long, fp long, name long, " + ", ".join(f"{n} long" for n in names) + ", n long, prefix array<long>, sketch binary")


def _sets(docs: DataFrame, nodes: DataFrame, links: DataFrame, width: int) -> DataFrame:
    """(fp, shingles binary) of the first text of each of the nodes (fp, first) that links (u, v) name, stored."""
    named = links.select(F.explode(F.array("u", "v")).alias("fp"))
    wanted = nodes.join(named, "fp", "left_semi").select("fp", F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash"))
    texts = _texts(docs)
    rows = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["_id"]) & (texts["text_hash"] == wanted["_hash"])).select("fp", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fp, text in zip(*batch.columns, strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([fp.as_py()], pa.int64()), pa.array([shingle_set(text.as_py(), width).tobytes()], pa.binary())], names=["fp", "shingles"])

    return written(rows.mapInArrow(run, "fp long, shingles binary").dropDuplicates(["fp"]), "sets")


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """pairs (u, v) with `alike`: whether their sets' Jaccard similarity is as high. A node of many pairs is copied to several tasks."""
    hot = pairs.groupBy("v").agg(F.ceil(F.count("*") / FEW).cast("int").alias("n")).filter("n > 1")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("n", F.lit(1)) - 1)).alias("salt")
    theirs = sets.join(hot, sets["fp"] == hot["v"], "left").select(F.col("fp").alias("v"), F.col("shingles").alias("b"), copies)
    dealt = pairs.join(hot, "v", "left").select("u", "v", F.pmod(F.xxhash64("u"), F.coalesce("n", F.lit(1))).cast("int").alias("salt"))
    ours = dealt.join(sets.select(F.col("fp").alias("u"), F.col("shingles").alias("a")), "u")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                a, b = (np.frombuffer(x.as_py(), np.uint64) for x in (a, b))
                both = len(np.intersect1d(a, b, assume_unique=True))
                alike.append(both >= similarity * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(alike, pa.bool_())], names=["u", "v", "alike"])

    return ours.join(theirs, ["v", "salt"]).select("u", "v", "a", "b").mapInArrow(run, "u long, v long, alike boolean")


def verified(links: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Those of the different links (u, v) whose texts are as similar, by their whole sets of shingles."""
    return written(_alike(links, sets, similarity).filter("alike").select("u", "v"), "verified")


def _proposed(nodes: DataFrame, similarity: float) -> DataFrame:
    """Different pairs (u, v) of nodes whose wide fingerprints are linked or equal."""
    wide = written(nodes.groupBy("name").agg(F.min("fp").alias("first"), *[F.min(f"w{k}").alias(f"w{k}") for k in range(WIDE)]), "wide")
    links = linked_wide(wide.withColumnRenamed("name", "fp"), similarity).distinct()
    of_u, of_v = (wide.select(F.col("name").alias(end), F.col("first").alias(f"first_{end}")) for end in ("u", "v"))
    between = links.join(of_u, "u").join(of_v, "v").select(F.col("first_u").alias("u"), F.col("first_v").alias("v"))
    equal = nodes.select("fp", "name").join(wide.select("name", "first"), "name").filter("fp != first").select(F.col("fp").alias("u"), F.col("first").alias("v"))
    return between.union(equal)


def _plausible(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs (u, v) of nodes that may have the similarity by their sketches."""
    of_u, of_v = (nodes.select(F.col("fp").alias(end), F.col("n").alias(f"n_{end}"), F.col("sketch").alias(f"s_{end}")) for end in ("u", "v"))
    share = (1 - similarity) / (1 + similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, n, m, a, b = (c.to_pylist() for c in batch.columns)
            kept = [differ(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) <= share * (i + j) + SLACK for i, j, x, y in zip(n, m, a, b, strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(kept, pa.bool_()))

    return pairs.join(of_u, "u").join(of_v, "v").select("u", "v", "n_u", "n_v", "s_u", "s_v").mapInArrow(run, "u long, v long")


def _meeting(rows: DataFrame) -> DataFrame:
    """Those of rows (token, at, fp, n, group) whose token nodes of other groups have, with how many rows have it."""
    of = Window.partitionBy("token")
    counted = rows.select("*", F.count("*").over(of).alias("many"), F.min("group").over(of).alias("low"), F.max("group").over(of).alias("high"))
    return counted.filter("low < high").drop("low", "high")


def _sharing(rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u, v) of nodes of other groups that share a token of rows (token, at, fp, n, group) and may have the similarity by what is left of their sets from there on; at: the token's place in the set's order.

    A pair of the similarity passes at the first token that both have: they share none before it. So a token is
    left out for a pair if one of the BEFORE rows before it of the one is among those of the other.
    """
    before = Window.partitionBy("fp").orderBy("at").rowsBetween(-BEFORE, -1)
    runs = rows.withColumn("before", F.collect_list("token").over(before)).groupBy("token").agg(F.collect_list(F.struct("fp", "n", "group", "at", "before")).alias("own"))
    share = similarity / (1 + similarity)

    def fits(a: Column, b: Column) -> Column:
        enough = F.least(a["n"] - a["at"], b["n"] - b["at"]) >= share * (a["n"] + b["n"]) - SLACK
        return (a["fp"] > b["fp"]) & (a["group"] != b["group"]) & enough & ~F.arrays_overlap(a["before"], b["before"])

    met = F.flatten(F.transform("own", lambda a: F.transform(F.filter("own", lambda b: fits(a, b)), lambda b: F.struct(a["fp"].alias("u"), b["fp"].alias("v")))))
    return runs.select(F.explode(met).alias("p")).select("p.u", "p.v")


def _in_common(tokens: np.ndarray, of: np.ndarray, k: int) -> np.ndarray:
    """How many tokens each two of k sets share (the diagonal is undefined); of: each token's set."""
    order = np.argsort(tokens, kind="stable")
    tokens, of = tokens[order], of[order]
    sizes = np.diff(np.r_[np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]]), len(tokens)])
    held = np.repeat(sizes, sizes)
    both = np.zeros(k * k, np.int32)
    rare = (held > 1) & (held <= RARE)
    x, y = tokens[rare], of[rare]
    for lag in range(1, RARE):
        same = x[lag:] == x[:-lag]
        if not same.any():
            break
        np.add.at(both, y[:-lag][same] * k + y[lag:][same], 1)
    both = both.reshape(k, k)
    both = both + both.T
    often = held > RARE
    _, column = np.unique(tokens[often], return_inverse=True)
    rows = of[often]
    for start in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        some = (column >= start) & (column < start + COLUMNS)
        m = np.zeros((k, COLUMNS), np.float32)
        m[rows[some], column[some] - start] = 1
        both += (m @ m.T).astype(np.int32)
    return both


def _stars_of_sets(ids: np.ndarray, groups: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links from each of the sets to the smallest id of those it hangs together with by the similarity, between groups only."""
    n = np.array([len(x) for x in sets])
    both = _in_common(np.concatenate(sets), np.repeat(np.arange(len(n)), n), len(n))
    near = both >= similarity * (n[:, None] + n[None, :] - both)
    np.fill_diagonal(near, False)
    u, v = _stars(ids, ids, near)
    order = np.argsort(ids)
    group = lambda x: groups[order[np.searchsorted(ids[order], x)]]
    keep = group(u) != group(v)
    return u[keep], v[keep]


def _read_sets(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """From rows (token, a, b, fp, group, shingles) sorted by (token, a, b): links (u, v)."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    for _, run in groupby(rows(), lambda r: r[:3]):
        own = {fp: (group, np.frombuffer(shingles, np.uint64)) for *_, fp, group, shingles in run}
        if len({group for group, _ in own.values()}) < 2:
            continue
        groups, sets = zip(*own.values(), strict=True)
        u, v = _stars_of_sets(np.array(list(own), np.int64), np.array(groups, np.int64), list(sets), similarity)
        pair = np.unique(np.stack([u, v], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())], names=["u", "v"])


def _missed(docs: DataFrame, nodes: DataFrame, groups: DataFrame, width: int, similarity: float, most: int) -> DataFrame:
    """Links (u, v) of the similarity that join the groups (node, component) to those of all pairs of nodes of the similarity."""
    grouped = nodes.join(groups, nodes["fp"] == groups["node"], "left").select(F.posexplode("prefix").alias("at", "token"), "fp", "n", F.coalesce("component", "fp").alias("group"))
    met = written(_meeting(grouped), "met")
    few, many = met.filter(F.col("many") <= SHORT), met.filter(F.col("many") > SHORT)
    shared = _sharing(few, similarity).distinct()
    pairs = written(_plausible(shared, nodes, similarity), "pairs")
    sets = _sets(docs, nodes, pairs.union(many.select(F.col("fp").alias("u"), F.col("fp").alias("v"))), width)
    links = verified(pairs, sets, similarity)
    if many.isEmpty():
        return links
    # every node meets every block of its shingle's nodes in the pairs of blocks that its own takes part in
    load = F.greatest(F.count("*") / most, F.sum("n") / VOLUME)
    blocks = many.groupBy("token").agg(F.when(load <= 1, 1).otherwise(F.ceil(2 * load)).cast("int").alias("blocks"))
    dealt = many.join(blocks, "token").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    other = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("a"), F.greatest(o, F.col("own")).alias("b")))
    spread = dealt.withColumn("p", F.explode(other)).select("token", "p.a", "p.b", "fp", "group").join(sets, "fp").select("token", "a", "b", "fp", "group", "shingles")
    found = spread.repartition("token", "a", "b").sortWithinPartitions("token", "a", "b").mapInArrow(lambda x: _read_sets(x, similarity), "u long, v long")
    return links.union(written(found, "links"))


def similar(docs: DataFrame, width: int = SHINGLE, similarity: float = SIMILARITY, most: int = MOST) -> DataFrame:
    """(doc_id, text_hash, fp, component_id) of every row of docs (doc_id, text): groups of all pairs of texts of the similarity, met by wide fingerprints, verified by their shingles and completed by them."""
    fps = written(signatures(docs, width, similarity), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    words = [f"w{k}" for k in range(WIDE)]
    named = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), first, F.min(F.struct("name", *words)).alias("w"), F.min("n").alias("n"), *[F.any_value(x).alias(x) for x in ("prefix", "sketch")])
    nodes = written(named.select("fp", "first_id", "first", "w.*", "n", "prefix", "sketch"), "nodes")
    pairs = written(_proposed(nodes, similarity), "pairs")
    links = verified(pairs, _sets(docs, nodes, pairs, width), similarity)
    groups = written(connected(links), "proposed")
    stars = groups.select(F.col("node").alias("u"), F.col("component").alias("v"))
    return _grouped(fps, nodes, stars.union(_missed(docs, nodes, groups, width, similarity, most)))


def deduplicated(docs: DataFrame, width: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each group of near-duplicates: that of the smallest doc_id (then of the smallest text hash; null ids last)."""
    columns = docs.columns
    found = written(similar(docs, width, similarity), "similar")
    # groups without any id are told apart by their fingerprints' component only: they share the null id, so each keeps its own texts
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    groups = found.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("fp")).agg(first.alias("f"))
    kept = written(groups.select(F.col("f.doc_id").alias("_id"), F.col("f.text_hash").alias("_hash")).groupBy("_id", "_hash").agg(F.count("*").alias("n")), "kept")
    again = written(found.join(kept, found["doc_id"].eqNullSafe(kept["_id"]) & (found["text_hash"] == kept["_hash"])).groupBy("_id", "_hash").count().filter("count > 1").select("_id", "_hash"), "again")
    match = lambda k: docs["doc_id"].eqNullSafe(k["_id"]) & (F.xxhash64(docs["text"]) == k["_hash"])
    rows = docs.join(kept, match(kept)).select(*[docs[c] for c in columns])
    if again.isEmpty():
        return rows
    once = rows.join(again, match(again), "left_anti").select(*columns)
    return once.union(rows.join(again, match(again), "left_semi").select(*columns).dropDuplicates(["doc_id", "text"]))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
