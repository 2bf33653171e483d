r"""Ranked search over a clustered index: documents put near their like, shards visited by what they can reach.

Documents are reordered by recursive graph bisection: a set of documents is halved, and documents change
sides as long as that makes the gaps in the terms' posting lists cheaper to write (the logarithm of a list's
mean gap, counted once an entry). The halving is fitted on a bounded sample (FIT documents, the first
FIT_CHARS characters of each); every document then goes down the tree of halves by the same cost, all its
terms counted. A leaf's documents are one or more shards of about SHARD documents or POSTINGS entries.

A shard is a row: its terms, how many of its documents hold each, the highest impact of each, and the
postings. For a query, the highest impacts add up to a bound of a shard's scores. Shards are visited in
bands of falling bounds, each a pass over the index that leaves all other shards unopened; a shard whose bound is below the tenth score found so far can hold no document of
the ten and is never opened, one whose bound equals it can (ties go to smaller ids) and is. So results are
exact, whatever the halving.

Terms are the runs of ASCII letters and digits and all characters beyond ASCII, A-Z lower-cased.

Defined results: documents with null text or without terms are not counted and never found; null ids are
ids that come last among equal scores; repeated rows are documents of their own; items equal in id and text
are one, items with the same id and different texts are ranked apart; items without known terms have no
rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from string import ascii_lowercase, ascii_uppercase, digits
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written

K = 10
#: The sample that the bisection is fitted on: documents, and characters of each; and how often sets are halved.
FIT, FIT_CHARS, DEPTH = 2048, 2000, 6
#: Rounds of exchange for each halving, at most.
ROUNDS = 20
#: A shard's documents and postings, about.
SHARD, POSTINGS = 2048, 500_000
#: Bands of bounds: a shard is visited in the first band whose share of the way down from the best bound to the tenth score it lies within.
BANDS = (0.0, 0.4, 1.0)
#: About so many terms of items are searched for together: what every task gets.
ITEM_TERMS = 200_000
#: The score's constants: a document's weight is 100 - B + B * its length by the mean length, B in percent (fixed values of the contract).
B, UNIT, RISE = 75, 1_000_000_000, 8

_kept = set((ascii_lowercase + ascii_uppercase + digits).encode())
#: Bytes as terms hold them; all others part terms.
TERM_BYTES = bytes(ord(chr(b).lower()) if b in _kept else b if b > 127 else 32 for b in range(256))
LAST = np.iinfo(np.int64).max


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TERM_BYTES).split()


def _cost(size: float, degree: np.ndarray) -> np.ndarray:
    return degree * np.log2(max(size, 1) / (degree + 1))


class Bisection:
    """The tree of halves: for each of its nodes, in heap order from 1, what each known term says for the left half."""

    def __init__(self, texts: list[list[bytes]], depth: int = DEPTH):
        holders = Counter(t for own in texts for t in set(own))
        self.known = {t: i for i, t in enumerate(sorted((t for t, n in holders.items() if n > 1), key=lambda t: (crc32(t), t)))}
        self.depth, self.says = depth, np.zeros((1 << depth, len(self.known) + 1), np.float32)
        rows = [np.unique([self.known[t] for t in set(own) if t in self.known]).astype(np.int64) for own in texts]
        # documents that share their least terms begin side by side
        self._halve(1, sorted((r for r in rows if len(r)), key=lambda r: r[:4].tolist()))

    def _halve(self, node: int, rows: list[np.ndarray]) -> None:
        if node >= 1 << self.depth or len(rows) < 2:
            return
        flat, at = np.concatenate(rows), np.cumsum([0, *(len(r) for r in rows[:-1])])
        of, size = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), len(self.known)
        left = np.arange(len(rows)) < len(rows) // 2
        for _ in range(ROUNDS):
            a, b = left.sum(), (~left).sum()
            own, other = (np.bincount(flat[side[of]], minlength=size).astype(float) for side in (left, ~left))
            now = _cost(a, own) + _cost(b, other)
            away = now - _cost(a, np.maximum(own - 1, 0)) - _cost(b, other + 1)
            back = now - _cost(a, own + 1) - _cost(b, np.maximum(other - 1, 0))
            gain = np.where(left, np.add.reduceat(away[flat], at), np.add.reduceat(back[flat], at))
            one, two = (np.flatnonzero(side)[np.argsort(-gain[side], kind="stable")] for side in (left, ~left))
            n = min(len(one), len(two))
            swap = int((gain[one[:n]] + gain[two[:n]] > 0).sum())
            left[one[:swap]], left[two[:swap]] = False, True
            if not swap:
                break
        a, b = left.sum(), (~left).sum()
        own, other = (np.bincount(flat[side[of]], minlength=size).astype(float) for side in (left, ~left))
        self.says[node, :size] = _cost(a, own) + _cost(b, other + 1) - _cost(a, own + 1) - _cost(b, other)
        self._halve(2 * node, [r for r, s in zip(rows, left, strict=True) if s])
        self._halve(2 * node + 1, [r for r, s in zip(rows, left, strict=True) if not s])

    def leaf(self, terms: list[bytes]) -> int:
        """Where a document with these different terms goes, from 0."""
        ids = [i for i in map(self.known.get, terms) if i is not None]
        node = 1
        while node < 1 << self.depth:
            node = 2 * node + int(self.says[node, ids].sum() <= 0)
        return node - (1 << self.depth)


def fit(docs: DataFrame) -> Bisection:
    """The halving of a sample of about FIT rows, which the driver holds."""
    share = FIT / max(1, docs.count())
    chosen = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(1 << 30)) < int(share * (1 << 30))
    texts = docs.filter("text is not null").filter(chosen).select(F.substring("text", 1, FIT_CHARS).alias("text")).collect()
    return Bisection([terms_of(r["text"]) for r in texts])


FORWARD = "doc_id long, n long, leaf int, size int, terms binary, tf binary"


def forward(docs: DataFrame, halves: Bisection) -> DataFrame:
    """(doc_id, n terms, leaf, size different terms, terms, tf) of each document that has terms, stored."""
    sent = docs.sparkSession.sparkContext.broadcast(halves)  # 2^DEPTH numbers a term of the sample, at most FIT * FIT_CHARS / 4 terms
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("leaf", pa.int32()), ("size", pa.int32()), ("terms", pa.binary()), ("tf", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                terms = terms_of(text.as_py())
                if not terms:
                    continue
                own = Counter(terms)
                rows.append((doc_id, len(terms), sent.value.leaf(list(own)), len(own), b" ".join(own), array("I", own.values()).tobytes()))
                held += len(rows[-1][4])
                if held > 1 << 24:
                    yield _arrow(rows, schema)
                    rows, held = [], 0
            if rows:
                yield _arrow(rows, schema)

    return written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FORWARD), "forward")


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


SHARDS = "shard long, terms array<string>, df array<int>, top array<int>, ids binary, places binary, impacts binary"


def build_index(docs: DataFrame) -> tuple[DataFrame, int]:
    """The stored shards (SHARDS) of docs (doc_id, text), and N, the documents with terms."""
    rows = forward(docs, fit(docs))
    leaves = rows.groupBy("leaf").agg(F.count("*").alias("docs"), F.sum("n").alias("n"), F.sum("size").cast("long").alias("size")).collect()  # 2^DEPTH rows
    count, length = sum(r["docs"] for r in leaves), sum(r["n"] for r in leaves)
    parts = [1] * (1 << DEPTH)
    for r in leaves:
        parts[r["leaf"]] = max(1, -(-r["docs"] // SHARD), -(-r["size"] // POSTINGS))
    within = F.pmod(F.xxhash64("doc_id", "n", F.col("_tie")), F.element_at(F.lit(parts), F.col("leaf") + 1).cast("long"))
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).withColumn("shard", F.col("leaf") * F.lit(1 << 40) + within)
    schema = pa.schema([("shard", pa.int64()), ("terms", pa.list_(pa.string())), ("df", pa.list_(pa.int32())), ("top", pa.list_(pa.int32())), ("ids", pa.binary()), ("places", pa.binary()), ("impacts", pa.binary())])

    def shard(number: int, own: list[tuple]) -> pa.RecordBatch:
        place: dict[bytes, int] = {}
        terms, tf = [], []
        for _, _, words, counts in own:
            terms += [place.setdefault(t, len(place)) for t in words.split(b" ")]
            tf.append(np.frombuffer(counts, np.uint32))
        term, tf, each = np.array(terms, np.int64), np.concatenate(tf).astype(np.int64), [len(c) // 4 for *_, c in own]
        m = np.repeat(np.array([100 - B + B * n * count // length for _, n, _, _ in own], np.int64), each)
        impact = UNIT * tf // (1000 * tf + RISE * m)
        order = np.argsort(term, kind="stable")
        df = np.bincount(term)
        top = np.maximum.reduceat(impact[order], np.cumsum(df) - df)
        doc = np.repeat(np.arange(len(own), dtype=np.uint32), each)[order]
        ids = np.array([LAST if i is None else i for i, *_ in own], np.int64)
        row = (number, [t.decode() for t in place], df.astype(np.int32), top.astype(np.int32), ids.tobytes(), doc.tobytes(), impact[order].astype(np.int32).tobytes())
        return _arrow([row], schema)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, own = None, []
        for batch in batches:
            for at, *row in zip(*batch.columns, strict=True):
                at = at.as_py()
                if at != number and own:
                    yield shard(number, own)
                    own = []
                number = at
                own.append(tuple(x.as_py() for x in row))
        if own:
            yield shard(number, own)

    dealt = dealt.select("shard", "doc_id", "n", "terms", "tf").repartition("shard").sortWithinPartitions("shard")
    return written(dealt.mapInArrow(build, SHARDS), "shards"), count


def asked(items: DataFrame) -> DataFrame:
    """(item, item_id, term, times), stored: the terms of the different rows of items (item_id, text)."""
    schema = pa.schema([("item", pa.int64()), ("item_id", pa.int64()), ("term", pa.string()), ("times", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, item_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = Counter(terms_of(text))
                if own:
                    yield _arrow([(item, item_id, t.decode(), n) for t, n in own.items()], schema)

    different = written(items.select(F.col("item_id").cast("long"), "text").distinct().withColumn("item", F.monotonically_increasing_id()), "items")
    return written(different.select("item", "item_id", "text").mapInArrow(run, "item long, item_id long, term string, times long"), "asked")


def search(shards: DataFrame, count: int, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best documents of a stored index for each of items (item_id, text).

    Items go in blocks of about ITEM_TERMS terms, which every task gets whole; no shard is shuffled.
    """
    terms = asked(items)
    held = shards.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).select(F.col("x.terms").alias("term"), "x.df")
    ratio = F.lit(float(2 * count + 2)) / (2 * F.sum("df") + 1).cast("double")
    weights = held.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.floor(1000 * F.log(ratio)).cast("long").alias("w"))
    weighed = written(terms.join(weights, "term").select("item", "item_id", "term", (F.col("times") * F.col("w")).alias("w")), "weighed")
    blocks, found = -(-weighed.count() // ITEM_TERMS) or 1, None
    for b in range(blocks):
        rows = weighed.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).select("item", "term", "w").collect()
        queries: dict[int, list[tuple[str, int]]] = {}
        for r in rows:
            queries.setdefault(r["item"], []).append((r["term"], r["w"]))
        own = _visited(shards, queries, k)
        found = own if found is None else found.unionByName(own)
    ids = weighed.select("item", "item_id").distinct()
    return _best(found, k).join(ids, "item").select("item_id", "rank", F.when(F.col("doc_id") != LAST, F.col("doc_id")).alias("doc_id"), "score")


def _bounds(terms: list[str], top: np.ndarray, queries: dict[int, list[tuple[str, int]]]) -> tuple[dict[str, int], dict[int, int]]:
    """The places of a shard's terms, and what each query could reach in it."""
    at = dict(zip(terms, range(len(terms)), strict=True))
    reach = {t: int(top[at[t]]) for t in {t for q in queries.values() for t, _ in q} if t in at}
    return at, {item: sum(w * reach[t] for t, w in q if t in reach) for item, q in queries.items()}


def _numbers(x: pa.ListScalar) -> np.ndarray:
    return x.values.to_numpy(zero_copy_only=False)


def _visited(shards: DataFrame, queries: dict[int, list[tuple[str, int]]], k: int) -> DataFrame:
    """(item, doc_id, score): the k best documents of each query with scores above 0, shards being visited in bands of falling bounds."""
    context = shards.sparkSession.sparkContext
    sent = context.broadcast(queries)  # about ITEM_TERMS terms

    def most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: Counter = Counter()
        for batch in batches:
            for terms, top in zip(*batch.columns, strict=True):
                for item, n in _bounds(terms.as_py(), _numbers(top), sent.value)[1].items():
                    best[item] = max(best[item], n)
        if best:
            yield _arrow(list(best.items()), pa.schema([("item", pa.int64()), ("bound", pa.int64())]))

    reached = shards.select("terms", "top").mapInArrow(most, "item long, bound long").groupBy("item").agg(F.max("bound").alias("bound"))
    high = {r["item"]: r["bound"] for r in reached.collect()}  # of a block of items
    tenth, opened, found = dict.fromkeys(high, 1), {i: n + 1 for i, n in high.items()}, None
    for share in BANDS:
        cut = {i: max(1, n - int((n - tenth[i]) * share)) for i, n in high.items()}
        visits = _visit(shards, sent, context.broadcast((cut, opened)), k)
        found = written(_best(visits if found is None else found.unionByName(visits), k).drop("rank"), "found")
        opened = {i: min(opened[i], cut[i]) for i in high}
        tenth |= {r["item"]: r["tenth"] for r in found.groupBy("item").agg(F.min("score").alias("tenth"), F.count("*").alias("n")).filter(F.col("n") == k).collect()}
    return found


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of found (item, doc_id, score), with their rank."""
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _visit(shards: DataFrame, sent, band, k: int) -> DataFrame:
    """(item, doc_id, score): in each shard the k best documents of those queries whose bound lies in the band, from its cut up to what has been opened."""
    schema = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, (cut, opened) = sent.value, band.value
        for batch in batches:
            for terms, df, top, ids, places, impacts in zip(*batch.columns, strict=True):
                at, bounds = _bounds(terms.as_py(), _numbers(top), queries)
                wanted = [i for i, n in bounds.items() if n > 0 and cut[i] <= n < opened[i]]
                if not wanted:
                    continue
                ids, places, impacts = (np.frombuffer(x.as_py(), t) for x, t in ((ids, np.int64), (places, np.uint32), (impacts, np.int32)))
                ends = np.cumsum(_numbers(df))
                for item in wanted:
                    score = np.zeros(len(ids), np.int64)
                    for term, w in queries[item]:
                        i = at.get(term)
                        if i is not None:
                            own = slice(ends[i - 1] if i else 0, ends[i])
                            score[places[own]] += w * impacts[own].astype(np.int64)
                    least = max(1, np.partition(score, -k)[-k] if len(score) > k else 1)
                    some = np.flatnonzero(score >= least)
                    some = some[np.lexsort((ids[some], -score[some]))][:k]
                    if len(some):
                        yield _arrow(list(zip(repeat(item), ids[some].tolist(), score[some].tolist(), strict=False)), schema)

    return shards.select("terms", "df", "top", "ids", "places", "impacts").mapInArrow(run, "item long, doc_id long, score long")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards, count = build_index(table(spark, sf_dir, "documents"))
    return search(shards, count, table(spark, sf_dir, "benchmark"))


_TERMS = rf"regexp_extract_all(translate(text, '{ascii_uppercase}', '{ascii_lowercase}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
counted AS (SELECT r, any_value(doc_id) AS doc_id, any_value(len(terms)) AS n, term, count(*) AS tf FROM (SELECT *, unnest(terms) AS term FROM d) GROUP BY r, term),
total AS (SELECT count(*)::BIGINT AS docs, sum(len(terms))::BIGINT AS length FROM d WHERE len(terms) > 0),
weight AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counted, total GROUP BY term),
i AS (SELECT item_id, row_number() OVER () AS item, {_TERMS} AS terms FROM (SELECT DISTINCT item_id, text FROM benchmark)),
asked AS (SELECT item, any_value(item_id) AS item_id, term, count(*) AS times FROM (SELECT *, unnest(terms) AS term FROM i) GROUP BY item, term),
scored AS (
  SELECT item, r, any_value(item_id) AS item_id, any_value(doc_id) AS doc_id,
    sum(times * w * (({UNIT} * tf) // (1000 * tf + {RISE} * ({100 - B} + ({B} * n * docs) // length))))::BIGINT AS score
  FROM asked JOIN counted USING (term) JOIN weight USING (term), total GROUP BY item, r),
ranked AS (SELECT item_id, (row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST, r))::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= {K}
"""
