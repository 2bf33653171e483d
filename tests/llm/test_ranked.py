"""Ranked search against a plain version and its SQL, whatever the shards."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from thermion.llm import ranked, registry

from .conftest import corpus

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text: str | None) -> list[str]:
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs: list[tuple], items: list[tuple]) -> Counter:
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    df, length = Counter(t for _, c, _ in held for t in c), sum(n for *_, n in held)
    out = Counter()
    for item_id, text in set(items):
        found = []
        for i, c, n in held:
            m = 100 - 75 + (75 * n * len(held)) // length
            s = sum(math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0))
        for rank, (s, none, i) in enumerate(sorted(found)[:10], 1):
            out[item_id, rank, None if none else i, -s] += 1
    return out


ITEMS = [(1, corpus()[3][1]), (2, "the THE of é idiot"), (3, None), (4, ""), (5, "notthere"), (6, "you"), (6, "Zebulon Quux"), (None, "one two words"), (7, "x" * 30_000), (8, "İ ＷＩＤＥ é̂ a.b@c"), (2, "the THE of é idiot"), (9, corpus()[61][1])]


@pytest.fixture(scope="module")
def folder(spark, tables):
    spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 as item", "'x' as term").write.parquet(f"{tables}/benchmark.parquet")
    return tables


def test_query_over_edge_cases(spark, folder):
    got = Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in registry.QUERIES["op13_ranked_search"](spark, folder).collect())
    assert got == plain([(i, t) for i, t, *_ in corpus()], ITEMS)
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
    assert got == Counter(con.execute(f"SELECT item_id, rank, doc_id, score FROM ({registry.SQL['op13_ranked_search']})").fetchall())


def test_small_shards_and_blocks_of_items(spark, folder, monkeypatch):
    monkeypatch.setattr(ranked, "SHARD", 3)
    monkeypatch.setattr(ranked, "POSTINGS", 400)
    shards, count = ranked.build_index(spark.read.parquet(f"{folder}/documents.parquet"))
    assert shards.count() > 12
    monkeypatch.setattr(ranked, "ITEM_TERMS", 12)
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    got = Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in ranked.search(shards, count, items).collect())
    assert got == plain([(i, t) for i, t, *_ in corpus()], ITEMS)


def test_bisection_parts_topics():
    """Two vocabularies dealt alternately end up in different halves, and in leaves of their own."""
    texts = [[f"{'ab'[i % 2]}{(i * k) % 17}".encode() for k in range(1, 12)] for i in range(60)]
    halves = ranked.Bisection(texts, 3)
    sides = defaultdict(set)
    for i, own in enumerate(texts):
        sides[halves.leaf(own) >> 2].add(i % 2)
    assert sorted(map(len, sides.values())) == [1, 1]


def test_shards_below_the_tenth_score_stay_closed(spark):
    """Of forty shards only those that can hold one of the ten best are opened."""
    from thermion.llm.common import written

    docs = spark.createDataFrame([(i, f"common w{i % 40} " + "rare " * (i % 40 == 7)) for i in range(4000)], "doc_id long, text string")
    shards, count = ranked.build_index(docs)
    queries = {0: [("rare", 4000), ("common", 1)]}
    context = spark.sparkContext
    best = written(ranked._visited(shards, queries, 10), "best")
    tenth = best.agg({"score": "min"}).first()[0]
    could = sum(1 for r in shards.select("terms", "top").collect() if ranked._bounds(r["terms"], ranked.np.array(r["top"]), queries)[1][0] >= tenth)
    assert best.count() == 10 and 0 < could < shards.count()
    # a band from the tenth score up opens just those: each gives at most ten rows
    band = context.broadcast(({0: tenth}, {0: 1 << 60}))
    assert 10 <= ranked._visit(shards, context.broadcast(queries), band, 10).count() <= 10 * could
