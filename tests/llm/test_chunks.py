"""Chunks against a byte-by-byte version, and the passages found against all windows of 51 words."""

from __future__ import annotations

import random
import re
from collections import defaultdict

from thermion.llm import chunks, registry

from .conftest import corpus

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def slow_ends(data: bytes) -> list[int]:
    h, hashes = 0, []
    for b in data:
        h = ((h << 1) + int(chunks.GEAR[b])) & 0xFFFF
        hashes.append(h)
    out, last, n = [], 0, chunks.APART
    for i in range(len(data)):
        if hashes[i] == max(hashes[max(0, i - n) : i + n + 1]) or i + 1 - last == chunks.MOST or i + 1 == len(data):
            out.append(i + 1)
            last = i + 1
    return out


def test_chunks_equal_a_rolling_hash(monkeypatch):
    monkeypatch.setattr(chunks, "STEP", 5000)
    for _, t, *_ in corpus():
        data = (t or "").encode()
        assert chunks.ends(data) == slow_ends(data)


def holders(rows) -> set:
    """Ids of the documents that hold 51 words in a row that another one holds."""
    own = defaultdict(set)
    for i, t in set(rows):
        data = (t or "").encode()
        at = [m.span() for m in WORD.finditer(data)]
        for (a, _), (_, b) in zip(at, at[chunks.WORDS :], strict=False):
            own[data[a:b]].add((i, t))
    return {i for s in own.values() if len(s) > 1 for i, _ in s}


def found(df) -> set:
    return {r["doc_id"] for r in df.collect()}


def test_documents_of_the_corpus(spark, tables, empty):
    want = holders([(i, t) for i, t, *_ in corpus()])
    assert want and found(registry.QUERIES["op5_chunk_dedup"](spark, tables)) == want
    assert registry.QUERIES["op5_chunk_dedup"](spark, empty).count() == 0


def test_repeated_words_and_lines(spark):
    rng = random.Random(3)
    line = "this line stands in many a page and says nothing at all\n"
    rows = [(i, "ab" * rng.randint(0, 9) + " " + f"w{i} " * rng.randint(0, 9) + unit * times + f" end {i}") for i, (unit, times) in enumerate([(u, n) for u in ("an ", "a ", line) for n in (1, 3, 40, 90, 100, 300)])]
    assert found(chunks.passages(spark.createDataFrame(rows, "doc_id long, text string"))) == holders(rows)


def test_insertions_shift_nothing(spark):
    words = [f"w{i * i % 977}q{i}" for i in range(400)]
    shared = " ".join(words)
    docs = spark.createDataFrame([(1, shared), (2, "something new here, " + shared + " and an end"), (3, "a clean text with nothing shared"), (4, None), (5, "")], "doc_id long, text string")
    rows = chunks.passages(docs.withColumn("start", docs["doc_id"]).withColumn("key", docs["doc_id"])).collect()
    assert {r["doc_id"] for r in rows} == {1, 2} and sorted(r["keeps"] for r in rows) == [False, True]
    assert all((r["n_words"], r["passage_end"] - r["passage_start"]) == (400, len(shared)) for r in rows)
    assert chunks.passages(docs.limit(0)).count() == 0
