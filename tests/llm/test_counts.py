"""Token counts against the library, whole and by chunks of any size."""

from __future__ import annotations

import functools
import random
from collections import Counter

import pytest
from tokenizers import Tokenizer

from thermion.llm import registry
from thermion.llm.counts import chunk_map, chunk_maps, chunk_starts, composed, default_path, scanned, token_counts, total, transducer

from .conftest import corpus

PARTS = ["a", "b", "the", " ", "  ", "\n", "\t", "'", "'s", "'re", "'r", "'l", "'ll", "s", "x", "1", "23", "!", "..", "é", "漢", "字", "<|endoftext|>", "<|", "<|endof", " ", "　", "😀", "٣", "Ⅷ", "\x00", "\x1c", "\x85", "ſ", "İ", "ing", "_", "--", "''"]


@pytest.fixture(scope="module")
def count():
    tokenizer = Tokenizer.from_file(default_path())
    return lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids)


def texts(n: int, longest: int) -> list[str]:
    rng = random.Random(1)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def test_transducer_counts_as_the_library(count):
    machine, rng = transducer(default_path()), random.Random(2)
    for t in [*texts(4000, 14), "x" * 5000, "ab" * 3000, "=" * 3000, " " * 500, "\n \n" * 300, "".join(rng.choice("etaoinsrhld") for _ in range(20_000))]:
        assert machine.count(t) == count(t), t


def test_maps_compose_in_any_order(count):
    machine, rng = transducer(default_path()), random.Random(3)
    for t in texts(600, 40):
        k = rng.randint(1, 9)
        maps = [chunk_map(machine, t[at : at + k]) for at in range(0, max(1, len(t)), k)]
        left = functools.reduce(lambda a, b: composed(machine, a, b), maps)
        while len(maps) > 1:
            at = rng.randrange(len(maps) - 1)
            maps[at : at + 2] = [composed(machine, *maps[at : at + 2])]
        assert total(machine, left) == total(machine, maps[0]) == count(t)


def test_query_counts_every_document(spark, tables, count):
    got = Counter(tuple(r) for r in registry.QUERIES["op11_token_counts"](spark, tables).collect())
    want = Counter((i, len((t or "").encode()), count(t), count(t) > 1024) for i, t, *_ in corpus())
    assert got == want


def test_chunks_and_their_starts(spark, tables, count):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    got = Counter(tuple(r) for r in token_counts(docs, chunk=150).collect())
    assert got == Counter((i, len((t or "").encode()), count(t)) for i, t, *_ in corpus())
    long = docs.filter("doc_id in (3, 78)")
    levels = scanned(chunk_maps(long, default_path(), 100), default_path(), 64)
    assert len(levels) >= 3
    text = dict((i, t) for i, t, *_ in corpus())
    for r in chunk_starts(levels, default_path()).collect():
        assert r["start"] == count(text[r["doc_id"]][: 100 * r["place"]])
        assert r["start"] + r["n_tokens"] == count(text[r["doc_id"]][: 100 * (r["place"] + 1)])


def test_other_files_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError, match="byte-level"):
        transducer(public_tokenizers.path("word_bpe_49k.json"))
