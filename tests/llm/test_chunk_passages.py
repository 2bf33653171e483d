"""Passages of just over 50 short words are found, up to their true edges."""

from __future__ import annotations

import random

from thermion.llm import chunks


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 4))) for _ in range(n))


def test_passages_of_51_short_words(spark):
    rng, rows, want = random.Random(11), [], {}
    for i in range(200):
        shared = words(rng, 51)
        for at in (i, 1000 + i):
            head = words(rng, rng.randint(5, 60))
            rows.append((at, f"{head}# {shared} {at % 7}{words(rng, 20)}"))
            want[at] = len(head)
    rows += [(2000 + i, words(rng, 120)) for i in range(50)]
    rows += [(3000 + i, f"{words(rng, 30)} {t}{words(rng, 30)}") for i, t in enumerate([words(rng, 30)] * 2)]
    found = chunks.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in found} <= set(want)  # neither unrelated texts nor 30 shared words
    texts, held = dict(rows), {frozenset((r["doc_id"], r["kept_id"])): r for r in found if not r["keeps"]}
    assert len(held) >= 190 and {r["doc_id"] for r in found if r["keeps"]} == {r["kept_id"] for r in held.values()}  # some hold no whole chunk
    for r in held.values():
        i, j = r["doc_id"], r["kept_id"]
        assert r["n_words"] == 51 and abs(i - j) == 1000
        (a, s), (b, t) = (want[i], texts[i]), (want[j], texts[j])
        before = next(k for k in range(min(a, b) + 1) if k == min(a, b) or s[a - 1 - k] != t[b - 1 - k])
        after = next(k for k in range(len(s)) if s[a + k] != t[b + k])
        assert (r["passage_start"], r["passage_end"]) == (a - before, a + after)


def test_words_cut_at_an_edge_do_not_count():
    assert chunks.same(b"xlog one two ca", b"ylog one two cx") == (2, 1, 14)
    assert chunks.same(b"log one two", b"log one two") == (3, 0, 11)
    assert chunks.same(b"log one two", b"log one two", (97, 32))[0] == 2
    assert chunks.same(b"log one two", b"log one two", (32, 32), (32, 97))[0] == 2
    assert chunks.same(b"", b"a") == (0, 0, 0)


def test_passages_whose_pieces_stand_elsewhere_too(spark):
    """Pairs share 100 words; pieces of 25, 40 and 49 of these stand in 8 other texts each, of which none shares over 50 words with any."""
    for piece in (25, 40, 49):
        rng, rows = random.Random(piece), []
        for i in range(40):
            shared = words(rng, 100).split()
            rows += [(at, f"{words(rng, 30)} {' '.join(shared)} {words(rng, 30)}") for at in (i, 1000 + i)]
            for k in range(8):
                at = rng.randint(0, 100 - piece)
                rows.append((10_000 + 8 * i + k, f"{words(rng, 20)} {' '.join(shared[at : at + piece])} {words(rng, 20)}"))
        found = chunks.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        pairs = {frozenset((r["doc_id"], r["kept_id"])) for r in found if not r["keeps"]}
        assert sum(frozenset((i, 1000 + i)) in pairs for i in range(40)) >= 38
        assert {r["doc_id"] for r in found} <= {i for i, _ in rows if i < 2000}
        assert all(95 < r["n_words"] < 106 for r in found if not r["keeps"] and r["doc_id"] % 1000 == r["kept_id"] % 1000)
