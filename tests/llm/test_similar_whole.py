"""The near-dedup stage's groups are those of all pairs of texts of the similarity, whatever their fingerprints."""

from __future__ import annotations

import random

import numpy as np
import pytest

from thermion.llm.simhash import _in_common, differ, needed, prefix, similar, sketch


def word(rng: random.Random) -> str:
    return "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))


def brute(rows: list[tuple[int, str]]) -> dict[int, int]:
    """The smallest id that each is connected with by pairs of a 5-word Jaccard of 0.8 and more."""
    sets = [(i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set()) for i, t in rows]
    of = {i: i for i, _ in rows}

    def top(i: int) -> int:
        while of[i] != i:
            i = of[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a == b or len(a & b) >= 0.8 * len(a | b):
                x, y = top(i), top(j)
                of[max(x, y)] = min(x, y)
    return {i: top(i) for i in of}


def found(spark, rows, **more) -> dict[int, int]:
    return {r["doc_id"]: r["component_id"] for r in similar(spark.createDataFrame(rows, "doc_id long, text string"), **more).collect()}


@pytest.mark.parametrize("most", [2048, 60])
def test_a_large_group_of_copies_more_and_less_alike(spark, most):
    """Of hundreds of copies many are like some others only, and none of these need be the first or a close one."""
    rng, rows = random.Random(12), []
    base = [word(rng) for _ in range(150)]
    for i in range(240):
        own = list(base)
        for at in rng.sample(range(len(own)), rng.choice([1, 2, 3, 4, 4, 5, 5, 6])):
            own[at] = word(rng)
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, " ".join([*base[: 5 * i], *(word(rng) for _ in range(100))])) for i in range(25)]
    want = brute(rows)
    assert 20 < len(set(want.values())) < 200
    assert found(spark, rows, most=most) == want


def test_every_pair_of_the_similarity_is_linked(spark):
    """Pairs at and near the similarity, whose fingerprints may differ by more than the radius or share no key."""
    rng, rows = random.Random(5), []
    for i in range(400):
        base = [word(rng) for _ in range(rng.randint(5, 120))]
        near = list(base)
        for _ in range(max(1, len(base) // 45)):
            near[rng.choice([0, -1, rng.randrange(len(near))])] = word(rng)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(near))]
    rows += [(5000, "one two three four five six seven eight"), (5001, "one two three four five six seven eight nine")]
    want = brute(rows)
    assert sum(i != j for i, j in want.items()) > 100
    assert found(spark, rows) == want


def test_one_fingerprint_of_different_texts(spark):
    """A shingle that makes up most of a text is its fingerprint, whatever else the text says."""
    rng = random.Random(6)
    rows = [(i, " ".join(["7"] * 400 + [word(rng) for _ in range(100)])) for i in range(4)]
    rows += [(9, rows[0][1].upper()), (10, "7 " * 500), (11, "7 " * 700), (12, ""), (13, " \n")]
    want = brute(rows)
    assert [want[i] for i in (1, 2, 3, 9, 11, 13)] == [1, 2, 3, 0, 10, 12]
    assert found(spark, rows) == want


def test_first_shingles_and_counts_of_common_ones():
    rng = np.random.default_rng(3)
    tokens = np.unique(rng.integers(1, 1 << 63, 60).astype(np.uint64))
    frequent = rng.permutation(tokens)[:40]
    order = np.argsort(frequent)
    sets = [np.sort(rng.choice(tokens, rng.integers(1, 31), replace=False)) for _ in range(400)]
    for x in list(sets):  # and near ones
        sets.append(np.unique(np.r_[x[rng.integers(0, len(x)) :], x[: len(x) - 1]]))
    first = [set(prefix(x, frequent[order], order, 0.8).tolist()) for x in sets]
    both = _in_common(np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets]), len(sets))
    for i, x in enumerate(sets):
        assert len(first[i]) == min(len(x), len(x) - needed(len(x), 0.8) + 1)
        for j in range(i):
            n = len(np.intersect1d(x, sets[j]))
            assert both[i, j] == both[j, i] == n
            if n >= 0.8 * (len(x) + len(sets[j]) - n):
                assert first[i] & first[j]


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(4)
    every = np.unique(rng.integers(1, 1 << 63, 9000).astype(np.uint64))
    for n in (0, 1, 40, 300, 700, 5000):
        a = np.sort(rng.choice(every, n, replace=False))
        for m in (0, 3, 260, 1100, 6000):
            b = np.unique(np.r_[a[: m // 2], rng.choice(every, m, replace=False)])
            assert differ(sketch(a), sketch(b)) <= len(np.setxor1d(a, b))
    assert differ(sketch(every[:400]), sketch(every[400:800])) > 0.2 / 1.8 * 800  # sets of nothing in common are told apart
