"""The near-dedup stage links texts of the similarity and no others, in groups of any size."""

from __future__ import annotations

import random

from thermion.llm.simhash import shingle_set, similar


def word(rng: random.Random) -> str:
    return "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))


def jaccard(a: str, b: str) -> float:
    x, y = (set(shingle_set(t).tolist()) for t in (a, b))
    return len(x & y) / len(x | y)


def test_less_similar_pairs_stay_apart(spark):
    rng, rows, want = random.Random(14), [], {}
    for i in range(300):
        base = [word(rng) for _ in range(rng.randint(60, 300))]
        near, aim = list(base), rng.uniform(0.55, 0.95)
        while jaccard(" ".join(base), " ".join(near)) > aim:
            near[rng.randrange(len(near))] = word(rng)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(near))]
        want[i] = jaccard(rows[-1][1], rows[-2][1])
    group = {r["doc_id"]: r["component_id"] for r in similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = {i for i in want if group[2 * i + 1] == 2 * i}
    assert all(group[d] in (d, d - 1) for d in group)
    assert not [i for i in linked if want[i] < 0.8]
    alike = [i for i in want if want[i] >= 0.8]
    assert len(alike) > 80 and len(linked) >= 0.95 * len(alike)


def test_copies_of_one_text_hang_together_by_it(spark):
    """Each copy is like the text and less like the other copies; the text's id is not the smallest."""
    rng = random.Random(3)
    base = [word(rng) for _ in range(220)]
    rows = [(500, " ".join(base))]
    for i in range(400):
        own = list(base)
        for at in rng.sample(range(0, 220, 8), 3):
            own[at] = word(rng)
        rows.append((1000 + i if i else 7, " ".join(own)))
    rows += [(5000 + i, " ".join(word(rng) for _ in range(200))) for i in range(50)]
    assert all(jaccard(rows[0][1], t) >= 0.8 for _, t in rows[1:401]) and jaccard(rows[1][1], rows[2][1]) < 0.8
    group = {r["doc_id"]: r["component_id"] for r in similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(group[i] == 7 for i, _ in rows[:401]) >= 0.97 * 401
    assert all(group[5000 + i] == 5000 + i for i in range(50))
