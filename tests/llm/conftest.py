from __future__ import annotations

import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else "".join(rng.choice(["an", "er", "tion", "ing", "Sh", "ou", "é", "ble"]) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", ".", ","]) for _ in range(n))


def corpus() -> list[tuple]:
    """Nulls, empty and long texts, exact and near copies, ties, repeated rows, personal data and toxic words."""
    rng = random.Random(7)
    texts: list[str | None] = [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    base = prose(rng, 90)
    near = base.split()
    texts += [base] * 5
    for i in range(6):
        texts.append(" ".join([*near[: 10 * i], "changed", *near[10 * i + 1 :]]))
    texts += [None, None, "", " \t\n", "one", "two words", "ＷＩＤＥ  and é̂\x0b", prose(rng, 5000), "x" * 30_000, "7 " * 3000, "a@b" * 500]
    pii = ["me.1@mail.example.com", "10.0.0.1", "999.1.1.1", "4111 1111 1111 1111", "4111111111111112", "+1 (017) 555-7713", "+123", "a@b.c%d@e.f", "1.2.3.4.5.6.7.8", "00000000000000", "x@y", "+49 30 123 456.7-8"]
    texts += [f"é {v} {prose(rng, 4)} {rng.choice(pii)}" for v in pii]
    for i in range(6):
        texts.append(f"{prose(rng, 12)} Zebulon Quux {i} wrote to zq@mail.example.org {prose(rng, 12)}")
    texts += [f"{prose(rng, 20)} you idiot {prose(rng, 20)} moron {i}" for i in range(40)]
    rows = [(i, t, "en", f"s{i % 4}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "a text without an id", None, None, None), (None, None, None, None, None), (10**15, "far", "en", "s9", 3), (-5, "below", "en", "s1", 5)]
    return rows


@pytest.fixture(scope="session")
def documents(spark):
    return spark.createDataFrame(corpus(), DOCUMENTS)


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory, documents):
    """A folder of tables with every edge case, and extra columns with clashing names."""
    top = str(tmp_path_factory.mktemp("tables"))
    extra = documents.selectExpr("*", "doc_id as of", "text as _hash", "1 as size", "'x' as fp", "2 as bucket", "3 as target", "0 as kind", "'t' as term")
    extra.write.parquet(f"{top}/documents.parquet")
    labels = [(i, 1, int("idiot" in (t or ""))) for i, t, *_ in corpus() if i is not None and 0 <= i < 1000] + [(None, 1, 1), (5, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return top


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], DOCUMENTS).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{top}/embeddings.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{top}/pages.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top
