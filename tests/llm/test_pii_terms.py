"""Terms beside many entities of a text are judged by the texts that hold them."""

from __future__ import annotations

from thermion.llm.pii import disclosing_terms


def test_a_term_beside_many_entities_of_few_texts(spark):
    filler = [(i, f"nothing of note in text number {i}") for i in range(200)]
    lists = [(1000 + k, " ".join(f"zorbax n{k}x{i}@mail.example.com item {k} {i}" for i in range(40)) + f" zorbax head{k} chief@mail.example.com") for k in range(3)]
    docs = spark.createDataFrame(filler + lists, "doc_id long, text string")
    _, pairs = disclosing_terms(docs)
    got = {(r["entity"], r["term"]): r["share"] for r in pairs.collect()}
    assert got["0:chief@mail.example.com", "zorbax"] == 1.0
