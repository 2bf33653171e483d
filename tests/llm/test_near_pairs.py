"""The near-dedup stage's candidate pairs: each true one, and few besides; small batches go to Python."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from thermion.llm.common import BATCH, written
from thermion.llm.simhash import _meeting, _sharing, needed


def first(own: list[int], similarity: float) -> list[int]:
    return own[: len(own) - needed(len(own), similarity) + 1]


def test_pairs_of_shared_shingles_are_whole_and_few(spark):
    """Sets that share a passage met once for each of its shingles, and at places after which too little of them is left."""
    rng, sets = random.Random(4), []
    for _ in range(40):  # sets and ones of about the similarity
        base = sorted(rng.sample(range(10**6), rng.randint(1, 200)))
        other = {x if rng.random() > 0.1 else rng.randrange(10**6) for x in base}
        sets += [base, sorted(other), sorted(other | set(rng.sample(range(10**6), len(base) // 9)))]
    passage = rng.sample(range(10**6), 60)
    sets += [sorted({*passage, *rng.sample(range(10**6), 240)}) for _ in range(30)]
    held = [(token, at, i, len(own), i % 7) for i, own in enumerate(sets) for at, token in enumerate(first(own, 0.8))]
    got = _sharing(_meeting(spark.createDataFrame(held, "token long, at int, fp long, n long, group long")), 0.8).collect()
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if i % 7 != j % 7 and len({*a} & {*b}) >= 0.8 * len({*a} | {*b})}
    assert len(want) > 20 and want <= {(r["u"], r["v"]) for r in got}
    of: dict[int, list] = {}
    for token, _, i, n, group in held:
        of.setdefault(token, []).append((i, n, group))
    joined = sum(i > j and g != h and min(n, m) >= 0.8 * max(n, m) for x in of.values() for i, n, g in x for j, m, h in x)
    assert len(got) < 0.15 * joined


def test_batches_to_python_are_small_while_a_table_is_written(spark):
    """At Spark's 10,000 rows and 64 MB a batch of texts filled the executors' and the workers' memory."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    rows = spark.range(0, 12_000, 1, 1).select("id", F.repeat(F.lit("text "), 400).alias("text"))
    seen = np.array(written(rows.mapInArrow(run, "n long, size long"), "batches").select("n", "size").collect())
    assert seen[:, 0].sum() == 12_000 and seen[:, 0].max() <= 4096 and seen[:, 1].max() < 6_000_000
    assert not [k for k in BATCH if k in spark.conf.getAll]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, "500")
    try:
        own = written(rows.mapInArrow(run, "n long, size long"), "batches").agg(F.max("n")).first()[0]
        assert own == 500 and spark.conf.get(name) == "500"
    finally:
        spark.conf.unset(name)
