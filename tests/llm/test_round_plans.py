"""The rounds of components: right groups, from plans that stay small."""

from __future__ import annotations

import random

from thermion.llm import components


def test_no_plan_of_a_round_holds_a_step_many_times(spark, monkeypatch):
    """As one plan a round read its links 60 times over, and the driver's memory went with it."""
    rng, leaves = random.Random(8), []
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)]
    of = {x: x for link in links for x in link}
    for _ in of:
        for u, v in links:
            of[u] = of[v] = min(of[u], of[v])
    written = components.written

    def counted(df, name):
        leaves.append(df._jdf.queryExecution().analyzed().collectLeaves().size())
        return written(df, name)

    monkeypatch.setattr(components, "written", counted)
    found = components.connected(spark.createDataFrame(links, "u long, v long"))
    assert {r["node"]: r["component"] for r in found.collect()} == of
    assert len(leaves) > 4 and max(leaves) <= 12
