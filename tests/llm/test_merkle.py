"""The manifest against a plain tree, and against its SQL."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import duckdb
import pytest

from thermion.llm import merkle, registry
from thermion.llm.common import written

from .conftest import DOCUMENTS


def digest(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars) -> str:
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def levels(nodes: list[str]) -> list[list[str]]:
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][at : at + 16])) for at in range(0, len(out[-1]), 16)])
    return out


def path(tree: list[list[str]], i: int) -> list[tuple[str, str]]:
    out = []
    for level in tree[:-1]:
        first = i // 16 * 16
        out.append(("".join(level[first:i]), "".join(level[i + 1 : first + 16])))
        i //= 16
    return out


def plain(rows: list[tuple]) -> Counter:
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees, order = {}, {}
    for s in sources:
        own = sorted(((r[0] is not None, r[0] or 0, leaf(*r), r) for r in rows if r[3] == s), key=lambda x: x[:3])
        order[s], trees[s] = [r for *_, r in own], levels([h for _, _, h, _ in own])
    top = levels([trees[s][-1][0] for s in sources])
    out = Counter()
    for k, s in enumerate(sources):
        for i, r in enumerate(order[s]):
            pairs = path(trees[s], i) + path(top, k)
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            h = leaf(r[0], r[1] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]), *r[2:]) if bad else leaf(*r)
            for a, b in pairs:
                h = digest(a + h + b)
            out[r[0], leaf(*r), trees[s][-1][0], top[-1][0], digest("".join(a + b for a, b in pairs)), h, h == top[-1][0]] += 1
    return out


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def check(spark, folder: str) -> Counter:
    rows = [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = Counter(tuple(r[c] for c in COLUMNS) for r in registry.QUERIES["op12_merkle_manifest"](spark, folder).collect())
    assert got == plain(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    found = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({registry.SQL['op12_merkle_manifest']})").fetchall()
    assert got == Counter(found)
    return got


def test_manifest_over_edge_cases(spark, tables):
    got = check(spark, tables)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("sizes", [[1], [16], [17], [300, 1, 16, 257], [1] * 40])
def test_manifest_of_any_shape(spark, tmp_path, sizes):
    rows = [(100 * k + i if i % 50 else 7, f"Text {i}", None, f"s{k}" if k else None, i) for k, n in enumerate(sizes) for i in range(n)]
    spark.createDataFrame(rows, DOCUMENTS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    check(spark, str(tmp_path))


def test_places_in_runs(spark):
    rows = written(spark.range(0, 1000, 1, 7).selectExpr("case when id < 700 then 'hot' else cast(id % 9 as string) end as part", "(id * 7919) % 1000 as v"), "t")
    got = [tuple(r) for r in merkle.numbered(rows, ["v"], "runs").select("part", "v", "node", "total").collect()]
    of: dict = {}
    for part, v, *_ in got:
        of.setdefault(part, []).append(v)
    assert sorted(got) == sorted((p, v, i, len(own)) for p, own in of.items() for i, v in enumerate(sorted(own)))
