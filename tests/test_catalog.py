"""Every registered query of the reference's kind against its SQL, on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest
from thermion.plans import catalog, field, flights, formats, habits, lists, logs, lookups, rates, tasks  # noqa: F401

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", list(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    got = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    found = duck.execute(catalog.SQL[name])
    columns = [c[0] for c in found.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    assert sorted(columns) == sorted(df.columns)
    assert got == sorted(tuple(plain(r[i]) for i in order) for r in found.fetchall())


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.SQL])
def test_query_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0
