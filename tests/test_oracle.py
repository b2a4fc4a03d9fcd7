"""Every core query against its SQL on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from reelspark.plans import registry

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


def plain(v):
    if v is None or v != v:
        return None
    return round(v, 5) + 0.0 if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for name in os.listdir(sf):
        c.sql(f"create view {name[:-8]} as from read_parquet('{sf}/{name}')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    got = [tuple(plain(v) for v in r) for r in df.collect()]
    if name not in ORACLE:
        assert df.columns
        return
    want = duck.sql(ORACLE[name])
    at = [want.columns.index(c) for c in df.columns]
    assert sorted(want.columns) == sorted(df.columns)
    assert Counter(got) == Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall())
