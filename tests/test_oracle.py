"""Every query with SQL gives the same rows in DuckDB, on the smallest tables."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from skerry.plans import oracle, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def value(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(oracle.ORACLES)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    got = entry.queries()[name](spark, SF)
    cols = sorted(got.columns)
    rows = Counter(tuple(value(r[c]) for c in cols) for r in got.collect())
    want = con.execute(oracle.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert rows == Counter(tuple(value(r[i]) for i in at) for r in want.fetchall())
