"""Every query of the subpackage with SQL gives the rows of that SQL on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from docloom.llm import queries as Q

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_against_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = duck.execute(Q.SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    shown = lambda v: round(v, 5) if isinstance(v, float) else v
    a = sorted(tuple(shown(r[c]) for c in cols) for r in df.collect())
    assert a == sorted(tuple(shown(r[i]) for i in at) for r in got.fetchall()) and a


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_runs(spark, name):
    assert Q.QUERIES[name](spark, DATA).count() > 0
