"""Every registered query with SQL gives the rows of that SQL on the smallest tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from docloom.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v if v is None or isinstance(v, (int, str, bool)) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def compare(spark, duck, query, sql):
    df = query(spark, DATA)
    cols = sorted(df.columns)
    got = duck.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    key = lambda t: tuple((v is None, str(v)) for v in t)
    a = sorted((tuple(normal(r[c]) for c in cols) for r in df.collect()), key=key)
    b = sorted((tuple(normal(r[i]) for i in at) for r in got.fetchall()), key=key)
    assert a == b


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    compare(spark, duck, registry.queries()[name], registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    """Queries without SQL give rows, and none that is all null."""
    got = registry.queries()[name](spark, DATA)
    assert got.count() > 0 and got.dropna("all").count() == got.count()
