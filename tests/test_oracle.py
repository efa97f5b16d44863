"""Every query with SQL against DuckDB, at the smallest scale."""

import datetime
import os

import duckdb
import pytest

from tidemark.plans import oracle, queries

SF = "/root/testdata/sf0.001"
TABLES = "part lineitem events orders nation".split()


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 5) + 0.0
    return v.isoformat() if isinstance(v, datetime.date) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query(spark, duck, name):
    df = queries.ALL[name](spark, SF)
    rel = duck.sql(oracle.SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    cols = sorted(df.columns)
    at = [rel.columns.index(c) for c in cols]
    ours = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    assert ours == sorted(repr([plain(r[i]) for i in at]) for r in rel.fetchall())


def test_all_have_sql():
    assert set(queries.ALL) == set(oracle.SQL)
