"""The driver contract, and every registered query against its DuckDB oracle at sf0.001."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF001

TABLES = ["orders", "events", "documents", "nation", "region", "customer", "supplier", "part", "benchmark", "embeddings"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return round(v, 6) if not math.isnan(v) else "nan"
    return v


def _key(r):
    return tuple((x is None, type(x).__name__, x if x is not None else 0) for x in r)


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 10
    assert df.columns == ["from", "total_volume", "open_rate", "avg_recency_days", "ignorance_score"]


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF001)
    rows = [tuple(_norm(x) for x in r) for r in df.collect()]
    sql = E.oracle_sql().get(name)
    if sql is None:
        assert rows and df.columns
        return
    res = duck.sql(sql)
    assert sorted(res.columns) == sorted(df.columns)
    idx = [res.columns.index(c) for c in df.columns]
    orows = [tuple(_norm(r[i]) for i in idx) for r in res.fetchall()]
    assert sorted(rows, key=_key) == sorted(orows, key=_key)
