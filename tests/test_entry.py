"""Every registered query against its DuckDB oracle on sf0.001."""

import datetime as dt
import json

import duckdb
import pytest

import __spark_entry__ as E
from lakesync.plans.suite import QUERIES

from conftest import SF0001

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def _norm(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=lambda t: json.dumps(t, default=str))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    return c


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["event_id", "user_id", "event_date", "ts", "event_type", "value"]


def test_every_query_has_an_oracle():
    assert set(E.oracle_sql()) >= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF0001)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    res = con.sql(E.oracle_sql()[name])
    want = _rows(res.columns, res.fetchall())
    assert sorted(df.columns) == sorted(res.columns)
    assert got == want
