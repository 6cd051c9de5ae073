"""Each query with an oracle against DuckDB, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from panelcast.plans import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def cell(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, bool) or isinstance(v, str):
        return str(v)
    return repr(float(v) + 0.0) if hasattr(v, "__float__") else str(v)


def as_rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_against_oracle(spark, duck, sf, name):
    df = core.QUERIES[name](spark, sf)
    want = duck.sql(core.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert as_rows(df.columns, df.collect()) == as_rows(want.columns, want.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["stk", "n", "base", "abs", "rel"] and df.count() == 25


def test_registered():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and set(core.QUERIES) <= set(q)
