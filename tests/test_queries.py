"""Every query with SQL against DuckDB on the smallest tables; the others give rows of a stable schema."""

import decimal
import math
import os

import duckdb
import pytest

from quillgraph.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, decimal.Decimal):
        raise AssertionError("a decimal: the SQL has to cast it")
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for name in os.listdir(sf):
        con.execute(f"create view {name.split('.')[0]} as select * from '{sf}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_is_its_sql(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    got = df.collect()
    result = duck.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    mine = sorted(repr([plain(r[c]) for c in order]) for r in got)
    assert mine == sorted(repr([plain(r[columns.index(c)]) for c in order]) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(name, spark, sf):
    df = QUERIES[name](spark, sf)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["paper_id", "label", "rank", "value"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
