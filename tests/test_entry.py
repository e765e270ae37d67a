import math

import duckdb
import pytest
from conftest import SF0001

import __spark_entry__ as entry
from quarry.sources.tables import TABLES


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["query_id", "node_id", "score", "rank"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_oracle_sf0001(spark, con, name):
    df = entry.queries()[name](spark, SF0001)
    cols = df.columns
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(cols) == sorted(rel.columns)
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    dorder = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    a = sorted((tuple(_norm(r[i]) for i in order) for r in df.collect()), key=repr)
    b = sorted((tuple(_norm(r[i]) for i in dorder) for r in rel.fetchall()), key=repr)
    assert a == b
