"""Every registered query of the engine against its SQL, and the driver contract."""

import duckdb
import pytest

import __spark_entry__ as entry
from meridian.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return con


def plain(rows):
    return sorted((tuple(str(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = plain(df.select(*[f"`{c}`" for c in cols]).collect())
    if name in registry.SQL:
        rel = db.sql(registry.SQL[name])
        assert sorted(rel.columns) == cols
        assert got == plain(rel.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall())
    else:
        assert got


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(registry.QUERIES) <= set(entry.queries())
