"""Every registered query against its DuckDB twin on the smallest tables."""

import glob
import os

import duckdb
import pytest

from corpusloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = [os.path.basename(p)[:-8] for p in glob.glob(f"{SF}/*.parquet")]


def told(v):
    if v is None or v != v:
        return "NULL"
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


def rows(columns, values):
    """Rows as texts, columns by name."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(told(r[i]) for i in order) for r in values)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    own = catalogue.queries()[name](spark, SF)
    got = own.collect()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert len(own.columns) > 0
        return
    other = duck.sql(sql)
    assert sorted(own.columns) == sorted(other.columns)
    assert rows(own.columns, got) == rows(other.columns, other.fetchall())


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
