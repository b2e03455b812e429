"""Every query against its SQL in DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from docspark import queries as core

SF = "/root/testdata/sf0.001"


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(list(v)) if isinstance(v, (list, tuple)) else str(v)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in values)


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in core._TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(core.ORACLE))
def test_against_sql(spark, duck, name):
    df = core.QUERIES[name](spark, SF)
    want = duck.sql(core.ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLE)))
def test_runs(spark, name):
    assert core.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
