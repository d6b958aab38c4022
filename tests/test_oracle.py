"""Every registered query against its DuckDB SQL on the same tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest
from lectern.plans import catalog

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6g}"
    if isinstance(x, list):
        return str([plain(y) for y in x])
    return str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    want = duck.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, got) == rows(want.columns, want.fetchall())


def test_sql_belongs_to_queries():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
