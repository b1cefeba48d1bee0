"""All queries that have SQL agree with it over the smallest test tables."""

import math
from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as entry_module

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 9) if isinstance(v, float) else v if isinstance(v, (int, bool)) else str(v)


def test_names():
    queries, sql = entry_module.queries(), entry_module.oracle_sql()
    assert set(sql) <= set(queries) and "p1_found" in queries and "p2_found" in queries


@pytest.mark.parametrize("name", sorted(entry_module.oracle_sql()))
def test_against_sql(spark, con, name):
    df = entry_module.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = Counter(tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    relation = con.sql(entry_module.oracle_sql()[name])
    assert sorted(relation.columns) == columns
    assert got == Counter(tuple(plain(v) for v in r) for r in relation.select(*[f'"{c}"' for c in columns]).fetchall())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
