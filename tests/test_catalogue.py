"""Every query with SQL against DuckDB on the smallest tables; the rest must run."""

import os

import duckdb
import pytest

from siltstone.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    rows = df.collect()
    if name not in catalogue.oracle_sql():
        assert rows
        return
    want = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(want.columns) == sorted(df.columns)
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(key([r[c] for c in want.columns]) for r in rows) == sorted(map(key, want.fetchall()))
