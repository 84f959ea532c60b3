"""Every training-data query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from readloom import llm

SF = "/root/testdata/sf0.001"
SQL = llm.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    got = llm.queries()[name](spark, SF)
    found = con.execute(SQL[name])
    columns = sorted(c[0] for c in found.description)
    at = [[c[0] for c in found.description].index(c) for c in columns]
    want = [tuple(r[i] for i in at) for r in found.fetchall()]
    assert sorted(got.columns) == columns
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(want, key=repr)
