"""Every core query with SQL gives the same rows in DuckDB, on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from compare import rows

DATA = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
CORE = {k: f for k, f in entry.queries().items() if "llm" not in f.__module__}


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(CORE))
def test_same_rows(spark, con, name):
    df = CORE[name](spark, DATA)
    got = rows(df.columns, df.collect())
    if name in SQL:
        cur = con.execute(SQL[name])
        cols = [x[0] for x in cur.description]
        assert sorted(cols) == sorted(df.columns)
        assert got == rows(cols, cur.fetchall())


def test_entry_runs(spark):
    if os.path.isdir(DATA):
        assert entry.entry(spark).columns == ["ref_table", "row_id", "node_ref", "state"]
