"""Every registered query of the core against its SQL on the smallest tables."""

from __future__ import annotations

import glob
import os

import pytest

import compare
from inkweave.plans import corpus, library, references

DATA = "/root/testdata/sf0.001"
QUERIES = {**references.QUERIES, **corpus.QUERIES, **library.QUERIES}
SQL = {**references.SQL, **corpus.SQL, **library.SQL}
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(t)[:-8]} AS SELECT * FROM '{t}'")
    return c


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(SQL)))
def test_equals_sql(spark, con, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), con.execute(SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert compare.norm(got).tolist() == compare.norm(want).tolist()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    QUERIES[name](spark, DATA).collect()
