"""Every named query of the relational engine against DuckDB, as bags of rows."""

import glob
import math
import os

import duckdb
import pytest

from lumenq import catalogue

DATA = "/root/testdata/sf0.001"
SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return db


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    frame = catalogue.queries()[name](spark, DATA)
    want = duck.sql(SQL[name])
    assert sorted(frame.columns) == sorted(want.columns)
    order = sorted(range(len(frame.columns)), key=lambda i: frame.columns[i])
    other = sorted(range(len(want.columns)), key=lambda i: want.columns[i])
    got_rows = sorted([plain(r[i]) for i in order] for r in frame.collect())
    want_rows = sorted([plain(r[i]) for i in other] for r in want.fetchall())
    assert got_rows == want_rows
