"""Every query against its SQL, as the driver compares them."""

import datetime as dt
import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lapidary import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return round(float(v), 6) if isinstance(v, float | decimal.Decimal) else v


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    rel = duck.execute(queries.ORACLES[name])
    made = [x[0] for x in rel.description]
    assert sorted(made) == columns
    at = [made.index(c) for c in columns]
    want = sorted(repr([plain(r[i]) for i in at]) for r in rel.fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
