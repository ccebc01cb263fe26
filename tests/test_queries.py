"""Every query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from siltstone.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def rounded(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    tidy = lambda rows: sorted((tuple(map(rounded, r)) for r in rows), key=key)
    assert tidy(df.select(cols).collect()) == tidy(want.select(*cols).fetchall())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and rows[0].query_id is not None
    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_two_runs_agree(spark):
    a, b = (sorted(map(tuple, queries.bucket_policy(spark, SF).collect())) for _ in range(2))
    assert a == b


def test_chunks_cover_the_text(spark):
    rows = queries.chunked_documents(spark, SF).where("doc_id < 5").collect()
    assert all(0 < len(r.chunk) <= 551 for r in rows)
