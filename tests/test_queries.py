"""Every registered core query against its SQL on the smallest tables."""

import datetime as dt
import os

import duckdb
import pytest

import __spark_entry__ as entry
from strandlake.plans import codec_queries, orphan_queries, sequence_queries, store_queries, stream_queries

FOLDER = "/root/testdata/sf0.001"
CORE = {k: s for m in (codec_queries, orphan_queries, sequence_queries, store_queries, stream_queries) for k, s in m.SQL.items()}
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(FOLDER):
        c.execute(f"create view {f.split('.')[0]} as select * from '{FOLDER}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(columns, got):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in got), key=repr)


@pytest.mark.parametrize("name", sorted(CORE))
def test_against_sql(spark, duck, name):
    got = entry.queries()[name](spark, FOLDER)
    want = duck.sql(CORE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
