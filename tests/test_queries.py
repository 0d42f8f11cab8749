"""Every query against its SQL on small tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v if isinstance(v, (bool, int, str)) else str(v)


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(data):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{data}/{f}')")
    return c


def names():
    return [n for n in entry.queries() if n in entry.oracle_sql()]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", names())
def test_query_equals_sql(spark, data, db, name):
    df = entry.queries()[name](spark, data)
    want = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    order = sorted(columns)
    assert sorted(df.columns) == order
    at = [columns.index(c) for c in order]
    a = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    b = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert a == b


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in entry.oracle_sql()])
def test_other_queries_run(spark, data, name):
    assert entry.queries()[name](spark, data).limit(1).count() == 1


def test_entry(spark):
    assert entry.entry(spark).count() > 0
