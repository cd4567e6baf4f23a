"""Every registered query runs at the smallest scale and agrees with its SQL."""

import math

import duckdb
import pytest

import __spark_entry__ as e
from plumewalk.plans.catalog import REGISTRY

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def norm(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, duck, name):
    df = e.queries()[name](spark, SF)
    got = df.collect()
    sql = e.oracle_sql().get(name)
    if sql is None:
        assert got, name
        return
    cur = duck.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    cols = sorted(names)
    want = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    have = sorted(tuple(norm(r[c]) for c in cols) for r in got)
    assert have == want


def test_entry_has_rows(spark):
    assert e.entry(spark).count() > 0


def test_all_are_registered():
    assert set(REGISTRY) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
