"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from corpuscle.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else format(v + 0.0, ".9g")
    return str(v) if isinstance(v, bool) or not isinstance(v, int) and not hasattr(v, "as_tuple") else format(float(v), ".9g")


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name not in catalog.SQL:
        assert got
        return
    ref = duck.sql(catalog.SQL[name])
    assert sorted(ref.columns) == cols
    at = [ref.columns.index(c) for c in cols]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in ref.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
