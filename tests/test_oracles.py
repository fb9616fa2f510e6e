"""Every registered query against its checking SQL on the smallest tables, and stability of the ones without SQL."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from siteloom.plans.tables import LANDED

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in LANDED:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    result = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)
    assert [tuple(map(str, r)) for r in ours] == [tuple(map(str, r)) for r in theirs]


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    df = entry.queries()[name](spark, SF)
    assert df.count() > 0 and len(df.columns) > 1


def test_entry(spark):
    assert entry.entry(spark).count() == 10
