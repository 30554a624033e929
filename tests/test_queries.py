"""Every query against its SQL, on the small tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from elevata import plans

SF = "/root/testdata/sf0.001"


def value(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{t}')")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_oracle(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    want = duck.execute(plans.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = lambda rs: sorted(([value(x) for x in r] for r in rs), key=repr)
    assert rows(tuple(r[c] for c in columns) for r in got.collect()) == rows(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_rows(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
