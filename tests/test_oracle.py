"""Every query that has SQL gives what DuckDB gives, on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from quantloom.plans import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else round(float(v), 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.date() if v.time() == datetime.time() else v
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_as_duckdb(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = duck.execute(ORACLE[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(row[names.index(c)]) for c in columns) for row in result.fetchall()), key=repr)
    assert got == want


def test_every_query_has_sql():
    assert not set(QUERIES) - set(ORACLE)


def test_plans_have_no_cartesian_product_and_little_python(spark):
    for name in ("return_matrix", "risk_metrics", "fx_convert", "portfolio_series", "membership_intervals"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "Python" not in plan and "Arrow" not in plan, name
