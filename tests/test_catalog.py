"""Every registered query runs, and equals its SQL twin where it has one."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from ridgeline.plans.catalog import load

SF = "/root/testdata/sf0.001"
TABLES = "nation customer supplier orders lineitem".split()
CATALOG = load()
TWINS = sorted(n for n, e in CATALOG.items() if e.sql is not None)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canonical(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


@pytest.mark.parametrize("name", TWINS)
def test_query_equals_its_twin(spark, con, name):
    df = CATALOG[name].run(spark, SF)
    cur = con.execute(CATALOG[name].sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    cols = sorted(names)
    want = Counter(tuple(canonical(dict(zip(names, row))[c]) for c in cols) for row in cur.fetchall())
    got = Counter(tuple(canonical(row[c]) for c in cols) for row in df.collect())
    assert got == want


def test_entry_and_contract(spark):
    df = entry.entry(spark)
    assert df.columns == ["date", "new_cases", "new_cases_7day_avg", "new_cases_lag_7"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


def test_flagship_plan_is_one_aggregate_and_one_window_exchange(spark):
    plan = entry.queries()["national_daily"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 2
    assert "ReadSchema: struct<o_orderdate:timestamp_ntz>" in plan


def test_features_share_one_exchange(spark):
    from ridgeline.operators import features
    from ridgeline.panel import BY_STATE

    df = spark.read.parquet(f"{SF}/orders.parquet").selectExpr("o_orderpriority state", "date(o_orderdate) date", "o_custkey new_cases")
    out = features.growth_features(features.rolling_features(features.lag_features(df, BY_STATE), BY_STATE), BY_STATE)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1
