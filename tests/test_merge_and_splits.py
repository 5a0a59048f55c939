import datetime as dt

import pytest
from pyspark.sql import functions as F

from ridgeline import Panel
from ridgeline.functions import sizing
from ridgeline.operators import merge, splits
from ridgeline.panel import BY_STATE, NATIONAL
from ridgeline.plans import views

SF = "/root/testdata/sf0.001"
D = dt.date


def test_half_even_allocation(spark):
    cases = spark.createDataFrame([(D(2020, 1, 1), 5, 7, 10, 3)], "date date, confirmed long, deaths long, new_cases long, new_deaths long")
    demo = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "state string, population_millions double")
    out = merge.allocate_by_population(cases, demo).collect()
    assert len(out) == 2
    assert {(r.confirmed, r.deaths, r.new_cases, r.new_deaths) for r in out} == {(2.0, 4.0, 5.0, 3)}
    assert out[0].estimated_population == 1.0


def test_allocation_is_the_whole_product_and_plans_no_cross_join(spark):
    cases, demo = views.cases(spark, SF), views.demographics(spark, SF)
    out = merge.allocate_by_population(cases, demo)
    assert out.count() == cases.count() * demo.count()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_sources_may_be_absent(spark):
    cases = spark.createDataFrame([(D(2020, 1, 1), 1.0), (D(2020, 1, 2), 2.0)], "date date, new_cases double")
    weather = spark.createDataFrame([(D(2020, 1, 2), "a", 20.0), (D(2020, 1, 2), "b", 30.0)], "date date, state string, temperature_mean double")
    assert merge.merge_national(cases).columns == ["date", "new_cases"]
    assert [r.temperature_mean for r in merge.merge_national(cases, None, weather).orderBy("date").collect()] == [25.0, 25.0]
    with pytest.raises(ValueError):
        merge.master_dataset({})
    with pytest.raises(ValueError):
        merge.master_dataset({"cases": cases}, "state")


def test_union_keeps_missing_columns_as_null(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(3, 4)], "y int, z int")
    assert {tuple(r) for r in merge.union_states([a, b]).collect()} == {(1, 2, None), (None, 3, 4)}


def test_holiday_windows(spark):
    days = spark.createDataFrame([(D(2023, 11, 11),), (D(2023, 11, 14),), (D(2024, 1, 27),)], "date date")
    calendar = merge.holiday_calendar(spark)
    assert calendar.count() == 20
    out = {str(r.date): (r.holiday_diwali, r.holiday_republic_day) for r in merge.holiday_features(days, calendar, merge.HOLIDAY_NAMES).collect()}
    assert out == {"2023-11-11": (1, 0), "2023-11-14": (0, 0), "2024-01-27": (0, 1)}


@pytest.mark.parametrize("view", [views.daily_cases_by_state, views.mobility, views.weather])
def test_views_agree_with_and_without_broadcast(spark, view):
    def rows():
        return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in map(tuple, view(spark, SF).na.fill(-1.0).collect()))

    small = rows()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert not sizing.fits_broadcast(views.table(spark, SF, "customer"))
        plan = view(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan
        assert rows() == small
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def frame(spark, n):
    return spark.range(n).select(F.date_add(F.lit("2020-01-01"), F.col("id").cast("int")).alias("date"), F.col("id").alias("new_cases"))


def test_published_split_sizes(spark):
    out = splits.split_report(splits.split_by_date(frame(spark, 1143), NATIONAL, 0.15, 0.1))
    assert {r.role: r.rows for r in out.collect()} == {"train": 873, "val": 98, "test": 172}


def bounds(df):
    agg = df.groupBy("fold", "role").agg(F.min("new_cases").alias("lo"), (F.max("new_cases") + 1).alias("hi"), F.count(F.lit(1)).alias("n"))
    return {(r.fold, r.role): (r.lo, r.hi) for r in agg.collect() if r.hi - r.lo == r.n}


def test_expanding_folds(spark):
    got = bounds(splits.expanding_folds(frame(spark, 25), NATIONAL, 3, 2))
    assert got == {(0, "train"): (0, 6), (0, "test"): (8, 14), (1, "train"): (0, 12), (1, "test"): (14, 20), (2, "train"): (0, 18), (2, "test"): (20, 25)}


def test_sliding_folds(spark):
    got = bounds(splits.sliding_folds(frame(spark, 30), 10, NATIONAL, 4, 1))
    assert got[(0, "train")] == (0, 10) and got[(0, "test")] == (11, 16)
    assert got[(3, "train")] == (15, 25) and got[(3, "test")] == (26, 30)


def test_folds_stop_when_the_test_would_start_past_the_end(spark):
    got = bounds(splits.expanding_folds(frame(spark, 12), NATIONAL, 5, 4))
    assert (3, "test") not in got and (4, "train") not in got and (2, "test") in got


def test_calendar_folds(spark):
    got = bounds(splits.calendar_folds(frame(spark, 100), 30, 10, NATIONAL, 5, 2))
    assert got == {(0, "train"): (0, 30), (0, "test"): (32, 42), (1, "train"): (0, 62), (1, "test"): (64, 74)}


def test_calendar_fold_without_test_rows_is_dropped(spark):
    gap = frame(spark, 100).filter("new_cases < 31 or new_cases >= 60")
    folds = {r.fold for r in splits.calendar_folds(gap, 30, 10, NATIONAL, 5, 2).select("fold").distinct().collect()}
    assert folds == {1}


def test_splits_are_per_series(spark):
    df = frame(spark, 10).withColumn("state", F.lit("a")).unionByName(frame(spark, 20).withColumn("state", F.lit("b")))
    out = splits.split_report(splits.split_by_date(df, BY_STATE), Panel("date", "state"))
    assert {(r.state, r.role): r.rows for r in out.collect()} == {
        ("a", "train"): 7, ("a", "val"): 1, ("a", "test"): 2, ("b", "train"): 14, ("b", "val"): 2, ("b", "test"): 4,
    }
