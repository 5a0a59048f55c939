import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline import Panel
from ridgeline.operators import clean
from ridgeline.operators.quantiles import exact_quantiles
from ridgeline.panel import NATIONAL

N = None


def test_corrections_below_zero_count_as_zero(daily, ordered):
    df = daily("confirmed long, deaths long, new_cases long", confirmed=[4, 4, 3, 9], deaths=[0, 1, 1, 1], new_cases=[4, 0, -1, 6])
    assert ordered(clean.clean_cases(df), "new_cases") == [4, 0, 0, 6]


def test_derived_columns_have_hand_computed_values(daily, ordered):
    out = clean.cases_derived(daily("confirmed long, deaths long", confirmed=[20, 50, 50, 80], deaths=[1, 1, 5, 4]))
    assert ordered(out, "new_cases") == [0, 30, 0, 30]
    assert ordered(out, "new_cases_7day_avg") == pytest.approx([0, 15, 10, 15])
    assert ordered(out, "case_fatality_rate") == pytest.approx([5, 2, 10, 5])
    assert ordered(out, "growth_rate")[1:] == pytest.approx([150, 0, 60])


def test_interpolation_fills_inner_and_end_gaps(daily, ordered):
    df = daily(new_cases=[N, N, 1.0, N, 3.0, N])
    assert ordered(clean.interpolate_linear(df), "new_cases") == [1, 1, 1, 2, 3, 3]


def test_interpolation_of_a_column_without_values(daily, ordered):
    df = daily(new_cases=[N, N, N])
    assert ordered(clean.interpolate_linear(df), "new_cases") == [N, N, N]


def test_fills(daily, ordered):
    df = daily("v double, s string", v=[N, 1.0, N, 2.0, N], s=["a", N, N, "b", N])
    assert ordered(clean.fill_missing(df, "forward_fill"), "v") == [1, 1, 1, 2, 2]
    assert ordered(clean.fill_missing(df, "forward_fill"), "s") == ["a", "a", "a", "b", "b"]
    assert ordered(clean.fill_missing(df, "backward_fill"), "v") == [1, 1, 2, 2, N]
    assert ordered(clean.fill_missing(df, "mean"), "v") == [1.5, 1, 1.5, 2, 1.5]
    with pytest.raises(ValueError):
        clean.fill_missing(df, "spline")


def test_clip_keeps_nulls(daily, ordered):
    df = daily("new_cases double, deaths double", new_cases=[-1.0, N, 2.0], deaths=[N, -2.0, 0.0])
    out = clean.clip_nonneg(df)
    assert ordered(out, "new_cases") == [0, N, 2]
    assert ordered(out, "deaths") == [N, 0, 0]


def test_clip_iqr_and_zscore_match_numpy(daily, ordered):
    v = [1.0, 2.0, 3.0, 10.0, 4.0, 2.5, 100.0, -50.0]
    q1, q3 = np.percentile(v, [25, 75])
    want = np.clip(v, q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    assert ordered(clean.clip_outliers(daily(new_cases=v), ["new_cases"]), "new_cases") == pytest.approx(list(want))
    mu, sd = np.mean(v), np.std(v, ddof=1)
    want = np.clip(v, mu - sd, mu + sd)
    got = clean.clip_outliers(daily(new_cases=v), ["new_cases"], "zscore", 1.0)
    assert ordered(got, "new_cases") == pytest.approx(list(want))


def test_clip_statistics_can_be_fitted_on_part_of_the_rows(daily, ordered):
    v = [1.0, 2.0, 3.0, 4.0, 1000.0]
    out = clean.clip_iqr(daily(new_cases=v), ["new_cases"], 1.5, fit_on=F.col("date") < "2020-01-05")
    assert max(ordered(out, "new_cases")) == pytest.approx(3.25 + 1.5 * 1.5)


def test_missing_state_and_date_column(spark, daily):
    df = spark.createDataFrame([("Goa",), (None,)], "state string")
    assert {r.state for r in clean.fill_national(df).collect()} == {"Goa", "National"}
    with pytest.raises(ValueError):
        clean.clean_cases(df)


def test_median_ignores_infinities(daily, ordered):
    v = [1.0, float("inf"), N, 4.0, float("nan"), 2.0]
    assert ordered(clean.impute_median(daily(new_cases=v)), "new_cases") == [1, 2, 2, 4, 2, 2]


def test_median_of_a_panel_is_over_the_whole_frame(spark):
    rows = [(s, i, float(v) if v is not None else None) for s, vs in {"a": [1, 2, None], "b": [10, None, 30]}.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "state string, d int, v double").withColumn("date", F.date_add(F.lit("2020-01-01"), F.col("d"))).drop("d")
    out = clean.impute_median(df, Panel("date", "state"), ["v"])
    assert {(r.state, r.v) for r in out.collect()} == {("a", 1.0), ("a", 2.0), ("a", 6.0), ("b", 10.0), ("b", 6.0), ("b", 30.0)}


@pytest.mark.parametrize("n", [1, 2, 7, 1000, 30_000])
def test_bracketed_quantiles_equal_numpy(spark, n):
    rng = np.random.default_rng(n)
    v, w = rng.normal(size=n).round(3), rng.integers(0, 3, n).astype(float)
    df = spark.createDataFrame(list(zip(v.tolist(), w.tolist())), "v double, w double")
    probs = [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = exact_quantiles(df, ["v", "w"], probs).first()
    assert got.v == pytest.approx(list(np.percentile(v, [100 * p for p in probs])), abs=1e-12)
    assert got.w == pytest.approx(list(np.percentile(w, [100 * p for p in probs])), abs=1e-12)


def test_bracketed_quantiles_with_one_hot_group_and_one_hot_value(spark):
    rng = np.random.default_rng(5)
    hot = np.where(rng.random(40_000) < 0.6, 7.0, rng.normal(7, 3, 40_000))
    rows = [("hot", float(x)) for x in hot] + [("cold", float(x)) for x in range(5)] + [("empty", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.v for r in exact_quantiles(df, ["v"], [0.1, 0.5, 0.9], ["k"]).collect()}
    assert got["hot"] == pytest.approx(list(np.percentile(hot, [10, 50, 90])))
    assert got["cold"] == pytest.approx([0.4, 2.0, 3.6])
    assert got["empty"] == [None, None, None]


def test_clean_all_takes_what_is_there(daily):
    out = clean.clean_all({"cases": daily("confirmed double, deaths double", confirmed=[1.0, 2.0], deaths=[0.0, 0.0])}, {})
    assert set(out) == {"cases"} and "growth_rate" in out["cases"].columns


@pytest.mark.parametrize("parts", [2, 4096])
def test_radix_selection_of_awkward_values(spark, parts):
    """Clustered, huge, tiny, signed, infinite and missing values; two parts force many passes."""
    rng = np.random.default_rng(8)
    v = np.concatenate([
        1e9 + rng.random(300) * 1e-6, -rng.random(200) * 1e-300, [0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, np.inf, -np.inf], np.full(150, 3.25), rng.normal(size=200),
    ])
    rows = [(float(x), "a") for x in v] + [(float("nan"), "a"), (None, "a"), (float("nan"), None), (2.0, None), (None, "none")]
    df = spark.createDataFrame(rows, "v double, k string").repartition(3)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    finite = np.sort(v)

    def at(p):
        place = p * (len(finite) - 1)
        lo, hi = finite[int(np.floor(place))], finite[int(np.ceil(place))]
        return lo if lo == hi else lo + (hi - lo) * (place - np.floor(place))

    got = {r.k: r.v for r in exact_quantiles(df, ["v"], probs, ["k"], parts=parts).collect()}
    assert got["a"] == pytest.approx([at(p) for p in probs], rel=1e-15)
    assert got[None] == [2.0] * 7 and got["none"] == [None] * 7
    alone = exact_quantiles(df.filter("k = 'a'"), ["v"], probs, parts=parts).first().v
    assert alone == got["a"]
    assert exact_quantiles(df.limit(0), ["v"], [0.5]).first().v == [None]
    assert exact_quantiles(df.limit(0), ["v"], [0.5], ["k"]).count() == 0


def test_a_callers_column_called_pos_is_data(spark):
    rows = [(dt.date(2020, 1, d), v, p) for d, v, p in ((1, 1.0, 9), (2, None, 9), (3, 3.0, 2))]
    df = spark.createDataFrame(rows, "date date, v double, pos int")
    filled = clean.interpolate_linear(df, NATIONAL, ["v"]).orderBy("date").collect()
    assert [(r.v, r.pos) for r in filled] == [(1.0, 9), (2.0, 9), (3.0, 2)]
    long = Panel("date", segment_rows=2)
    assert [r.v for r in clean.interpolate_linear(df, long, ["v"]).orderBy("date").collect()] == [1.0, 2.0, 3.0]
    from ridgeline.operators.splits import split_by_date

    assert split_by_date(df.withColumn("n", F.lit(7)), NATIONAL, 0.3).orderBy("date").select("role", "pos", "n").collect()[2] == ("test", 2, 7)


def test_daily_means_through_a_lookup_equal_means_of_joined_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), dt.date(2020, 1, int(d)), None if rng.random() < 0.2 else float(rng.integers(0, 9))) for k, d in rng.integers(1, 6, (400, 2))]
    facts = spark.createDataFrame(rows, "k int, date date, parks double")
    lookup = spark.createDataFrame([(i, f"s{i % 2}") for i in range(1, 5)], "k int, state string")
    want = {tuple(r) for r in clean.daily_by_state(facts.join(lookup, "k").drop("k")).collect()}
    got = clean.daily_by_state(facts, lookup=lookup, key="k")
    rounded = {(r[0], r[1], round(r[2], 9)) for r in want}
    assert {(r[0], r[1], round(r[2], 9)) for r in got.collect()} == rounded
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        summed = clean.daily_by_state(facts, lookup=lookup, key="k")
        assert {(r[0], r[1], round(r[2], 9)) for r in summed.collect()} == rounded
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
