import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest

from ridgeline import Panel
from ridgeline.operators import features

N = None


def test_temporal_and_lag_values(daily, ordered):
    df = daily(start=dt.date(2022, 4, 29), new_cases=[8.0, 6.0, N, 7.0, 5.0])  # a Friday
    out = features.temporal_features(df)
    assert ordered(out, "day_of_week") == [4, 5, 6, 0, 1]
    assert ordered(out, "month") == [4, 4, 5, 5, 5]
    assert ordered(out, "is_weekend") == [0, 1, 1, 0, 0]
    lagged = features.lag_features(df, lags=[2, 3])
    assert ordered(lagged, "new_cases_lag_2") == [N, N, 8, 6, N]
    assert ordered(lagged, "new_cases_lag_3") == [N, N, N, 8, 6]


def test_iso_week_and_holidays(spark):
    days = ["2021-01-01", "2021-01-26", "2021-08-15", "2021-10-02", "2021-10-19", "2021-10-20", "2021-11-30", "2021-10-31", "2021-01-03"]
    df = spark.createDataFrame([(dt.date.fromisoformat(d),) for d in days], "date date")
    got = {str(r.date): r for r in features.temporal_features(df).collect()}
    assert got["2021-01-01"].week_of_year == 53
    assert got["2021-01-03"].day_of_week == 6 and got["2021-01-03"].is_weekend == 1
    assert [got[d].is_major_holiday for d in days] == [0, 1, 1, 1, 0, 1, 1, 0, 0]
    assert got["2021-01-03"].day_of_week_sin == pytest.approx(math.sin(2 * math.pi * 6 / 7))


def test_growth_over_zero_bases(daily, ordered):
    out = features.growth_features(daily(new_cases=[0.0, 0.0, 5.0, 0.0, 10.0]))
    assert ordered(out, "new_cases_growth_rate") == [N, N, 500, -100, 500]
    assert ordered(out, "new_cases_acceleration") == [N, N, N, -100, 100]
    assert ordered(out, "new_cases_cumulative") == [0, 0, 5, 5, 15]


def test_rolling_and_growth_match_pandas(daily, ordered):
    rng = np.random.default_rng(1)
    v = [None if rng.random() < 0.15 else float(rng.integers(0, 9)) for _ in range(120)]
    s = pd.Series(v, dtype=float)
    out = features.growth_features(features.rolling_features(daily(new_cases=v)))

    def close(col, want):
        for a, b in zip(ordered(out, col), want):
            assert (a is None and (b is None or np.isnan(b))) or a == pytest.approx(b, abs=1e-9), col

    for w in (3, 7, 14):
        roll = s.rolling(w, min_periods=1)
        close(f"new_cases_rolling_mean_{w}", roll.mean())
        close(f"new_cases_rolling_std_{w}", roll.std())
        close(f"new_cases_rolling_max_{w}", roll.max())
    pct = s.ffill().pct_change(fill_method=None)
    close("new_cases_growth_rate", (pct * 100).clip(-100, 500))
    close("new_cases_acceleration", (pct.diff() * 100).clip(-100, 100))
    close("new_cases_cumulative", s.cumsum())


def test_left_closed_windows_leave_today_out(daily, ordered):
    out = features.rolling_features(daily(new_cases=[1.0, 2.0, 3.0]), windows=(3,), closed="left")
    assert ordered(out, "new_cases_rolling_mean_3") == [N, 1, 1.5]
    with pytest.raises(ValueError):
        features.rolling_features(daily(new_cases=[1.0]), closed="both")


def test_weather_bins_and_flags(daily, ordered):
    t = [-50.0, 15.0, 15.1, 25.0, 35.0, 50.0, 50.1, N]
    df = daily("temperature_mean double, humidity_mean double, precipitation double", t=t, h=[N, 70.0, 70.5, 0.0] * 2, p=[N, 0.0, 0.1, 1.0] * 2)
    out = features.weather_features(df)
    assert ordered(out, "temp_category_encoded") == [-1, 0, 1, 1, 2, 3, -1, -1]
    assert ordered(out, "temp_category")[1:4] == ["cold", "mild", "mild"]
    assert ordered(out, "humidity_high")[:4] == [0, 0, 1, 0]
    assert ordered(out, "has_precipitation")[:4] == [0, 0, 1, 1]


def test_mobility_index_needs_three_columns(daily, ordered):
    two = features.mobility_index(daily("parks double, transit double", p=[1.0], t=[1.0]))
    assert "mobility_index" not in two.columns
    df = daily("parks double, transit double, residential double", p=[1.0, 1.0], t=[4.0, N], r=[8.0, 8.0])
    assert ordered(features.mobility_index(df), "mobility_index") == [1.0, 2.0]


def test_interactions_only_with_inputs(daily):
    df = daily("mobility_index double, population_millions double", m=[2.0], p=[math.e - 1])
    out = features.interactions(df)
    assert out.first().mobility_pop_interaction == pytest.approx(2.0)
    assert "temp_weekday" not in out.columns


def test_all_features_of_the_published_list(daily):
    """The engineered list: 11 calendar, 4 lags, 9 rolling, 3 growth, index, lags, interaction."""
    mob = ["retail_recreation", "grocery_pharmacy", "transit", "workplaces", "residential"]
    n = 40
    base = {c: [float((i * (j + 3)) % 11) for i in range(n)] for j, c in enumerate(["new_cases", "confirmed", "deaths", "new_deaths", *mob])}
    df = daily(", ".join(f"{c} double" for c in base), **base)
    out = features.build_all_features(df)
    names = features.feature_columns(out)
    assert len(names) == 48 - 3  # the list also holds three columns of the cases cleaner
    assert "new_cases" not in names and "confirmed" not in names
    assert out.filter(" OR ".join(f"`{c}` IS NULL" for c in names)).count() == 0
    assert features.feature_columns(out, exclude=["month"]) == [c for c in names if c != "month"]


def test_prepare_xy_and_scaling(daily, ordered):
    df = daily(new_cases=[float(i % 5) for i in range(20)])
    ready, names = features.prepare_xy(df)
    assert ready.count() == 20 and len(ready.first().features) == len(names)
    scaled = features.min_max_scale(daily("a double, b double", a=[1.0, 3.0, 5.0], b=[2.0, 2.0, 2.0]), ["a", "b"])
    assert ordered(scaled, "a") == [0, 0.5, 1] and ordered(scaled, "b") == [0, 0, 0]


def test_sequences_are_complete_blocks(daily):
    out = features.sequences(daily(new_cases=[float(i) for i in range(16)]), ["new_cases"], "new_cases")
    rows = out.orderBy("date").collect()
    assert len(rows) == 3
    assert [x[0] for x in rows[0].sequence] == [float(i) for i in range(14)] and rows[0].sequence_target == 13.0


def test_lags_do_not_cross_states(spark):
    rows = [("a", dt.date(2020, 1, 1), 1.0), ("a", dt.date(2020, 1, 5), 2.0), ("b", dt.date(2020, 1, 2), 9.0)]
    df = spark.createDataFrame(rows, "state string, date date, new_cases double")
    out = features.lag_features(df, Panel("date", "state"), lags=(1,))
    assert {(r.state, r.new_cases_lag_1) for r in out.collect()} == {("a", None), ("a", 1.0), ("b", None)}
