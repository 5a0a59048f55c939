import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline import Panel
from ridgeline.operators import additive, learners
from ridgeline.operators.baselines import naive, to_long
from ridgeline.operators.evaluate import metrics_all
from ridgeline.operators.features import feature_columns, lag_features, temporal_features
from ridgeline.operators.merge import holiday_calendar
from ridgeline.operators.splits import split_by_date
from ridgeline.panel import NATIONAL
from ridgeline.sources import writers

BOTH = Panel("date", "state")


@pytest.fixture(scope="module")
def weekly(spark):
    """Two states: trend, strong weekly and yearly shape, a regressor and noise."""
    rng = np.random.default_rng(0)
    rows = []
    for state, level in (("a", 200.0), ("b", 900.0)):
        for i in range(700):
            day = dt.date(2020, 1, 1) + dt.timedelta(days=i)
            x = float(rng.normal())
            y = level + 0.2 * i + 60 * (day.weekday() >= 5) + 30 * np.sin(2 * np.pi * i / 365.25) + 15 * x + rng.normal(0, 4)
            rows.append((state, day, x, float(y)))
    return spark.createDataFrame(rows, "state string, date date, x double, new_cases double").persist()


def mae(df, panel=BOTH):
    return metrics_all(df, ["model"], panel).first().mae


def test_additive_model_beats_naive_and_covers(spark, weekly):
    calendar = holiday_calendar(spark)
    spec = additive.AdditiveSpec(regressors=("x",), changepoints=10, yearly=3)
    split = split_by_date(weekly, BOTH)
    test = split.filter("role = 'test'")
    model = additive.fit(split.filter("role <> 'test'"), calendar, BOTH, spec=spec)
    scored = additive.score(test, model, calendar, BOTH, spec, keep=["new_cases"])
    assert scored.count() == test.count()
    assert scored.filter("yhat_lower > yhat or yhat_upper < yhat").count() == 0
    ours = scored.select("state", "date", F.lit("m").alias("model"), F.col("new_cases").alias("y_true"), F.col("yhat").alias("y_pred"))
    assert mae(ours) < 0.5 * mae(to_long(naive(test, BOTH), ["naive"], "new_cases", BOTH))
    effects = {r.state: r.effect for r in additive.regressor_effect(model, BOTH, spec).collect()}
    scale = {r.state: r.scale for r in model.collect()}
    for state, effect in effects.items():
        assert effect * scale[state].y_scale == pytest.approx(15 * scale[state].spread[0], rel=0.1)


def test_panel_fit_equals_single_fit(spark, weekly):
    calendar = holiday_calendar(spark)
    both = additive.fit(weekly, calendar, BOTH).filter("state = 'a'").first()
    alone = additive.fit(weekly.filter("state = 'a'").drop("state"), calendar, NATIONAL).first()
    assert both.beta == pytest.approx(alone.beta, abs=1e-8) and len(alone.beta) == len(additive.AdditiveSpec().terms())


def test_forecast_past_the_end(spark, weekly):
    calendar = holiday_calendar(spark)
    spec = additive.AdditiveSpec(regressors=("x",), level=0.95)
    model = additive.fit(weekly, calendar, BOTH, spec=spec)
    out = additive.forecast_horizon(weekly, model, calendar, 14, BOTH, spec)
    assert out.count() == 28
    row = out.groupBy("state").agg(F.min("date").alias("lo"), F.max("date").alias("hi")).first()
    assert (row.lo, row.hi) == (dt.date(2021, 12, 1), dt.date(2021, 12, 14))


def test_rolling_origin(spark, weekly):
    calendar = holiday_calendar(spark)
    spec = additive.AdditiveSpec(changepoints=4, yearly=2)
    out = additive.rolling_origin(weekly, calendar, BOTH, spec=spec, initial=365, period=120, horizon=30)
    cuts = out.select("state", "cutoff").distinct()
    assert cuts.count() == 6
    metrics = additive.rolling_origin_metrics(out, BOTH.with_series("cutoff"))
    assert metrics.count() == 30 and metrics.filter("mae is null").count() == 0
    alone = additive.rolling_origin(weekly.filter("state = 'a'").drop("state"), calendar, NATIONAL, spec=spec, initial=365, period=120, horizon=30)
    one = {(r.cutoff, r.date): r.y_pred for r in alone.collect()}
    many = {(r.cutoff, r.date): r.y_pred for r in out.filter("state = 'a'").collect()}
    assert one.keys() == many.keys()
    assert all(one[k] == pytest.approx(many[k], rel=1e-6) for k in one)


@pytest.fixture(scope="module")
def learning(weekly):
    return lag_features(temporal_features(split_by_date(weekly, BOTH)), BOTH, lags=(1, 7)).na.drop().persist()


def test_boosted_trees(spark, learning, tmp_path):
    trees = learners.BoostedTrees(n_estimators=15, max_depth=4, features=tuple(feature_columns(learning)))
    model = trees.fit(learning.filter("role = 'train'"), learning.filter("role = 'val'"))
    test = learning.filter("role = 'test'")
    out = learners.predict(model, test, BOTH)
    assert mae(out) < mae(to_long(naive(test, BOTH), ["naive"], "new_cases", BOTH))
    top = learners.feature_importance(model, learning).collect()
    assert len(top) == len(trees.features)
    assert sum(r.importance for r in top) == pytest.approx(1) and top[0].importance >= top[-1].importance
    writers.save_model(model, str(tmp_path / "m"))
    again = learners.predict(writers.load_model(str(tmp_path / "m")), test, BOTH)
    assert again.exceptAll(out).count() == 0


def test_random_search(learning):
    space = {"max_depth": (2, 3, "int"), "n_estimators": (5, 30, "int"), "learning_rate": (0.05, 0.3, "log"), "subsample": (0.5, 1.0, "uniform")}
    base = learners.BoostedTrees(features=tuple(feature_columns(learning)))
    train, held = learning.filter("role = 'train'"), learning.filter("role = 'val'")
    trials, best = learners.random_search(train, held, base, 6, space, first_trees=4, patience=3)
    rows = trials.collect()
    assert len(rows) == 6
    winner = min(rows, key=lambda r: r.loss)
    assert winner.params["learning_rate"] == pytest.approx(best.learning_rate) and best.n_estimators == winner.trees
    for r in rows:
        assert all(lo <= r.params[k] <= hi for k, (lo, hi, _) in space.items())
        assert 1 <= r.trees <= r.grown <= r.params["n_estimators"]
    assert sum(r.rung > 0 for r in rows) <= 2  # a third goes on
    # The recorded error is that of the best number of trees, grown anew.
    again = best.trees().fit(best.vectors().transform(best.labelled(train)).select("features", "label"))
    pairs = again.transform(best.vectors().transform(best.labelled(held))).selectExpr("sqrt(avg(pow(label - y_pred, 2))) e").first()
    assert pairs.e == pytest.approx(winner.loss, rel=0.05)


def test_trials_end_when_grown_or_without_gain():
    trial = learners.Trial(0, {"n_estimators": 40})
    trial.learn([5.0, 3.0, 4.0, 4.0], 0, 3)
    assert (trial.loss, trial.trees, trial.grown, trial.ended) == (3.0, 2, 4, False)
    trial.learn([5.0, 3.0, 4.0, 4.0, 4.0], 1, 3)
    assert trial.ended and trial.rung == 1
    short = learners.Trial(1, {"n_estimators": 3})
    short.learn([3.0, 2.0, 1.0], 0, 20)
    assert short.ended and short.trees == 3


def test_random_search_with_an_objective(learning):
    base = learners.BoostedTrees(features=tuple(feature_columns(learning)))
    asked = []

    def largest_miss(df):
        asked.append(df.count())
        return df.selectExpr("max(abs(y_true - y_pred)) e").first().e

    space = {"max_depth": (2, 3, "int"), "n_estimators": (2, 6, "int")}
    trials, _ = learners.random_search(learning.filter("role = 'train'"), learning.filter("role = 'val'"), base, 3, space, objective=largest_miss, first_trees=4)
    assert len(asked) >= 3 and trials.filter("loss > 0 AND trees = grown").count() == 3


def test_sequence_forecast(learning):
    out = learners.sequence_forecast(learning, ["new_cases_lag_1", "new_cases_lag_7"], BOTH)
    test = learning.filter("role = 'test'")
    assert out.count() == test.count() - 2 * 13
    assert mae(out) < mae(to_long(naive(test, BOTH), ["naive"], "new_cases", BOTH))


def test_summed_products_give_the_fit_of_all_rows(spark):
    """Partitions' sums per series, a NULL series included, against one solve over the gathered rows."""
    rng = np.random.default_rng(3)
    rows = [(s, dt.date(2021, 1, 1) + dt.timedelta(days=d), float(50 + d + 9 * (d % 7) + rng.normal())) for s in ("a", None) for d in range(120)]
    df = spark.createDataFrame(rows, "state string, date date, new_cases double").repartition(5)
    spec = additive.AdditiveSpec(changepoints=4, yearly=2, weekly=2)
    model = {r["state"]: r for r in additive.fit(df, holiday_calendar(spark), BOTH, spec=spec).collect()}
    assert set(model) == {"a", None}
    days = np.array([(dt.date(2021, 1, 1) - dt.date(1970, 1, 1)).days + d for d in range(120)], float)
    t = (days - days[0]) / 119
    waves = [f(days * 2 * np.pi * k / p) for p in (365.25, 7.0) for k in (1, 2) for f in (np.sin, np.cos)]
    republic = np.isin(np.arange(120), [24, 25, 26]).astype(float)
    x = np.column_stack([np.ones(120), t, *[np.maximum(t - 0.8 * j / 4, 0) for j in range(1, 5)], *waves, republic, *[np.zeros(120)] * 3])
    for s in ("a", None):
        y = np.array([v for k, _, v in rows if k == s])
        y = y / y.max()
        beta, penalty = np.array(model[s]["beta"]), np.array(spec.penalties())
        knots = np.arange(len(beta)) - 2
        knots = (knots >= 0) & (knots < 4)
        slope = x.T @ (x @ beta - y) + np.where(knots, 0, penalty * beta)
        held = knots & (beta == 0)
        assert np.abs(slope[held]).max(initial=0) <= spec.absolute + 1e-8
        assert np.abs(np.where(held, 0, slope + spec.absolute * np.sign(beta) * knots)).max() < 1e-7
        assert abs(model[s]["sigma"] - np.sqrt(np.mean((y - x @ beta) ** 2))) < 1e-6


def test_registered_tree_queries_run_the_operators_settings(spark, monkeypatch):
    from ridgeline.plans.catalog import forecasting

    assert forecasting.TREES == learners.BoostedTrees() and (forecasting.TREES.n_estimators, forecasting.TREES.max_depth) == (500, 6)
    seen = []
    search = learners.random_search

    def watched(train, validation, base, *args, **kwargs):
        seen.append((base, args, kwargs))
        return search(train, validation, base, n_trials=1, space={"n_estimators": (1, 1, "int")})

    monkeypatch.setattr(learners, "random_search", watched)
    assert forecasting.random_search(spark, "/root/testdata/sf0.001").count() == 1
    assert seen[0][1:] == ((), {}) and learners.SEARCH_SPACE["n_estimators"] == (100, 1000, "int")


def test_laplace_prior_leaves_a_straight_trend_without_changes(spark):
    rng = np.random.default_rng(4)
    rows = [("straight", i, 50 + 0.3 * i + rng.normal()) for i in range(400)]
    rows += [("bent", i, 50 + 0.3 * i + 1.5 * max(i - 160, 0) + rng.normal()) for i in range(400)]
    df = spark.createDataFrame([(s, dt.date(2020, 1, 1) + dt.timedelta(days=i), float(y)) for s, i, y in rows], "state string, date date, new_cases double")
    spec = additive.AdditiveSpec(changepoints=10, yearly=0, weekly=0, holidays=())
    beta = {r.state: r.beta for r in additive.fit(df, holiday_calendar(spark), BOTH, spec=spec).collect()}
    assert beta["straight"][2:] == [0.0] * 10
    assert 0 < sum(b != 0 for b in beta["bent"][2:]) < 6


def test_shrunken_changes_meet_the_conditions_of_their_minimum():
    rng = np.random.default_rng(6)
    for k in range(1, 9):
        for weight in (0.001, 0.1, 5.0):
            t = np.linspace(0, 1, 300)
            x = np.column_stack([np.maximum(t - 0.8 * j / k, 0) for j in range(1, k + 1)])
            y = x @ (rng.normal(size=k) * (rng.random(k) < 0.5)) + 0.1 * rng.normal(size=300)
            found = additive.lasso(x.T @ x, x.T @ y, weight)
            slope = x.T @ (x @ found - y)
            out = found == 0
            assert np.abs(slope[out]).max(initial=0) <= weight + 1e-8
            assert np.abs(slope[~out] + weight * np.sign(found[~out])).max(initial=0) <= 1e-8


def test_prefix_fits_equal_a_fit_of_the_rows_up_to_each_cutoff(spark, weekly):
    calendar = holiday_calendar(spark)
    holed = weekly.withColumn("x", F.when(F.dayofmonth("date") == 3, None).otherwise(F.col("x")))
    spec = additive.AdditiveSpec(changepoints=6, yearly=2, regressors=("x",))
    from ridgeline.operators.splits import rolling_origin_cutoffs

    cuts = rolling_origin_cutoffs(holed, BOTH, 200, 90, 30)
    found = {(r.state, r.cutoff): r for r in additive.fit_at_cutoffs(holed, cuts, calendar, BOTH, spec=spec).collect()}
    assert len(found) == cuts.count() > 6
    for (state, cutoff), row in sorted(found.items())[::3]:
        alone = additive.fit(holed.filter((F.col("state") == state) & (F.col("date") <= cutoff)), calendar, BOTH, spec=spec).first()
        assert row.beta == pytest.approx(alone.beta, rel=1e-6, abs=1e-7)
        assert row.sigma == pytest.approx(alone.sigma, rel=1e-6)
        assert np.allclose(row["cov"], alone["cov"], rtol=1e-5, atol=1e-10)
        for name in ("first", "days", "y_scale", "centre", "spread"):
            assert row.scale[name] == pytest.approx(alone.scale[name], rel=1e-9)


def test_rolling_origin_reads_each_row_once_per_fit(spark, weekly):
    from ridgeline.operators.splits import rolling_origin_cutoffs, rolling_origin_tests

    tests = rolling_origin_tests(weekly, BOTH, 365, 30, 30)
    assert tests.count() == rolling_origin_cutoffs(weekly, BOTH, 365, 30, 30).count() * 30
    assert tests.filter("date <= cutoff OR datediff(date, cutoff) > 30").count() == 0
    wide = rolling_origin_tests(weekly, BOTH, 365, 10, 30)
    assert wide.groupBy("state", "date").count().agg(F.max("count")).first()[0] == 3


def test_intervals_widen_past_the_data_and_cover(spark):
    rng = np.random.default_rng(12)
    rows = []
    for s in range(12):
        level = 300 + 50 * rng.normal()
        rows += [(f"s{s}", dt.date(2020, 1, 1) + dt.timedelta(days=i), float(level + 0.1 * i + 10 * rng.normal())) for i in range(300)]
    df = spark.createDataFrame(rows, "state string, date date, new_cases double")
    spec = additive.AdditiveSpec(yearly=0, weekly=1, changepoints=8)
    out = additive.rolling_origin(df, holiday_calendar(spark), BOTH, spec=spec, initial=150, period=60, horizon=40).persist()
    width = {r.horizon: r.w for r in out.groupBy("horizon").agg(F.avg(F.col("y_upper") - F.col("y_lower")).alias("w")).collect()}
    assert width[40] > width[20] > width[1]
    covered = additive.rolling_origin_metrics(out, BOTH.with_series("cutoff")).selectExpr("avg(coverage) c").first().c
    assert 0.72 < covered < 0.92  # stated: 0.8
