"""NULL series keys stay, models without a metric rank last, and ensembles work on a subset of models."""

import datetime as dt

import pytest

from ridgeline import Panel
from ridgeline.operators import baselines, ensemble, evaluate, explore, splits

BY = Panel(order="date", series=("state",))


@pytest.fixture(scope="module")
def panel(spark):
    rows = [(s, dt.date(2022, 1, 1) + dt.timedelta(days=i), float(i + 1)) for s in ("a", None) for i in range(20)]
    return spark.createDataFrame(rows, "state string, date date, new_cases double")


def test_null_series_stay(panel):
    regimes = evaluate.with_regime(panel, "new_cases", BY)
    assert regimes.filter("state IS NULL").count() == 20
    assert explore.histogram_density(panel, "new_cases", 4, ["state"]).filter("state IS NULL").count() == 4
    folds = splits.calendar_folds(panel, 5, 3, BY, n_splits=2)
    assert folds.filter("state IS NULL").count() == folds.filter("state = 'a'").count() > 0
    assert baselines.baselines(panel, BY).filter("state IS NULL").count() == 60


def test_a_model_without_a_metric_ranks_last(spark):
    metrics = spark.createDataFrame([("x", None), ("y", 2.0), ("z", 1.0)], "model string, mae double")
    assert [(r["model"], r["rank"]) for r in evaluate.rank_models(metrics).orderBy("rank").collect()] == [("z", 1), ("y", 2), ("x", 3)]
    assert evaluate.best_model(metrics).first()["model"] == "z"


def predictions(spark, rows_each=3, series=("s",)):
    rows = [(k, dt.date(2022, 3, 1) + dt.timedelta(days=i), m, 10.0, 10.0 + e) for k in series for i in range(rows_each) for m, e in (("x", 1.0), ("y", 3.0))]
    return spark.createDataFrame(rows, "state string, date date, model string, y_true double, y_pred double")


def test_weighted_models_without_predictions_are_left_aside(spark):
    weights = ensemble.weights_static(spark, {"x": 0.5, "y": 0.25, "z": 0.25})
    out = ensemble.ensemble_predict(predictions(spark), weights).collect()
    assert len(out) == 3
    assert {r["y_pred"] for r in out} == {0.5 * 11 + 0.25 * 13}


def test_short_series_take_the_fallback_weights(spark):
    two_short = predictions(spark, 7, ("s", "t"))
    got = {r["model"]: r["weight"] for r in ensemble.weights_inverse_rmse(two_short, BY, 14, {"x": 3.0, "y": 1.0}).collect()}
    assert got == {"x": 0.75, "y": 0.25}
    long = {r["model"]: r["weight"] for r in ensemble.weights_inverse_rmse(predictions(spark, 14, ("s", "t")), BY, 14, {"x": 1.0, "y": 1.0}).collect()}
    assert long["x"] == pytest.approx(0.75)
