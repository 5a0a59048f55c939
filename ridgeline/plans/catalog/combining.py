"""Weights, ensembles and stacking."""

from __future__ import annotations

from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from ridgeline.functions.sizing import scratch_path, written
from ridgeline.operators import ensemble as en
from ridgeline.operators import evaluate as ev
from ridgeline.operators.baselines import baselines
from ridgeline.operators.merge import union_states
from ridgeline.operators.splits import expanding_folds
from ridgeline.panel import BY_STATE, NATIONAL
from ridgeline.plans import views
from ridgeline.plans.catalog import query, rounded
from ridgeline.plans.catalog.exploring import predictions
from ridgeline.plans.catalog.scoring import state_predictions
from ridgeline.plans.oracle import metrics_sql, r, rs, sql
from ridgeline.sources import writers

MODELS = ["naive", "seasonal", "ma7"]
PLAIN = {"naive": 0.3, "seasonal": 0.4, "ma7": 0.3}


def stored_predictions(spark, sf):
    """Predictions that weights, combinations and metrics all read: computed once."""
    return written(predictions(spark, sf), "predictions")


@query("align_predictions", sql(f"SELECT state, date, y_true, naive, seasonal, {r('ma7')} FROM state_base", "state_base"))
def align_predictions(spark, sf):
    return rounded(en.align_predictions(state_predictions(spark, sf), MODELS, BY_STATE))


@query(
    "weights_static",
    sql("SELECT date, max(y_true) AS y_true, " + r("sum(w * y_pred)", "y_pred") + ", 'ensemble' AS model FROM preds JOIN (SELECT unnest(['naive', 'seasonal', 'ma7']) AS model, unnest([0.3::DOUBLE, 0.4::DOUBLE, 0.3::DOUBLE]) AS w) USING (model) GROUP BY 1", "preds"),
)
def weights_static(spark, sf):
    return rounded(en.ensemble_predict(predictions(spark, sf), en.weights_static(spark, PLAIN)))


@query("weights_inverse_rmse", sql(f"SELECT model, {r('weight', digits=9)} FROM weights", "weights"))
def weights_inverse_rmse(spark, sf):
    return rounded(en.weights_inverse_rmse(predictions(spark, sf)), 9)


@query("ensemble_predict", sql(f"SELECT date, model, y_true, {r('y_pred')} FROM ens", "ens"))
def ensemble_predict(spark, sf):
    preds = stored_predictions(spark, sf)
    return rounded(en.ensemble_predict(preds, en.weights_inverse_rmse(preds)))


@query(
    "ensemble_interval",
    sql(f"SELECT state, date, {rs(['mean', 'std'])}, {r('greatest(mean - 1.96 * std, 0)', 'lower')}, {r('mean + 1.96 * std', 'upper')} FROM (SELECT state, date, avg(y_pred) AS mean, stddev_pop(y_pred) AS std FROM state_preds GROUP BY 1, 2)", "state_preds"),
)
def ensemble_interval(spark, sf):
    return rounded(en.ensemble_interval(state_predictions(spark, sf), BY_STATE))


_all = {"al": "SELECT date, model, y_true, y_pred FROM preds UNION ALL SELECT date, model, y_true, y_pred FROM ens", "m": metrics_sql("al", ["model"], ["model"])}


@query("evaluate_models", sql("SELECT * FROM m", "preds", "ens", extra=_all))
def evaluate_models(spark, sf):
    preds = stored_predictions(spark, sf)
    return rounded(en.evaluate_models(preds, en.weights_inverse_rmse(preds)))


_runs = {
    "pl": "SELECT date, new_cases, row_number() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () AS n FROM daily",
    "fo": "SELECT fold AS run, date, new_cases FROM pl, (SELECT unnest(range(5))::INTEGER AS fold) WHERE (fold + 1) * (n // 6) < n AND pos >= (fold + 1) * (n // 6) AND pos < (fold + 2) * (n // 6)",
    "rb": "SELECT run, date, new_cases::DOUBLE AS y_true, coalesce(first_value(n1 IGNORE NULLS) OVER f, 0)::DOUBLE AS naive, coalesce(first_value(n7 IGNORE NULLS) OVER f, 0)::DOUBLE AS seasonal, ma7 FROM (SELECT *, lag(new_cases, 1) OVER (PARTITION BY run ORDER BY date) AS n1, lag(new_cases, 7) OVER (PARTITION BY run ORDER BY date) AS n7, avg(new_cases) OVER (PARTITION BY run ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS ma7 FROM fo) WINDOW f AS (PARTITION BY run ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)",
    "rp": "SELECT run, date, 'naive' AS model, y_true, naive AS y_pred FROM rb UNION ALL SELECT run, date, 'seasonal', y_true, seasonal FROM rb UNION ALL SELECT run, date, 'ma7', y_true, ma7 FROM rb",
    "er": "SELECT run, model, greatest(sqrt(avg((y_true - y_pred) * (y_true - y_pred))), 1e-8) AS e FROM (SELECT *, row_number() OVER (PARTITION BY run, model ORDER BY date DESC) AS k FROM rp) WHERE k <= 14 GROUP BY 1, 2",
}


@query("weight_history", sql(f"SELECT run, model, {r('(1 / e) / sum(1 / e) OVER (PARTITION BY run)', 'weight', 9)} FROM er", "daily", extra=_runs))
def weight_history(spark, sf):
    folds = expanding_folds(views.daily_cases(spark, sf).drop("new_deaths"), NATIONAL, 5).filter("role = 'test'")
    runs = baselines(folds.withColumnRenamed("fold", "run"), NATIONAL.with_series("run"))
    return rounded(en.weight_history(runs), 9)


@query(
    "restored_weights",
    sql("SELECT model, round(w / sum(w) OVER (), 9) + 0.0 AS weight FROM (SELECT model, coalesce(weight, d) AS w FROM (SELECT unnest(['naive', 'seasonal', 'extra']) AS model, unnest([0.33::DOUBLE, 0.33::DOUBLE, 0.34::DOUBLE]) AS d) LEFT JOIN weights USING (model))", "weights"),
)
def restored_weights(spark, sf):
    stored = en.weights_inverse_rmse(predictions(spark, sf))
    return rounded(en.restored_weights(stored, {"naive": 0.33, "seasonal": 0.33, "extra": 0.34}), 9)


_lengthy = {"er": "SELECT model, greatest(sqrt(avg((y_true - y_pred) * (y_true - y_pred))), 1e-8) AS e, min(k) AS n FROM (SELECT *, count(*) OVER (PARTITION BY model) AS k FROM preds) GROUP BY 1"}


@query(
    "weights_when_short",
    sql("SELECT model, round(CASE WHEN (SELECT min(n) FROM er) >= 100000 THEN (1 / e) / sum(1 / e) OVER () WHEN model = 'naive' THEN 0.75 WHEN model = 'ma7' THEN 0.25 ELSE 0 END, 9) + 0.0 AS weight FROM er", "preds", extra=_lengthy),
)
def weights_when_short(spark, sf):
    """Series shorter than the lookback take static weights; a model that the map lacks has none."""
    return rounded(en.weights_inverse_rmse(predictions(spark, sf), lookback=100_000, fallback={"naive": 0.6, "ma7": 0.2}), 9)


@query(
    "choose_weights",
    sql(f"SELECT 'dynamic' AS method, model, {r('weight', digits=6)} FROM weights UNION ALL SELECT 'static', unnest(['naive', 'seasonal', 'ma7']), unnest([0.3::DOUBLE, 0.4::DOUBLE, 0.3::DOUBLE]) UNION ALL SELECT 'short', unnest(['naive', 'seasonal', 'ma7']), unnest([0.3::DOUBLE, 0.4::DOUBLE, 0.3::DOUBLE])", "weights"),
)
def choose_weights(spark, sf):
    preds = stored_predictions(spark, sf)
    cases = {"dynamic": ("dynamic", 14), "static": ("static", 14), "short": ("dynamic", 100_000)}
    return union_states([
        rounded(en.choose_weights(preds, PLAIN, method=m, lookback=n).select(F.lit(name).alias("method"), "model", "weight")) for name, (m, n) in cases.items()
    ])


@query(
    "weights_document",
    sql(f"SELECT 'weights' AS section, NULL::VARCHAR AS key, model, {r('weight', 'value', 9)} FROM weights UNION ALL SELECT 'settings', 'lookback', NULL, 14.0 UNION ALL SELECT 'history', run::VARCHAR, model, {r('(1 / e) / sum(1 / e) OVER (PARTITION BY run)', 'value', 9)} FROM er", "daily", "weights", extra=_runs),
)
def weights_document(spark, sf):
    path = scratch_path(spark, "document")
    weights = en.weights_inverse_rmse(predictions(spark, sf))
    writers.write_weights_document(spark, path, weights, {"lookback": en.LOOKBACK}, weight_history(spark, sf))
    return rounded(writers.read_weights_document(spark, path), 9)


# Sums behind the two small solves, for the SQL twins of the optimal and stacked weights.
_pairs = [("naive", "naive"), ("naive", "seasonal"), ("naive", "ma7"), ("seasonal", "seasonal"), ("seasonal", "ma7"), ("ma7", "ma7")]
_short = {"naive": "a", "seasonal": "b", "ma7": "c"}
_sums = ", ".join(f"sum({x} * {y}) AS {_short[x]}{_short[y]}" for x, y in _pairs) + ", " + ", ".join(f"sum({m} * y_true) AS y{_short[m]}" for m in MODELS)
_cov = {
    "q": f"SELECT count(*) AS n, sum(y_true) AS sy, sum(naive) AS sa, sum(seasonal) AS sb, sum(ma7) AS sc, {_sums} FROM base",
    "z": "SELECT n, sy, sa, sb, sc, aa - sa * sa / n + 1 AS m11, ab - sa * sb / n AS m12, ac - sa * sc / n AS m13, bb - sb * sb / n + 1 AS m22, bc - sb * sc / n AS m23, cc - sc * sc / n + 1 AS m33, "
    "ya - sa * sy / n AS v1, yb - sb * sy / n AS v2, yc - sc * sy / n AS v3 FROM q",
    "dt": "SELECT *, m11 * (m22 * m33 - m23 * m23) - m12 * (m12 * m33 - m23 * m13) + m13 * (m12 * m23 - m22 * m13) AS det FROM z",
    "cf": "SELECT *, (v1 * (m22 * m33 - m23 * m23) - m12 * (v2 * m33 - m23 * v3) + m13 * (v2 * m23 - m22 * v3)) / det AS wa, "
    "(m11 * (v2 * m33 - m23 * v3) - v1 * (m12 * m33 - m23 * m13) + m13 * (m12 * v3 - v2 * m13)) / det AS wb, "
    "(m11 * (m22 * v3 - v2 * m23) - m12 * (m12 * v3 - v2 * m13) + v1 * (m12 * m23 - m22 * m13)) / det AS wc FROM dt",
}
_stacked = "SELECT unnest([{{'model': 'naive', 'coefficient': round(wa, 6) + 0.0}}, {{'model': 'seasonal', 'coefficient': round(wb, 6) + 0.0}}, {{'model': 'ma7', 'coefficient': round(wc, 6) + 0.0}}, {{'model': '(intercept)', 'coefficient': round((sy - wa * sa - wb * sb - wc * sc) / n, 6) + 0.0}}], recursive := true) FROM cf".replace("{{", "{").replace("}}", "}")


@query("stacking", sql(_stacked, "base", extra=_cov))
def stacking(spark, sf):
    return rounded(en.stacking_fit(predictions(spark, sf), MODELS))


@query("stacking_predict", sql(f"SELECT date, 'stacking' AS model, y_true, {r('(sy - wa * sa - wb * sb - wc * sc) / n + wa * naive + wb * seasonal + wc * ma7', 'y_pred')} FROM base, cf", "base", extra=_cov))
def stacking_predict(spark, sf):
    preds = stored_predictions(spark, sf)
    return rounded(en.stacking_predict(preds, en.stacking_fit(preds, MODELS)))


_ols = {"q": _cov["q"], "z": _cov["z"].replace(" + 1 AS m", " AS m"), "dt": _cov["dt"], "cf": _cov["cf"]}


@query("stacking_with", sql(f"SELECT date, y_true, {r('(sy - wa * sa - wb * sb - wc * sc) / n + wa * naive + wb * seasonal + wc * ma7', 'y_pred', 4)} FROM base, cf", "base", extra=_ols))
def stacking_with(spark, sf):
    """Any Spark ML regressor as the meta-learner: least squares without a penalty."""
    preds = stored_predictions(spark, sf)
    model = en.stacking_with(preds, MODELS, LinearRegression(featuresCol="features", labelCol="label", predictionCol="y_pred", solver="normal"))
    return rounded(model.transform(en.align_predictions(preds, MODELS)).select("date", "y_true", "y_pred"), 4)


# Three models on the simplex: the free optimum if it is inside, else the best edge.
_A, _B, _C = "naive", "seasonal", "ma7"


def _edge(p: str, q: str) -> str:
    return f"greatest(least((sum((y_true - {q}) * ({p} - {q})) + any_value(r)) / nullif(sum(({p} - {q}) * ({p} - {q})) + 2 * any_value(r), 0), 1), 0)"


def _loss(w: str) -> str:
    return f"sum(pow(y_true - {w}[1] * naive - {w}[2] * seasonal - {w}[3] * ma7, 2)) + any_value(r) * ({w}[1] * {w}[1] + {w}[2] * {w}[2] + {w}[3] * {w}[3])"


_simplex = {
    "n": f"SELECT state, {en.NUDGE} * sum(naive * naive + seasonal * seasonal + ma7 * ma7) / 3 AS r FROM state_base GROUP BY 1",
    "e": f"SELECT state, any_value(r) AS r, {_edge(_A, _B)} AS tab, {_edge(_A, _C)} AS tac, {_edge(_B, _C)} AS tbc, sum((naive - ma7) * (naive - ma7)) + 2 * any_value(r) AS p, "
    "sum((naive - ma7) * (seasonal - ma7)) + any_value(r) AS q, sum((seasonal - ma7) * (seasonal - ma7)) + 2 * any_value(r) AS s, "
    "sum((naive - ma7) * (y_true - ma7)) + any_value(r) AS u, sum((seasonal - ma7) * (y_true - ma7)) + any_value(r) AS v FROM state_base JOIN n USING (state) GROUP BY 1",
    "f": "SELECT *, (u * s - q * v) / nullif(p * s - q * q, 0) AS wa, (p * v - q * u) / nullif(p * s - q * q, 0) AS wb FROM e",
    "h": "SELECT state, r, [wa, wb, 1 - wa - wb] AS free, [tab, 1 - tab, 0] AS ab, [tac, 0, 1 - tac] AS ac, [0, tbc, 1 - tbc] AS bc FROM f",
    "l": f"SELECT state, any_value(r) AS r, any_value(free) AS free, any_value(ab) AS ab, any_value(ac) AS ac, any_value(bc) AS bc, {_loss('ab')} AS lab, {_loss('ac')} AS lac, {_loss('bc')} AS lbc FROM state_base JOIN h USING (state) GROUP BY state, free, ab, ac, bc",
    # Models that are zero throughout leave nothing to choose: equal weights.
    "b": "SELECT state, CASE WHEN r = 0 THEN [1 / 3.0::DOUBLE, 1 / 3.0::DOUBLE, 1 / 3.0::DOUBLE] WHEN free[1] >= 0 AND free[2] >= 0 AND free[3] >= 0 THEN free WHEN lab <= lac AND lab <= lbc THEN ab WHEN lac <= lbc THEN ac ELSE bc END AS w FROM l",
}


@query("weights_optimal", sql("SELECT unnest(['naive', 'seasonal', 'ma7']) AS model, unnest([round(w[1], 6) + 0.0, round(w[2], 6) + 0.0, round(w[3], 6) + 0.0]) AS weight FROM b", "base", extra={"state_base": "SELECT 'all' AS state, * FROM base"} | _simplex))
def weights_optimal(spark, sf):
    return rounded(en.weights_optimal(predictions(spark, sf), MODELS))


@query("weights_optimal_by_state", sql("SELECT state, unnest(['naive', 'seasonal', 'ma7']) AS model, unnest([round(w[1], 6) + 0.0, round(w[2], 6) + 0.0, round(w[3], 6) + 0.0]) AS weight FROM b", "state_base", extra=_simplex))
def weights_optimal_by_state(spark, sf):
    return rounded(en.weights_optimal(state_predictions(spark, sf), MODELS, BY_STATE, by=["state"]))


_h = {"ahead": " UNION ALL ".join(f"SELECT date, model, y_pred, {h} AS horizon, lead(y_true, {h}) OVER (PARTITION BY model ORDER BY date) AS y_h FROM preds" for h in (1, 3, 7, 14)),
      "mh": metrics_sql("ahead", ["model", "horizon"], ["model", "horizon"], "y_h")}


@query(
    "ensemble_report",
    sql(
        "SELECT 'weights' AS section, model, 'weight' AS name, round(weight, 6) + 0.0 AS value FROM weights"
        + "".join(f" UNION ALL SELECT 'metrics', model, '{k}', {k} FROM m" for k in ("mae", "rmse", "mape", "mda", "r2"))
        + "".join(f" UNION ALL SELECT 'horizons', model, '{k}@' || horizon, {k} FROM mh" for k in ("mae", "rmse", "mape", "mda", "r2")),
        "preds", "ens", extra=_all | _h,
    ),
)
def ensemble_report(spark, sf):
    preds = stored_predictions(spark, sf)
    weights = en.weights_inverse_rmse(preds)
    return rounded(en.ensemble_report(weights, en.evaluate_models(preds, weights), ev.metrics_by_horizon(preds)))
