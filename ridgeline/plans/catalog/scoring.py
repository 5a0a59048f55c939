"""Baseline forecasts and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgeline.operators import baselines as base
from ridgeline.operators import evaluate as ev
from ridgeline.operators.splits import split_by_date
from ridgeline.panel import BY_STATE, NATIONAL
from ridgeline.plans import views
from ridgeline.plans.catalog import query, rounded
from ridgeline.plans.catalog.exploring import predictions
from ridgeline.plans.oracle import metrics_sql, r, rs, sql


def test_rows(spark, sf):
    cases = views.daily_cases(spark, sf).drop("new_deaths")
    return split_by_date(cases, NATIONAL, 0.15, 0.1).filter("role = 'test'").drop("role")


def state_predictions(spark, sf):
    cases = views.daily_cases_by_state(spark, sf).drop("new_deaths")
    test = split_by_date(cases, BY_STATE).filter("role = 'test'")
    return base.baselines(test, BY_STATE)


@query("baseline_naive", sql("SELECT date, y_true::BIGINT AS new_cases, naive FROM base", "base"))
def baseline_naive(spark, sf):
    return base.naive(test_rows(spark, sf))


@query("baseline_seasonal", sql("SELECT date, y_true::BIGINT AS new_cases, seasonal FROM base", "base"))
def baseline_seasonal(spark, sf):
    return base.seasonal(test_rows(spark, sf))


@query("baseline_ma7", sql(f"SELECT date, y_true::BIGINT AS new_cases, {r('ma7')} FROM base", "base"))
def baseline_ma7(spark, sf):
    return rounded(base.moving_average(test_rows(spark, sf)))


_w = "OVER (ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"


@query("baseline_ma7_lagged", sql(f"SELECT date, new_cases, {r(f'coalesce(CASE WHEN count(new_cases) {_w} = 7 THEN avg(new_cases) {_w} END, (SELECT avg(new_cases) FROM test))', 'ma7_lagged')} FROM test", "test"))
def baseline_ma7_lagged(spark, sf):
    return rounded(base.moving_average_lagged(test_rows(spark, sf)))


@query("baselines", sql(f"SELECT state, date, model, y_true, {r('y_pred')} FROM state_preds", "state_preds"))
def baselines(spark, sf):
    return rounded(state_predictions(spark, sf))


@query("metrics_all", sql(metrics_sql("preds", ["model"], ["model"]), "preds"))
def metrics_all(spark, sf):
    return rounded(ev.metrics_all(predictions(spark, sf)))


@query("metrics_by_state", sql(metrics_sql("state_preds", ["state", "model"], ["state", "model"]), "state_preds"))
def metrics_by_state(spark, sf):
    return rounded(ev.metrics_all(state_predictions(spark, sf), ["state", "model"], BY_STATE))


_ahead = {
    "ahead": " UNION ALL ".join(f"SELECT date, model, y_pred, {h} AS horizon, lead(y_true, {h}) OVER (PARTITION BY model ORDER BY date) AS y_h FROM preds" for h in (1, 3, 7, 14))
}


@query("metrics_by_horizon", sql(metrics_sql("ahead", ["model", "horizon"], ["model", "horizon"], "y_h"), "preds", extra=_ahead))
def metrics_by_horizon(spark, sf):
    return rounded(ev.metrics_by_horizon(predictions(spark, sf)))


@query("horizon_shift", sql("SELECT date, model, y_true, y_pred, lead(y_true, 7) OVER (PARTITION BY model ORDER BY date) AS y_ahead FROM (SELECT date, model, y_true, round(y_pred, 6) + 0.0 AS y_pred FROM preds) QUALIFY y_ahead IS NOT NULL", "preds"))
def horizon_shift(spark, sf):
    from ridgeline.operators.segments import over_rows

    by_model = NATIONAL.with_series("model")
    out = over_rows(predictions(spark, sf), by_model, lambda w: {"y_ahead": F.lead("y_true", 7).over(w)}, ahead=7)
    return rounded(out.filter("y_ahead is not null"))


_metrics = {"m": metrics_sql("preds", ["model"], ["model"])}


@query("model_comparison", sql("SELECT *, CASE WHEN model = 'ma7' THEN 'N/A' WHEN mae < (SELECT mae FROM m WHERE model = 'ma7') THEN 'Better' ELSE 'Worse' END AS vs_baseline FROM m", "preds", extra=_metrics))
def model_comparison(spark, sf):
    return rounded(ev.model_comparison(ev.metrics_all(predictions(spark, sf)), "ma7"))


@query("rank_models", sql("SELECT model, mae, row_number() OVER (ORDER BY mae, model)::INTEGER AS rank FROM m", "preds", extra=_metrics))
def rank_models(spark, sf):
    return rounded(ev.rank_models(ev.metrics_all(predictions(spark, sf))).select("model", "mae", "rank"))


@query("best_model", sql("SELECT model, mae FROM m ORDER BY mae, model LIMIT 1", "preds", extra=_metrics))
def best_model(spark, sf):
    return rounded(ev.best_model(ev.metrics_all(predictions(spark, sf))).select("model", "mae"))


@query(
    "residual_stats",
    sql(f"SELECT model, count(*) AS n, {r('avg(y_true - y_pred)', 'mean')}, {r('stddev_samp(y_true - y_pred)', 'std')}, {r('min(y_true - y_pred)', 'min')}, {r('max(y_true - y_pred)', 'max')} FROM preds GROUP BY 1", "preds"),
)
def residual_stats(spark, sf):
    return rounded(ev.residual_stats(predictions(spark, sf)))


@query("residuals", sql(f"SELECT state, date, model, {r('y_true - y_pred', 'residual')} FROM state_preds", "state_preds"))
def residuals(spark, sf):
    return rounded(ev.residuals(state_predictions(spark, sf)).select("state", "date", "model", "residual"))


@query("mda_direction", sql("SELECT state, date, model, (sign(y_true - lag(y_true) OVER w) = sign(y_pred - lag(y_pred) OVER w))::INTEGER::DOUBLE AS hit FROM state_preds WINDOW w AS (PARTITION BY state, model ORDER BY date)", "state_preds"))
def mda_direction(spark, sf):
    marked = ev.with_direction(state_predictions(spark, sf), BY_STATE.with_series("model"))
    return marked.select("state", "date", "model", "hit")


@query("mean_directional_accuracy", sql("SELECT model, mda FROM m", "preds", extra=_metrics))
def mean_directional_accuracy(spark, sf):
    return rounded(ev.mean_directional_accuracy(predictions(spark, sf)))


def _dm(cost: str) -> dict[str, str]:
    a, b = cost.format(p="seasonal"), cost.format(p="naive")
    return {"d": f"SELECT {a} - {b} AS d FROM base"}


@query("diebold_mariano", sql(f"SELECT count(d) AS n, {r('avg(d)', 'mean_d')}, {r('stddev_samp(d)', 'std_d')}, {r('avg(d) / (stddev_samp(d) / sqrt(count(d)))', 'dm_stat')} FROM d", "base", extra=_dm("abs(y_true - {p})")))
def diebold_mariano(spark, sf):
    return rounded(ev.diebold_mariano(predictions(spark, sf), "seasonal", "naive", "mae", p_value=False))


_tail = "list_reduce(list_prepend(1.0::DOUBLE, list_reverse(range(1, 201))::DOUBLE[]), lambda acc, k: 1 + z * z / (2 * k + 1) * acc)"
_dm_p = {
    "d": "SELECT state, pow(y_true - ma7, 2) - pow(y_true - naive, 2) AS d FROM state_base",
    "g": "SELECT state, count(d) AS n, avg(d) AS mean_d, stddev_samp(d) AS std_d FROM d GROUP BY 1",
    "h": "SELECT *, mean_d / nullif(std_d / sqrt(n), 0) AS dm_stat FROM g",
    "i": "SELECT *, CASE WHEN dm_stat IS NOT NULL THEN least(abs(dm_stat), 9) END AS z FROM h",
}


@query("diebold_mariano_p", sql(f"SELECT state, n, {rs(['mean_d', 'std_d', 'dm_stat'])}, {r(f'CASE WHEN z IS NOT NULL THEN greatest(1 - sqrt(2 / pi()) * z * exp(-z * z / 2) * {_tail}, 0) END', 'p_value')} FROM i", "state_base", extra=_dm_p))
def diebold_mariano_p(spark, sf):
    return rounded(ev.diebold_mariano(state_predictions(spark, sf), "ma7", "naive", "mse", by=["state"], panel=BY_STATE))


_mom = {
    "e": "SELECT model, y_true - y_pred AS e, avg(y_true - y_pred) OVER (PARTITION BY model) AS mu FROM preds",
    "k": "SELECT model, count(*) AS n, avg(pow(e - mu, 2)) AS m2, avg(pow(e - mu, 3)) AS m3, avg(pow(e - mu, 4)) AS m4 FROM e GROUP BY 1",
    "s": "SELECT model, n, m3 / pow(m2, 1.5) AS skewness, m4 / (m2 * m2) - 3 AS excess_kurtosis FROM k",
    "j": "SELECT *, n / 6 * (skewness * skewness + excess_kurtosis * excess_kurtosis / 4) AS jarque_bera FROM s",
}


@query("normality", sql(f"SELECT model, n, {rs(['skewness', 'excess_kurtosis', 'jarque_bera'])}, {r('exp(-jarque_bera / 2)', 'p_value')} FROM j", "preds", extra=_mom))
def normality(spark, sf):
    return rounded(ev.normality(predictions(spark, sf)))


def _one_metric(name: str):
    """Each metric of the registry on its own, per state and model."""

    def run(spark, sf):
        preds = state_predictions(spark, sf)
        if name == "mda":
            return rounded(ev.mean_directional_accuracy(preds, ["state", "model"], BY_STATE))
        value = ev.METRICS[name](F.col("y_true"), F.col("y_pred")).alias(name)
        return rounded(preds.groupBy("state", "model").agg(value))

    return run


_state_metrics = {"sm": metrics_sql("state_preds", ["state", "model"], ["state", "model"])}
for _name in ("mae", "rmse", "mape", "mda", "r2"):
    query(_name, sql(f"SELECT state, model, {_name} FROM sm", "state_preds", extra=_state_metrics))(_one_metric(_name))


_ad = {
    "res": "SELECT model, y_true - y_pred AS e FROM preds",
    "rk": "SELECT model, e, row_number() OVER (PARTITION BY model ORDER BY e) AS i, count(*) OVER (PARTITION BY model) AS n, (e - avg(e) OVER (PARTITION BY model)) / nullif(stddev_samp(e) OVER (PARTITION BY model), 0) AS x FROM res",
    "zs": "SELECT *, least(abs(x), 9) AS z FROM rk",
    "tl": f"SELECT *, CASE WHEN x IS NOT NULL THEN greatest(greatest(1 - sqrt(2 / pi()) * z * exp(-z * z / 2) * {_tail}, 0) / 2, {ev.SMALLEST_TAIL}) END AS tail FROM zs",
    "ad": "SELECT model, n, -n - sum((2 * i - 1) * ln(CASE WHEN x > 0 THEN 1 - tail ELSE tail END) + (2 * (n - i) + 1) * ln(CASE WHEN x <= 0 THEN 1 - tail ELSE tail END)) / n AS a2 FROM tl GROUP BY 1, 2",
    "st": "SELECT *, a2 * (1 + 0.75 / n + 2.25 / (n * n)) AS a FROM ad",
}


@query(
    "anderson_darling",
    sql(
        f"SELECT model, n, {r('a2', 'anderson_darling')}, {r('CASE WHEN a IS NOT NULL THEN least(CASE WHEN a >= 10 THEN 3.7e-24 WHEN a >= 0.6 THEN exp(1.2937 - 5.709 * a + 0.0186 * a * a) WHEN a > 0.34 THEN exp(0.9177 - 4.279 * a - 1.38 * a * a) WHEN a > 0.2 THEN 1 - exp(-8.318 + 42.796 * a - 59.938 * a * a) ELSE 1 - exp(-13.436 + 101.14 * a - 223.73 * a * a) END, 1) END', 'p_value')} FROM st",
        "preds", extra=_ad,
    ),
)
def anderson_darling(spark, sf):
    return rounded(ev.anderson_darling(predictions(spark, sf)))
