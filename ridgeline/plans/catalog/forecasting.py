"""Fitted forecasters.  The full models have no SQL form; each fit also runs in a setting that has one: a trend with one
knot, one tree with one split, sequences of one row."""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from ridgeline.functions.sizing import durable, scratch_path, written
from ridgeline.operators import additive, learners
from ridgeline.operators.clean import daily_mean
from ridgeline.operators.evaluate import metrics_all
from ridgeline.operators.features import LAGS, WINDOWS, feature_columns, lag_features, rolling_features, temporal_features
from ridgeline.operators.merge import calendar_for, merge_national, merge_on_date
from ridgeline.operators.splits import split_by_date
from ridgeline.panel import BY_STATE, NATIONAL
from ridgeline.plans import views
from ridgeline.plans.catalog import query, rounded
from ridgeline.plans.catalog.merging import FESTIVALS
from ridgeline.plans.oracle import fill_sql, metrics_sql, r, rs, sql
from ridgeline.sources import writers

WITH_MOBILITY = additive.AdditiveSpec(regressors=("workplaces", "retail_recreation"))
TREES = learners.BoostedTrees()
ONE_KNOT = additive.AdditiveSpec(changepoints=1, changepoint_range=0.5, yearly=0, weekly=0, holidays=())


def calendar(spark, sf):
    """Holidays of the years of the orders."""
    return calendar_for(views.table(spark, sf, "orders").select(views.day("o_orderdate").alias("date")), festivals=FESTIVALS)


def national(spark, sf):
    return merge_national(views.cases(spark, sf), views.mobility(spark, sf))


def learning_frame(spark, sf):
    """State panel with calendar, lag and leak-free rolling features and a role column."""
    cases = views.daily_cases_by_state(spark, sf).drop("new_deaths")
    out = temporal_features(split_by_date(cases, BY_STATE))
    out = lag_features(out, BY_STATE, lags=LAGS)
    # Boosting and scoring read the features many times: they are stored once.
    return durable(rolling_features(out, BY_STATE, windows=WINDOWS, closed="left").na.drop())


def _fit_trees(spark, sf):
    df = learning_frame(spark, sf)
    trees = replace(TREES, features=tuple(feature_columns(df)))
    return df, trees, trees.fit(df.filter("role = 'train'"), df.filter("role = 'val'"))


@query("gbt_forecast")
def gbt_forecast(spark, sf):
    df, _, model = _fit_trees(spark, sf)
    return rounded(learners.predict(model, df.filter("role = 'test'"), BY_STATE))


@query("feature_importance")
def feature_importance(spark, sf):
    df, _, model = _fit_trees(spark, sf)
    return rounded(learners.feature_importance(model, df))


@query("random_search")
def random_search(spark, sf):
    df = learning_frame(spark, sf)
    base = learners.BoostedTrees(features=tuple(feature_columns(df)))
    trials, _ = learners.random_search(df.filter("role = 'train'"), df.filter("role = 'val'"), base)
    return rounded(trials)


@query("additive_forecast")
def additive_forecast(spark, sf):
    cases = split_by_date(views.daily_cases_by_state(spark, sf), BY_STATE)
    model = additive.fit(cases.filter("role <> 'test'"), calendar(spark, sf), BY_STATE)
    return rounded(additive.score(cases.filter("role = 'test'"), model, calendar(spark, sf), BY_STATE))


@query("forecast_horizon")
def forecast_horizon(spark, sf):
    df = national(spark, sf)
    model = additive.fit(df, calendar(spark, sf), spec=WITH_MOBILITY)
    return rounded(additive.forecast_horizon(df, model, calendar(spark, sf), 30, spec=WITH_MOBILITY))


@query("future_dates", sql("SELECT state, (mx + k)::DATE AS date FROM (SELECT state, max(date) AS mx FROM state_daily GROUP BY 1), (SELECT unnest(range(1, 31))::INTEGER AS k)", "state_daily"))
def future_dates(spark, sf):
    return additive.future_dates(views.daily_cases_by_state(spark, sf), BY_STATE, 30)


@query("score_at_dates")
def score_at_dates(spark, sf):
    df = split_by_date(national(spark, sf), NATIONAL, 0.15, 0.1)
    model = additive.fit(df.filter("role = 'train'"), calendar(spark, sf), spec=WITH_MOBILITY)
    return rounded(additive.score(df.filter("role = 'test'"), model, calendar(spark, sf), spec=WITH_MOBILITY, keep=["new_cases"]))


@query("regressor_effect")
def regressor_effect(spark, sf):
    model = additive.fit(national(spark, sf), calendar(spark, sf), spec=WITH_MOBILITY)
    return rounded(additive.regressor_effect(model, spec=WITH_MOBILITY))


# A straight trend with one regressor: three sums to solve, the regressor's own effect by Cramer's rule.
ONE_REGRESSOR = additive.AdditiveSpec(changepoints=0, yearly=0, weekly=0, holidays=(), regressors=("workplaces",))
_p1, _p2 = ONE_REGRESSOR.penalties()[1:]
_effect = {
    "sc": "SELECT min(date) AS first, (max(date) - min(date))::DOUBLE AS span, greatest(max(abs(new_cases)), 1e-9) AS ys, avg(workplaces) AS m, stddev_samp(workplaces) AS sd FROM mg WHERE new_cases IS NOT NULL",
    "xs": "SELECT (date - first) / span AS t, (coalesce(workplaces, m) - m) / sd AS x, new_cases / ys AS y FROM mg, sc WHERE new_cases IS NOT NULL",
    "nm": f"SELECT count(*)::DOUBLE AS n, sum(t) AS t, sum(x) AS x, sum(t * t) + {_p1} AS tt, sum(t * x) AS tx, sum(x * x) + {_p2} AS xx, sum(y) AS y, sum(t * y) AS ty, sum(x * y) AS xy FROM xs",
    "ef": "SELECT (n * (tt * xy - tx * ty) - t * (t * xy - x * ty) + y * (t * tx - x * tt)) / (n * (tt * xx - tx * tx) - t * (t * xx - x * tx) + x * (t * tx - x * tt)) AS b FROM nm",
}


@query(
    "regressor_effect_one",
    sql(f"SELECT 'workplaces' AS regressor, {r('abs(b)', 'effect')} FROM ef", "cases", "mob_nat",
        extra={"mj": "SELECT * FROM cases LEFT JOIN mob_nat USING (date)", "mg": fill_sql("mj", ["date"], ["new_cases", "workplaces"])} | _effect),
)
def regressor_effect_one(spark, sf):
    model = additive.fit(national(spark, sf), calendar(spark, sf), spec=ONE_REGRESSOR)
    return rounded(additive.regressor_effect(model, spec=ONE_REGRESSOR))


@query("rolling_origin")
def rolling_origin(spark, sf):
    cases = views.daily_cases(spark, sf).drop("new_deaths")
    out = durable(additive.rolling_origin(cases, calendar(spark, sf)))  # read by the metrics and the coverage
    return rounded(additive.rolling_origin_metrics(out, NATIONAL.with_series("cutoff")))


def _line(group: str, obs: str, want: str) -> dict[str, str]:
    """The one-knot fit of each ``group`` of ``obs`` (day, y) at the days of ``want``: the intercept and the slope are
    eliminated by Cramer's rule, what is left of the knot's sums gives its change, shrunk towards zero."""
    spec = ONE_KNOT
    slope, knot = spec.penalties()[1], spec.penalties()[2]
    z = additive.NormalDist().inv_cdf(0.5 + spec.level / 2)
    t = "coalesce((day - first) / nullif(span, 0), 0)"
    return {
        "sp": f"SELECT {group}, min(day) AS first, (max(day) - min(day))::DOUBLE AS span, greatest(max(abs(y)), 1e-9) AS ys FROM {obs} GROUP BY {group}",
        "tr": f"SELECT {group}, t, greatest(t - {spec.changepoint_range}::DOUBLE, 0) AS h, y FROM (SELECT {group}, {t} AS t, y / ys AS y FROM {obs} JOIN sp USING ({group}))",
        "sm": f"SELECT {group}, count(*)::DOUBLE AS n, sum(t) AS t, sum(h) AS h, sum(t * t) AS tt, sum(t * h) AS th, sum(h * h) AS hh, sum(y) AS y, sum(t * y) AS ty, sum(h * y) AS hy, sum(y * y) AS yy FROM tr GROUP BY {group}",
        "el": f"SELECT *, n * (tt + {slope}) - t * t AS det FROM sm",
        "re": f"SELECT *, ((tt + {slope}) * h - t * th) / det AS h0, (n * th - t * h) / det AS h1, ((tt + {slope}) * y - t * ty) / det AS y0, (n * ty - t * y) / det AS y1 FROM el",
        "ch": f"SELECT *, CASE WHEN abs(hy - h * y0 - th * y1) <= {spec.absolute} THEN 0 ELSE (hy - h * y0 - th * y1 - sign(hy - h * y0 - th * y1) * {spec.absolute}) / (hh - h * h0 - th * h1) END AS d FROM re",
        "co": "SELECT *, y0 - h0 * d AS b0, y1 - h1 * d AS b1 FROM ch",
        "va": "SELECT *, greatest(yy - 2 * (b0 * y + b1 * ty + d * hy) + b0 * b0 * n + b1 * b1 * tt + d * d * hh + 2 * (b0 * b1 * t + b0 * d * h + b1 * d * th), 0) / n AS var, "
        f"n AS m00, t AS m01, h AS m02, tt + {slope} AS m11, th AS m12, hh + {knot} AS m22 FROM co",
        "iv": f"SELECT {group}, b0, b1, d, var, (m11 * m22 - m12 * m12) / dt AS c00, (m02 * m12 - m01 * m22) / dt AS c01, (m01 * m12 - m02 * m11) / dt AS c02, (m00 * m22 - m02 * m02) / dt AS c11, "
        "(m01 * m02 - m00 * m12) / dt AS c12, (m00 * m11 - m01 * m01) / dt AS c22 FROM (SELECT *, m00 * (m11 * m22 - m12 * m12) - m01 * (m01 * m22 - m12 * m02) + m02 * (m01 * m12 - m11 * m02) AS dt FROM va)",
        "pt": f"SELECT *, greatest(t - {spec.changepoint_range}::DOUBLE, 0) AS h FROM (SELECT *, {t} AS t FROM {want} JOIN sp USING ({group}) JOIN iv USING ({group}))",
        "fc": f"SELECT *, (b0 + b1 * t + d * h) * ys AS yhat, {z!r}::DOUBLE * ys * sqrt(var * (1 + c00 + t * t * c11 + h * h * c22 + 2 * (t * c01 + h * c02 + t * h * c12))) AS half FROM pt",
    }


_BAND = f"{r('yhat')}, {r('yhat - half', 'yhat_lower')}, {r('yhat + half', 'yhat_upper')}"
_DAYS = "date - DATE '1970-01-01' AS day"
_obs = {"obs": f"SELECT state, {_DAYS}, new_cases::DOUBLE AS y FROM state_split WHERE role <> 'test'"}
_tested = _obs | {"want": f"SELECT state, date, {_DAYS}, new_cases FROM state_split WHERE role = 'test'"} | _line("state", "obs", "want")


@query("additive_one_knot", sql(f"SELECT state, date, new_cases, {_BAND} FROM fc", "state_split", extra=_tested))
def additive_one_knot(spark, sf):
    cases = split_by_date(views.daily_cases_by_state(spark, sf), BY_STATE)
    model = additive.fit(cases.filter("role <> 'test'"), calendar(spark, sf), BY_STATE, spec=ONE_KNOT)
    return rounded(additive.score(cases.filter("role = 'test'"), model, calendar(spark, sf), BY_STATE, ONE_KNOT, keep=["new_cases"]))


_ahead = {
    "obs": f"SELECT state, {_DAYS}, new_cases::DOUBLE AS y FROM state_daily",
    "want": "SELECT state, (mx + k)::DATE AS date, mx + k - DATE '1970-01-01' AS day FROM (SELECT state, max(date) AS mx FROM state_daily GROUP BY 1), (SELECT unnest(range(1, 31))::INTEGER AS k)",
}


@query("forecast_one_knot", sql(f"SELECT state, date, {_BAND} FROM fc", "state_daily", extra=_ahead | _line("state", "obs", "want")))
def forecast_one_knot(spark, sf):
    df = views.daily_cases_by_state(spark, sf)
    model = additive.fit(df, calendar(spark, sf), BY_STATE, spec=ONE_KNOT)
    return rounded(additive.forecast_horizon(df, model, calendar(spark, sf), 30, BY_STATE, ONE_KNOT))


_cut = {
    "cuts": "SELECT (mx - 30 - 30 * k::INTEGER)::DATE AS cutoff FROM (SELECT mn, mx, unnest(range(0, greatest(floor((mx - mn - 210) / 30)::BIGINT + 1, 0))) AS k FROM (SELECT min(date) AS mn, max(date) AS mx FROM daily))",
    "obs": f"SELECT cutoff, {_DAYS}, new_cases::DOUBLE AS y FROM cuts JOIN daily ON date <= cutoff",
    "want": f"SELECT cutoff, date, {_DAYS}, (date - cutoff)::INTEGER AS horizon, new_cases::DOUBLE AS y_true FROM cuts JOIN daily ON date > cutoff AND date <= cutoff + 30",
}


@query(
    "rolling_origin_one_knot",
    sql(f"SELECT cutoff, date, horizon, 'additive' AS model, y_true, {r('yhat', 'y_pred')}, {r('yhat - half', 'y_lower')}, {r('yhat + half', 'y_upper')} FROM fc", "daily", extra=_cut | _line("cutoff", "obs", "want")),
)
def rolling_origin_one_knot(spark, sf):
    return rounded(additive.rolling_origin(views.daily_cases(spark, sf), calendar(spark, sf), spec=ONE_KNOT))


@query("sequence_forecast")
def sequence_forecast(spark, sf):
    df = split_by_date(views.daily_cases_by_state(spark, sf), BY_STATE)
    lagged = durable(lag_features(df, BY_STATE, lags=(1, 7)).na.drop())
    return rounded(learners.sequence_forecast(lagged, ["new_cases_lag_1", "new_cases_lag_7"], BY_STATE))


# One tree with one split is the best cut of a feature, and sequences of one row are a straight line.
ONE_SPLIT = learners.BoostedTrees(n_estimators=1, max_depth=1, subsample=1.0, colsample=1.0, min_child_weight=1)


def lagged_frame(spark, sf):
    """State panel with month, weekday, yesterday's value and a role column."""
    cases = split_by_date(views.daily_cases_by_state(spark, sf).drop("new_deaths"), BY_STATE)
    out = lag_features(cases, BY_STATE, lags=(1,)).na.drop()
    return written(out.withColumns({"month": F.month("date"), "weekday": F.weekday("date")}), "lagged")


def _cut(feature: str, name: str) -> dict[str, str]:
    """The cut of one feature that leaves the least squared error, and the means on either side."""
    return {
        f"{name}v": f"SELECT {feature} AS v, count(*) AS n, sum(new_cases)::DOUBLE AS s FROM lf WHERE role = 'train' GROUP BY 1",
        f"{name}c": f"SELECT v, lead(v) OVER (ORDER BY v) AS nv, sum(n) OVER (ORDER BY v) AS nl, sum(s) OVER (ORDER BY v) AS sl, sum(n) OVER () AS na, sum(s) OVER () AS sa FROM {name}v",
        name: f"SELECT (v + nv) / 2.0 AS cut, sl / nl AS lo, (sa - sl) / (na - nl) AS hi, sl * sl / nl + (sa - sl) * (sa - sl) / (na - nl) AS gain FROM {name}c WHERE nv IS NOT NULL ORDER BY gain DESC LIMIT 1",
    }


_lf = {"lf": "SELECT * FROM (SELECT state, date, new_cases, role, month(date) AS month, isodow(date) - 1 AS weekday, lag(new_cases, 1) OVER (PARTITION BY state ORDER BY date) AS l1 FROM state_split) WHERE l1 IS NOT NULL"}
_small = _lf | _cut("month", "bm") | {
    "bo": "SELECT state, date, 'boosted' AS model, new_cases::DOUBLE AS y_true, CASE WHEN month <= cut THEN lo ELSE hi END AS y_pred FROM lf, bm WHERE role = 'test'",
    "se": "SELECT state, date, 'sequence' AS model, new_cases::DOUBLE AS y_true, a + b * l1 AS y_pred FROM lf, (SELECT regr_slope(new_cases, l1) AS b, regr_intercept(new_cases, l1) AS a FROM lf WHERE role = 'train') WHERE role = 'test'",
}


def _boosted_once(df, features=("month",)):
    trees = replace(ONE_SPLIT, features=tuple(features))
    return trees.fit(df.filter("role = 'train'"))


def _one_row_sequences(df):
    return learners.sequence_forecast(df, ["new_cases_lag_1"], BY_STATE, length=1, estimator=LinearRegression(regParam=0.0, solver="normal"))


@query("gbt_one_split", sql(f"SELECT state, date, model, y_true, {r('y_pred')} FROM bo", "state_split", extra=_small))
def gbt_one_split(spark, sf):
    df = lagged_frame(spark, sf)
    return rounded(learners.predict(_boosted_once(df), df.filter("role = 'test'"), BY_STATE))


@query("model_restored", sql(f"SELECT state, date, model, y_true, {r('y_pred')} FROM bo", "state_split", extra=_small))
def model_restored(spark, sf):
    """A fitted model stored, loaded and applied."""
    df, path = lagged_frame(spark, sf), scratch_path(spark, "fitted")
    writers.save_model(_boosted_once(df), path)
    return rounded(learners.predict(writers.load_model(path), df.filter("role = 'test'"), BY_STATE))


@query(
    "search_with_objective",
    sql(f"SELECT 0::INTEGER AS trial, {r('avg(abs(new_cases - CASE WHEN month <= cut THEN lo ELSE hi END))', 'loss')}, 1::INTEGER AS trees, 1::INTEGER AS grown FROM lf, bm WHERE role = 'val'", "state_split", extra=_lf | _cut("month", "bm")),
)
def search_with_objective(spark, sf):
    """A search whose objective is the caller's: here the mean absolute error of a single split."""
    df = lagged_frame(spark, sf)
    base = replace(ONE_SPLIT, features=("month",))

    def objective(scored):
        return scored.agg(F.avg(F.abs(F.col("y_true") - F.col("y_pred")))).first()[0]

    trials, _ = learners.random_search(df.filter("role = 'train'"), df.filter("role = 'val'"), base, 1, {"learning_rate": (0.01, 0.3, "log")}, objective=objective)
    return rounded(trials.select("trial", "loss", "trees", "grown"))


@query("as_observations", sql(f"SELECT date AS ds, new_cases::DOUBLE AS y, {rs(['workplaces', 'retail_recreation'])} FROM inner_merged", "inner_merged"))
def as_observations(spark, sf):
    joined = merge_on_date(views.cases(spark, sf), daily_mean(views.mobility(spark, sf)))
    return rounded(additive.as_observations(joined, regressors=WITH_MOBILITY.regressors))


@query(
    "importance_one_split",
    sql("SELECT unnest(['month', 'weekday']) AS feature, unnest(CASE WHEN bm.gain >= bw.gain THEN [1.0::DOUBLE, 0.0::DOUBLE] ELSE [0.0::DOUBLE, 1.0::DOUBLE] END) AS importance FROM bm, bw", "state_split", extra=_lf | _cut("month", "bm") | _cut("weekday", "bw")),
)
def importance_one_split(spark, sf):
    df = lagged_frame(spark, sf)
    return rounded(learners.feature_importance(_boosted_once(df, ("month", "weekday")), df))


@query("sequence_one_row", sql(f"SELECT state, date, model, y_true, {r('y_pred')} FROM se", "state_split", extra=_small))
def sequence_one_row(spark, sf):
    return rounded(_one_row_sequences(lagged_frame(spark, sf)))


_scored = _small | {
    "bt": "SELECT * FROM bo UNION ALL SELECT * FROM se",
    "rc": "SELECT model, state, sum((y_true - y_pred) * (y_true - y_pred)) AS sse, count(*) AS k FROM (SELECT *, row_number() OVER (PARTITION BY model, state ORDER BY date DESC) AS p FROM bt) WHERE p <= 14 GROUP BY 1, 2",
    "em": "SELECT model, greatest(sqrt(sum(sse) / sum(k)), 1e-8) AS e, min(k) AS least FROM rc GROUP BY 1",
    "wt": "SELECT model, CASE WHEN min(least) OVER () >= 14 THEN (1 / e) / sum(1 / e) OVER () ELSE 1.0 / count(*) OVER () END AS weight FROM em",
    "al": "SELECT state, date, model, y_true, y_pred FROM bt UNION ALL SELECT state, date, 'ensemble', max(y_true), sum(weight * y_pred) FROM bt JOIN wt USING (model) GROUP BY state, date",
}


@query("train_and_evaluate_small", sql(metrics_sql("al", ["model"], ["model", "state"]), "state_split", extra=_scored))
def train_and_evaluate_small(spark, sf):
    """The whole chain of ``train_and_evaluate`` with one split and sequences of one row."""
    from ridgeline.operators import ensemble

    df = lagged_frame(spark, sf)
    boosted = learners.predict(_boosted_once(df), df.filter("role = 'test'"), BY_STATE)
    both = written(boosted.unionByName(_one_row_sequences(df)), "small")
    combined = ensemble.ensemble_predict(both, ensemble.weights_inverse_rmse(both, BY_STATE), BY_STATE)
    return rounded(metrics_all(both.unionByName(combined), ["model"], BY_STATE))


@query("train_and_evaluate")
def train_and_evaluate(spark, sf):
    """Split, fit boosted trees and a sequence model, weight them by recent error, score all."""
    from ridgeline.operators import ensemble

    df, _, model = _fit_trees(spark, sf)
    boosted = learners.predict(model, df.filter("role = 'test'"), BY_STATE)
    sequence = sequence_predictions(df)
    both = written(boosted.unionByName(sequence), "predictions")  # read by the weights, the ensemble and the metrics
    weights = ensemble.weights_inverse_rmse(both, BY_STATE)
    combined = ensemble.ensemble_predict(both, weights, BY_STATE)
    return rounded(metrics_all(both.unionByName(combined), ["model"], BY_STATE))


def sequence_predictions(df):
    return learners.sequence_forecast(df, ["new_cases_lag_1", "new_cases_lag_7"], BY_STATE)
