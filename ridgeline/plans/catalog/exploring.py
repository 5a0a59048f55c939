"""Profiles, correlations, trends, histograms and top rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgeline.functions.numeric import columns_containing, pct_change, plain_name, require
from ridgeline.functions.sizing import written
from ridgeline.operators import clean, explore, features
from ridgeline.operators.baselines import baselines
from ridgeline.operators.evaluate import regime_mae as regime_mae_of
from ridgeline.operators.evaluate import regime_share as regime_share_of
from ridgeline.operators.merge import merge_on_date
from ridgeline.operators.quantiles import exact_quantiles
from ridgeline.operators.segments import over_rows
from ridgeline.operators.splits import split_by_date
from ridgeline.panel import BY_STATE, NATIONAL
from ridgeline.plans import views
from ridgeline.plans.catalog import query, rounded
from ridgeline.plans.catalog.cleaning import raw_cases
from ridgeline.plans.oracle import MOB, WX, corr_sql, last_k, over, pct_sql, r, rows_sql, rs, sql

LINE_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def merged(spark, sf):
    return merge_on_date(views.cases(spark, sf), clean.daily_mean(views.mobility(spark, sf)))


def predictions(spark, sf):
    """Baseline predictions on the test slice of the national series."""
    split = split_by_date(views.cases(spark, sf), NATIONAL, 0.15, 0.1)
    return baselines(split.filter("role = 'test'"))


def quoted(name: str) -> str:
    return f"'{name}'"


_describe = rows_sql(
    [
        {
            "column": f"'{c}'", "count": f"count({c})", "mean": f"round(avg({c}), 6) + 0.0", "std": f"round(stddev_samp({c}), 6) + 0.0",
            "min": f"min({c}) + 0.0", "q25": f"round(quantile_cont({c}, 0.25), 6) + 0.0", "q50": f"round(quantile_cont({c}, 0.5), 6) + 0.0",
            "q75": f"round(quantile_cont({c}, 0.75), 6) + 0.0", "max": f"max({c})",
        }
        for c in LINE_MEASURES
    ]
)


@query("describe", f"SELECT {_describe} FROM lineitem")
def describe(spark, sf):
    return rounded(explore.describe(views.table(spark, sf, "lineitem"), LINE_MEASURES))


@query("null_counts", sql("SELECT * FROM (SELECT " + rows_sql([{"column": f"'{c}'", "nulls": f"count(*) FILTER (WHERE {c} IS NULL)"} for c in ["state", "date", *MOB]]) + " FROM mobility) WHERE nulls > 0", "mobility"))
def null_counts(spark, sf):
    return explore.null_counts(views.mobility(spark, sf))


_pcts = {
    "p": "SELECT "
    + ", ".join(f"{pct_sql(c, 'before_' + c)} AS {c}" for c in ("new_cases", "new_deaths"))
    + " FROM (SELECT *, lag(new_cases) OVER w AS before_new_cases, lag(new_deaths) OVER w AS before_new_deaths FROM state_daily WINDOW w AS (PARTITION BY state ORDER BY date))"
}


@query("inf_counts", sql("SELECT * FROM (SELECT " + rows_sql([{"column": f"'{c}'", "infinities": f"count(*) FILTER (WHERE isinf({c}))"} for c in ("new_cases", "new_deaths")]) + " FROM p) WHERE infinities > 0", "state_daily", extra=_pcts))
def inf_counts(spark, sf):
    cols = ["new_cases", "new_deaths"]
    rates = over_rows(
        views.daily_cases_by_state(spark, sf), BY_STATE,
        lambda w: {f"r_{c}": pct_change(F.col(c).cast("double"), F.lag(c, 1).over(w)) for c in cols}, back=1,
    )
    return explore.inf_counts(rates.select(*[F.col(f"r_{c}").alias(c) for c in cols]), cols)


@query("count_predicate", sql("SELECT " + rows_sql([{"column": f"'{c}'", "rows": f"count(*) FILTER (WHERE {c} < 0)"} for c in ("new_cases", "new_deaths")]) + " FROM raw_cases", "raw_cases"))
def count_predicate(spark, sf):
    return explore.count_where(raw_cases(spark, sf), {c: F.col(c) < 0 for c in ("new_cases", "new_deaths")})


@query("date_range_stats", sql(f"SELECT state, min(date) AS first_date, max(date) AS last_date, count(*) AS days, max(new_cases) AS peak, {r('avg(new_cases)', 'mean')}, {r('stddev_samp(new_cases)', 'std')} FROM state_daily GROUP BY 1", "state_daily"))
def date_range_stats(spark, sf):
    return rounded(explore.date_range_stats(views.daily_cases_by_state(spark, sf), by=["state"]))


@query("peak_row", sql("SELECT state, max(new_cases) AS peak, (arg_max(date, new_cases * 100000 - (date - DATE '1990-01-01')))::DATE AS peak_date, arg_max(new_cases, date) AS latest FROM state_daily GROUP BY 1", "state_daily"))
def peak_row(spark, sf):
    return explore.peak_row(views.daily_cases_by_state(spark, sf), by=["state"])


@query("tail_mean", sql(f"SELECT state, {r('avg(new_cases)', 'new_cases_last_30_mean')} FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY date DESC) AS k FROM state_daily) WHERE k <= 30 GROUP BY 1", "state_daily"))
def tail_mean(spark, sf):
    return rounded(explore.tail_mean(views.daily_cases_by_state(spark, sf), ["new_cases"], BY_STATE))


@query("quantiles", f"SELECT o_orderpriority, {r('quantile_cont(o_totalprice, 0.25)', 'q25', 4)}, {r('quantile_cont(o_totalprice, 0.75)', 'q75', 4)} FROM orders GROUP BY 1")
def quantiles(spark, sf):
    q = exact_quantiles(views.table(spark, sf, "orders"), ["o_totalprice"], [0.25, 0.75], ["o_orderpriority"])
    return rounded(q.select("o_orderpriority", F.col("o_totalprice")[0].alias("q25"), F.col("o_totalprice")[1].alias("q75")), 4)


def _corrs(cols, target="new_cases", src_prefix=""):
    return [{"column": f"'{c}'", "r": f"round({corr_sql(c, target)}, 6) + 0.0"} for c in cols]


@query("corr_target", sql(f"SELECT {rows_sql(_corrs(MOB))} FROM inner_merged", "inner_merged"))
def corr_target(spark, sf):
    return rounded(explore.corr_target(merged(spark, sf), MOB, "new_cases"))


_calendar = {
    "t": "SELECT *, isodow(date) - 1 AS day_of_week, day(date) AS day_of_month, month(date) AS month, year(date) AS year, "
    "week(date) AS week_of_year FROM inner_merged",
}
_RANKED = ["new_deaths", *MOB, "day_of_week", "day_of_month", "month", "year", "week_of_year", "lag_1", "lag_7", "mean_7", "max_7", "mean_14", "cumulative"]
_lagged = {
    "l": f"SELECT *, lag(new_cases, 1) OVER (ORDER BY date) AS lag_1, lag(new_cases, 7) OVER (ORDER BY date) AS lag_7, avg(new_cases) {over('', last_k(7))} AS mean_7, "
    f"max(new_cases) {over('', last_k(7))} AS max_7, avg(new_cases) {over('', last_k(14))} AS mean_14, sum(new_cases) OVER (ORDER BY date) AS cumulative FROM t"
}


@query(
    "corr_ranked",
    sql(f"SELECT \"column\", round(r_abs, 6) + 0.0 AS r_abs FROM (SELECT \"column\", abs(r) AS r_abs FROM (SELECT {rows_sql([{'column': quoted(c), 'r': corr_sql(c, 'new_cases')} for c in _RANKED])} FROM l)) ORDER BY r_abs DESC LIMIT 15",
        "inner_merged", extra=_calendar | _lagged),
)
def corr_ranked(spark, sf):
    t = features.temporal_features(merged(spark, sf))
    t = features.lag_features(t, lags=(1, 7))
    t = features.rolling_features(t, windows=(7, 14))
    t = features.growth_features(t)
    short = t.withColumnsRenamed(
        {"new_cases_lag_1": "lag_1", "new_cases_lag_7": "lag_7", "new_cases_rolling_mean_7": "mean_7",
         "new_cases_rolling_max_7": "max_7", "new_cases_rolling_mean_14": "mean_14", "new_cases_cumulative": "cumulative"}
    )
    return rounded(explore.corr_ranked(short, _RANKED, "new_cases"))


_MATRIX = ["new_cases", "new_deaths", *MOB, *WX]
_cells = [{"row": f"'{a}'", "column": f"'{b}'", "r": f"round({corr_sql(a, b)}, 6) + 0.0"} for a in _MATRIX for b in _MATRIX]


@query("corr_matrix", sql(f"SELECT {rows_sql(_cells)} FROM panel", "panel"))
def corr_matrix(spark, sf):
    panel = views.cases_by_state(spark, sf).join(views.mobility(spark, sf), ["state", "date"], "left").join(
        views.weather(spark, sf), ["state", "date"], "left"
    )
    return rounded(explore.corr_matrix(panel, _MATRIX))


_shift = "SELECT new_cases, " + ", ".join(f"lag({c}, {k}) OVER (ORDER BY date) AS {c}_{k}" for c in MOB for k in range(21)) + " FROM inner_merged"
_lag_rows = rows_sql([{"column": f"'{c}'", "lag": str(k), "r": corr_sql(f"{c}_{k}", "new_cases")} for c in MOB for k in range(21)])


@query("lag_corr", sql("SELECT \"column\", lag::INTEGER AS lag, " + r("r") + f" FROM (SELECT {_lag_rows} FROM s)", "inner_merged", extra={"s": _shift}))
def lag_corr(spark, sf):
    return rounded(explore.lag_corr(merged(spark, sf), MOB, "new_cases"))


@query("best_lag", sql("SELECT \"column\", arg_max(lag, abs(r))::INTEGER AS lag, " + r("arg_max(r, abs(r))", "r") + f" FROM (SELECT {_lag_rows} FROM s) GROUP BY 1", "inner_merged", extra={"s": _shift}))
def best_lag(spark, sf):
    return rounded(explore.best_lag(explore.lag_corr(merged(spark, sf), MOB, "new_cases")))


_trend = rows_sql([{"column": f"'{c}'", "slope": f"regr_slope(new_cases, {c})", "intercept": f"regr_intercept(new_cases, {c})", "lo": f"min({c})", "hi": f"max({c})"} for c in MOB])


@query("linear_trend", sql(f"SELECT \"column\", {rs(['slope', 'intercept'])}, point::INTEGER AS point, {r('lo + (hi - lo) * point / 99', 'x')}, {r('intercept + slope * (lo + (hi - lo) * point / 99)', 'y')} FROM (SELECT {_trend} FROM inner_merged), (SELECT unnest(range(100)) AS point)", "inner_merged"))
def linear_trend(spark, sf):
    return rounded(explore.linear_trend(merged(spark, sf), MOB, "new_cases"))


_best = {"tr": f"SELECT {_trend} FROM inner_merged", "rk": f"SELECT {rows_sql([{'column': quoted(c), 'r': corr_sql(c, 'new_cases')} for c in MOB])} FROM inner_merged"}


@query(
    "top_trends",
    sql(f"SELECT \"column\", {rs(['slope', 'intercept'])}, point::INTEGER AS point, {r('lo + (hi - lo) * point / 99', 'x')}, {r('intercept + slope * (lo + (hi - lo) * point / 99)', 'y')} FROM tr, (SELECT unnest(range(100)) AS point) WHERE \"column\" IN (SELECT \"column\" FROM rk ORDER BY abs(r) DESC LIMIT 4)", "inner_merged", extra=_best),
)
def top_trends(spark, sf):
    return rounded(explore.top_trends(written(merged(spark, sf), "merged"), MOB, "new_cases"))


@query("columns_by_substring", sql(f"SELECT date, {rs(['retail_recreation', 'residential'])} FROM inner_merged", "inner_merged"))
def columns_by_substring(spark, sf):
    """The measures whose name contains a piece of text."""
    df = merged(spark, sf)
    require(df, "date", *MOB)
    return rounded(df.select("date", *[c for c in columns_containing(df, "re") if c in ("retail_recreation", "residential")]))


@query("plain_names", sql("SELECT DISTINCT replace(n_name, 'NATION_', 'Nation ') AS name, o_orderpriority, CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN '1-urgent' WHEN '2' THEN '2-high' WHEN '3' THEN '3-medium' WHEN '4' THEN '4-not Specified' ELSE '5-low' END AS priority FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"))
def plain_names(spark, sf):
    orders = views.table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority").distinct()
    customer = views.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    named = orders.join(customer, "c_custkey").select("c_nationkey", "o_orderpriority").distinct().join(views.nations(spark, sf, "c_nationkey"), "c_nationkey")
    return named.selectExpr(f"{plain_name('state')} AS name", "o_orderpriority", f"{plain_name('o_orderpriority')} AS priority")


@query(
    "histogram_density",
    "WITH b AS (SELECT l_returnflag, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(*) AS n FROM lineitem GROUP BY 1), "
    "v AS (SELECT l_returnflag, lo, hi, n, least(floor((l_extendedprice - lo) / ((hi - lo) / 30)), 29)::INTEGER AS bin FROM lineitem JOIN b USING (l_returnflag)) "
    f"SELECT l_returnflag, bin, {r('lo + (hi - lo) / 30 * bin', 'left_edge', 4)}, count(*) AS rows, {r('count(*) / (n * ((hi - lo) / 30))', 'density', 9)} FROM v GROUP BY l_returnflag, bin, lo, hi, n",
)
def histogram_density(spark, sf):
    h = explore.histogram_density(views.table(spark, sf, "lineitem"), "l_extendedprice", 30, ["l_returnflag"])
    return h.withColumns({"left_edge": F.round("left_edge", 4), "density": F.round("density", 9)})


@query("nlargest", sql("SELECT date, new_cases FROM daily ORDER BY new_cases DESC, date LIMIT 5", "daily"))
def nlargest(spark, sf):
    return explore.nlargest(views.daily_cases(spark, sf).drop("new_deaths"), "new_cases", 5)


@query("topk_abs", sql(f"SELECT \"column\", {r('r')} FROM (SELECT {rows_sql([{'column': quoted(c), 'r': corr_sql(c, 'new_cases')} for c in MOB])} FROM inner_merged) ORDER BY abs(r) DESC LIMIT 4", "inner_merged"))
def topk_abs(spark, sf):
    return rounded(explore.topk_abs(explore.corr_target(merged(spark, sf), MOB, "new_cases"), 4))


_regime = "SELECT *, CASE WHEN y_true > (SELECT avg(y_true) + stddev_pop(y_true) FROM base) THEN 'Surge' WHEN y_true < (SELECT avg(y_true) - stddev_pop(y_true) FROM base) THEN 'Low' ELSE 'Endemic' END AS regime FROM "


@query("regime_share", sql(f"SELECT regime, count(*) AS rows, {r('count(*) / (SELECT count(*) FROM base)', 'share')} FROM g GROUP BY 1", "base", extra={"g": _regime + "base"}))
def regime_share(spark, sf):
    truth = predictions(spark, sf).filter("model = 'naive'")
    return rounded(regime_share_of(truth))


@query("regime_mae", sql(f"SELECT regime, model, {r('avg(abs(y_true - y_pred))', 'mae')}, count(*) AS n_samples FROM g GROUP BY 1, 2", "preds", extra={"g": _regime + "preds"}))
def regime_mae(spark, sf):
    return rounded(regime_mae_of(predictions(spark, sf)))


_pivot = ", ".join(f"round_even(avg(abs(y_true - y_pred)) FILTER (WHERE model = '{m}'), 0)::DOUBLE AS {m}" for m in ("naive", "seasonal", "ma7"))


@query("pivot_mean", sql(f"SELECT regime, {_pivot} FROM g GROUP BY 1", "preds", extra={"g": _regime + "preds"}))
def pivot_mean(spark, sf):
    return explore.pivot_mean(regime_mae_of(predictions(spark, sf)), "regime", "model", ["naive", "seasonal", "ma7"], "mae")


_steps = {
    "s": f"SELECT state, date, round(avg(new_cases) {over('state', last_k(7))}, 6) AS v FROM state_daily",
    "p": "SELECT *, row_number() OVER (PARTITION BY state ORDER BY date) - 1 AS pos, lag(v) OVER (PARTITION BY state ORDER BY date) AS pv FROM s",
    "k": "SELECT *, lead(v) OVER (PARTITION BY state ORDER BY date) AS nv, lead(pos) OVER (PARTITION BY state ORDER BY date) AS np FROM p WHERE pv IS NULL OR pv <> v",
}


def smoothed(spark, sf):
    out = clean.cases_derived(views.daily_cases_by_state(spark, sf), BY_STATE)
    return out.withColumn("v", F.round("new_cases_7day_avg", 6))


@query("peak_candidates", sql(f"SELECT state, floor((pos + np - 1) / 2)::BIGINT AS pos, {r('v', 'value')} FROM k WHERE pv < v AND nv < v AND v >= 1.5", "state_daily", extra=_steps))
def peak_candidates(spark, sf):
    return rounded(explore.peak_candidates(smoothed(spark, sf), "v", BY_STATE, 1.5))


_greedy = _steps | {
    "c": "SELECT state, pos, value, row_number() OVER (PARTITION BY state ORDER BY value DESC, pos DESC) AS rk FROM (SELECT state, floor((pos + np - 1) / 2)::BIGINT AS pos, v AS value FROM k WHERE pv < v AND nv < v AND v >= 1.5)",
    "g": "SELECT DISTINCT state, 0::BIGINT AS rk, []::BIGINT[] AS kept FROM c UNION ALL SELECT g.state, c.rk, CASE WHEN len(list_filter(g.kept, lambda x: abs(x - c.pos) < 60)) = 0 THEN list_append(g.kept, c.pos) ELSE g.kept END FROM g JOIN c ON c.state = g.state AND c.rk = g.rk + 1",
}
_peaks = sql(
    "SELECT c.state, c.pos, round(c.value, 6) + 0.0 AS value, p.date FROM c JOIN (SELECT state, arg_max(kept, rk) AS kept FROM g GROUP BY 1) z "
    "ON c.state = z.state AND list_contains(z.kept, c.pos) JOIN p ON p.state = c.state AND p.pos = c.pos",
    "state_daily", extra=_greedy,
).replace("WITH ", "WITH RECURSIVE ", 1)


@query("peaks", _peaks)
def peaks(spark, sf):
    return rounded(explore.peaks(smoothed(spark, sf), "v", BY_STATE, height=1.5, distance=60))


@query("recent_window", sql("SELECT state, date, new_cases, new_deaths FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY date DESC) AS k FROM state_daily) WHERE k <= 14", "state_daily"))
def recent_window(spark, sf):
    return explore.recent_rows(views.daily_cases_by_state(spark, sf), BY_STATE, 14)


@query("head", sql("SELECT state, date, new_cases FROM state_daily ORDER BY date, state LIMIT 15", "state_daily"))
def head(spark, sf):
    """First rows of the panel in date order: a top-k, not a full sort."""
    return views.daily_cases_by_state(spark, sf).select("state", "date", "new_cases").orderBy("date", "state").limit(15)
