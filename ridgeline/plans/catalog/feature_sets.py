"""Features of single series and of panels."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ridgeline.functions.numeric import pct_change as pct_change_of
from ridgeline.operators import clean, features
from ridgeline.operators.merge import merge_outer
from ridgeline.operators.segments import number_rows, over_rows, running_sum
from ridgeline.panel import BY_STATE, NATIONAL
from ridgeline.plans import views
from ridgeline.plans.catalog import query, rounded
from ridgeline.plans.catalog.cleaning import LINE_KEYS, LINES, lines
from ridgeline.plans.catalog.merging import national_row_mean_raw
from ridgeline.plans.oracle import LINE_ORDER, MOB, UPTO, WX, clip_sql, fill_sql, last_k, over, pct_sql, r, rs, sql

S = "PARTITION BY state ORDER BY date"
KEYS = "state, date, new_cases"


def state_cases(spark, sf):
    return views.daily_cases_by_state(spark, sf).drop("new_deaths")


def joined_panel(spark, sf):
    return views.cases_by_state(spark, sf).join(views.mobility_and_weather(spark, sf), ["state", "date"], "left")


@query("national_daily", sql(f"SELECT date, new_cases, {r(f'avg(new_cases) OVER (ORDER BY date {last_k(7)})', 'new_cases_7day_avg')}, lag(new_cases, 7) OVER (ORDER BY date) AS new_cases_lag_7 FROM daily", "daily"))
def national_daily(spark, sf):
    """Daily counts with their 7-row mean and 7-row lag: one scan, one aggregate, one window."""
    daily = views.daily_cases(spark, sf).drop("new_deaths")
    averaged = features.rolling_features(daily, windows=(7,)).withColumnRenamed("new_cases_rolling_mean_7", "new_cases_7day_avg")
    out = features.lag_features(averaged, lags=(7,))
    return rounded(out.select("date", "new_cases", "new_cases_7day_avg", "new_cases_lag_7"))


@query("diff", sql(f"SELECT state, date, confirmed, deaths, coalesce(confirmed - lag(confirmed) OVER ({S}), 0)::DOUBLE AS d_confirmed, coalesce(deaths - lag(deaths) OVER ({S}), 0)::DOUBLE AS d_deaths FROM state_cases", "state_cases"))
def diff(spark, sf):
    cases = views.cases_by_state(spark, sf).select("state", "date", "confirmed", "deaths")
    return clean.first_difference(cases, BY_STATE, {"d_confirmed": "confirmed", "d_deaths": "deaths"})


_dow, _month = "isodow(date) - 1", "month(date)"
_holiday = "((month(date) = 1 AND day(date) = 26) OR (month(date) = 8 AND day(date) = 15) OR (month(date) = 10 AND day(date) = 2) OR (month(date) IN (10, 11) AND day(date) BETWEEN 20 AND 30))::INTEGER AS is_major_holiday"
TEMPORAL = (
    f"({_dow})::INTEGER AS day_of_week, day(date)::INTEGER AS day_of_month, month(date)::INTEGER AS month, year(date)::INTEGER AS year, "
    f"week(date)::INTEGER AS week_of_year, ({_dow} >= 5)::INTEGER AS is_weekend, sin(2 * pi() * ({_dow}) / 7) AS day_of_week_sin, cos(2 * pi() * ({_dow}) / 7) AS day_of_week_cos, "
    f"sin(2 * pi() * {_month} / 12) AS month_sin, cos(2 * pi() * {_month} / 12) AS month_cos, {_holiday}"
)
TEMPORAL_INT = ["day_of_week", "day_of_month", "month", "year", "week_of_year", "is_weekend", "is_major_holiday"]
TEMPORAL_DBL = ["day_of_week_sin", "day_of_week_cos", "month_sin", "month_cos"]


@query("temporal_features", sql(f"SELECT date, new_cases, {', '.join(TEMPORAL_INT)}, {rs(TEMPORAL_DBL)} FROM t", "daily", extra={"t": f"SELECT date, new_cases, {TEMPORAL} FROM daily"}))
def temporal_features(spark, sf):
    return rounded(features.temporal_features(views.daily_cases(spark, sf).drop("new_deaths")))


@query("is_major_holiday", f"SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, {_holiday.replace('date)', 'o_orderdate)')} FROM orders")
def is_major_holiday(spark, sf):
    from ridgeline.functions.calendar import is_major_holiday as flag

    orders = views.table(spark, sf, "orders").select("o_orderkey", views.day("o_orderdate").alias("date"))
    return orders.withColumn("is_major_holiday", flag(F.col("date")))


LAGS = ", ".join(f"lag(new_cases, {k}) OVER ({S}) AS new_cases_lag_{k}" for k in (1, 3, 7, 14))


@query("lag_features", sql(f"SELECT {KEYS}, {LAGS} FROM state_daily", "state_daily"))
def lag_features(spark, sf):
    return features.lag_features(state_cases(spark, sf), BY_STATE)


_line_lags = ", ".join(f"lag(l_quantity, {k}) {over('l_suppkey', '', LINE_ORDER)} AS l_quantity_lag_{k}" for k in (1, 3, 7, 14))


@query("lag_features_rows", sql(f"SELECT {', '.join(LINE_KEYS)}, l_quantity, {_line_lags} FROM lines", "lines"))
def lag_features_rows(spark, sf):
    return features.lag_features(lines(spark, sf).select(*LINE_KEYS, "l_quantity"), LINES, "l_quantity")


def rolling_sql(target: str, part: str, order: str = "date", ks=(3, 7, 14)) -> str:
    return ", ".join(
        f"{fn}({target}) {over(part, last_k(k), order)} AS {target}_rolling_{name}_{k}"
        for k in ks
        for fn, name in (("avg", "mean"), ("stddev_samp", "std"), ("max", "max"))
    )


ROLL_DBL = [f"new_cases_rolling_{s}_{k}" for k in (3, 7, 14) for s in ("mean", "std")]
ROLL_MAX = [f"new_cases_rolling_max_{k}" for k in (3, 7, 14)]


@query("rolling_features", sql(f"SELECT {KEYS}, {rs(ROLL_DBL)}, {', '.join(ROLL_MAX)} FROM x", "state_daily", extra={"x": f"SELECT *, {rolling_sql('new_cases', 'state')} FROM state_daily"}))
def rolling_features(spark, sf):
    return rounded(features.rolling_features(state_cases(spark, sf), BY_STATE))


_line_roll = [f"l_quantity_rolling_{s}_{k}" for k in (3, 7, 14) for s in ("mean", "std", "max")]


@query("rolling_features_rows", sql(f"SELECT {', '.join(LINE_KEYS)}, l_quantity, {rs(_line_roll)} FROM x", "lines", extra={"x": f"SELECT *, {rolling_sql('l_quantity', 'l_suppkey', LINE_ORDER)} FROM lines"}))
def rolling_features_rows(spark, sf):
    return rounded(features.rolling_features(lines(spark, sf).select(*LINE_KEYS, "l_quantity"), LINES, "l_quantity"))


@query("cumulative_rows", sql(f"SELECT {', '.join(LINE_KEYS)}, l_quantity, sum(l_quantity) {over('l_suppkey', UPTO, LINE_ORDER)} AS running FROM lines", "lines"))
def cumulative_rows(spark, sf):
    return running_sum(lines(spark, sf).select(*LINE_KEYS, "l_quantity"), LINES, {"running": "l_quantity"})


@query("rolling_7day", sql(f"SELECT {KEYS}, {r(f'avg(new_cases) OVER ({S} {last_k(7)})', 'new_cases_7day_avg')} FROM state_daily", "state_daily"))
def rolling_7day(spark, sf):
    return rounded(clean.cases_derived(state_cases(spark, sf), BY_STATE))


_growth_rate = clip_sql(f"(coalesce({pct_sql('confirmed', 'before')}, 0) * 100)", "-100", "500")


@query("growth_rate", sql(f"SELECT state, date, confirmed, {r(_growth_rate, 'growth_rate')} FROM (SELECT *, lag(confirmed) OVER ({S}) AS before FROM state_cases)", "state_cases"))
def growth_rate(spark, sf):
    cases = views.cases_by_state(spark, sf).select("state", "date", "confirmed")
    return rounded(clean.confirmed_growth(cases, BY_STATE))


def growth_sql(target: str, part: str) -> dict[str, str]:
    """Expressions g0 / g1 (growth now and one row earlier) and the three growth features."""
    w = over(part)
    return {
        "g": f"SELECT *, {pct_sql(target, 'c1')} AS g0, {pct_sql('c1', 'c2')} AS g1 FROM (SELECT *, lag({target}, 1) {w} AS c1, lag({target}, 2) {w} AS c2, "
        f"CAST(sum({target}) {w} AS BIGINT) AS {target}_cumulative FROM {{src}})",
        "growth": clip_sql("(g0 * 100)", "-100", "500"),
        "accel": clip_sql("(CASE WHEN NOT isnan(g0 - g1) THEN (g0 - g1) * 100 END)", "-100", "100"),
    }


_g = growth_sql("new_deaths", "state")


@query("growth_features", sql(f"SELECT state, date, new_deaths, {r(_g['growth'], 'new_deaths_growth_rate')}, {r(_g['accel'], 'new_deaths_acceleration')}, new_deaths_cumulative FROM g", "state_daily", extra={"g": _g["g"].format(src="state_daily")}))
def growth_features(spark, sf):
    cases = views.daily_cases_by_state(spark, sf).drop("new_cases")
    return rounded(features.growth_features(cases, BY_STATE, "new_deaths"))


@query("case_fatality_rate", sql(f"SELECT state, date, {r('deaths / greatest(confirmed, 1) * 100', 'case_fatality_rate')} FROM state_cases", "state_cases"))
def case_fatality_rate(spark, sf):
    out = clean.cases_derived(views.cases_by_state(spark, sf), BY_STATE)
    return rounded(out.select("state", "date", "case_fatality_rate"))


INDEX = "coalesce(retail_recreation, 0) * -0.25 + coalesce(transit, 0) * -0.25 + coalesce(workplaces, 0) * -0.25 + coalesce(residential, 0) * 0.25"


@query("mobility_index", sql(f"SELECT state, date, {rs(MOB)}, {r(INDEX, 'mobility_index')} FROM mobility", "mobility"))
def mobility_index(spark, sf):
    return rounded(features.mobility_index(views.mobility(spark, sf)))


MOB_LAGS = [f"{c}_lag_{k}" for c in MOB for k in (7, 14)]
MOB_LAG_SQL = ", ".join(f"lag({c}, {k}) OVER ({S}) AS {c}_lag_{k}" for c in MOB for k in (7, 14))


@query("mobility_lags", sql(f"SELECT state, date, {rs(MOB + MOB_LAGS)} FROM (SELECT *, {MOB_LAG_SQL} FROM mobility)", "mobility"))
def mobility_lags(spark, sf):
    return rounded(features.mobility_lags(views.mobility(spark, sf), BY_STATE))


@query("smoothed_growth", sql(f"SELECT state, date, {r(clip_sql('growth_rate', '-20', '50'), 'growth_rate_clipped')}, {r(clip_sql('smooth', '-10', '30'), 'growth_rate_smooth')} FROM (SELECT *, avg(growth_rate) OVER ({S} {last_k(7)}) AS smooth FROM (SELECT *, {_growth_rate} AS growth_rate FROM (SELECT *, lag(confirmed) OVER ({S}) AS before FROM state_cases)))", "state_cases"))
def smoothed_growth(spark, sf):
    grown = clean.confirmed_growth(views.cases_by_state(spark, sf), BY_STATE)
    out = features.smoothed_growth(grown, BY_STATE)
    return rounded(out.select("state", "date", "growth_rate_clipped", "growth_rate_smooth"))


def _bins(pick: int) -> str:
    vals = [("cold", 0, -50, 15), ("mild", 1, 15, 25), ("warm", 2, 25, 35), ("hot", 3, 35, 50)]
    whens = " ".join(f"WHEN temperature_mean > {lo} AND temperature_mean <= {hi} THEN {repr(n) if pick == 0 else i}" for n, i, lo, hi in vals)
    return f"CASE {whens}{'' if pick == 0 else ' ELSE -1'} END"


WEATHER = f"{_bins(0)} AS temp_category, ({_bins(1)})::INTEGER AS temp_category_encoded, coalesce((humidity_mean > 70)::INTEGER, 0) AS humidity_high, coalesce((precipitation > 0)::INTEGER, 0) AS has_precipitation"


@query("temp_category", sql(f"SELECT state, date, {rs(WX, 9)}, {WEATHER} FROM weather", "weather"))
def temp_category(spark, sf):
    return rounded(features.weather_features(views.weather(spark, sf)), 9)


_inter = {
    "p": "SELECT * FROM panel LEFT JOIN demo USING (state)",
    "q": f"SELECT *, {INDEX} AS mobility_index, lag(new_cases, 7) OVER ({S}) AS new_cases_lag_7, lag(workplaces, 7) OVER ({S}) AS workplaces_lag_7 FROM p",
}


@query(
    "interactions",
    sql(f"SELECT state, date, {r('mobility_index * ln(1 + population_millions)', 'mobility_pop_interaction')}, {r('temperature_mean * (isodow(date) <= 5)::INTEGER', 'temp_weekday')}, {r('new_cases_lag_7 * workplaces_lag_7 / 100', 'cases_mobility_interaction')} FROM q", "panel", "demo", extra=_inter),
)
def interactions(spark, sf):
    panel = joined_panel(spark, sf).join(views.demographics(spark, sf), "state", "left")
    out = features.temporal_features(panel)
    out = features.lag_features(out, BY_STATE, lags=(7,))
    out = features.interactions(features.mobility_features(out, BY_STATE))
    return rounded(out.select("state", "date", "mobility_pop_interaction", "temp_weekday", "cases_mobility_interaction"))


def all_features_sql(src: str, part: str, have: list[str], weather: bool) -> tuple[dict[str, str], list[str], list[str]]:
    """Expressions building every feature of ``src``; and the integer and double column names."""
    w, g = over(part), growth_sql("new_cases", part)
    mob_lags = ", ".join(f"lag({c}, {k}) {w} AS {c}_lag_{k}" for c in MOB for k in (7, 14))
    lags = ", ".join(f"lag(new_cases, {k}) {w} AS new_cases_lag_{k}" for k in (1, 3, 7, 14))
    wx = f", {WEATHER}, temperature_mean * (isodow(date) <= 5)::INTEGER AS temp_weekday" if weather else ""
    f1 = f"SELECT *, {TEMPORAL}, {lags}, {rolling_sql('new_cases', part)}, {mob_lags}, {INDEX} AS mobility_index{wx} FROM g"
    f2 = f"SELECT *, {g['growth']} AS new_cases_growth_rate, {g['accel']} AS new_cases_acceleration, new_cases_lag_7 * workplaces_lag_7 / 100 AS cases_mobility_interaction FROM f1"
    dbl = (
        have + MOB + (WX if weather else []) + TEMPORAL_INT + TEMPORAL_DBL + [f"new_cases_lag_{k}" for k in (1, 3, 7, 14)] + ROLL_DBL + ROLL_MAX
        + ["new_cases_growth_rate", "new_cases_acceleration", "new_cases_cumulative", "mobility_index", *MOB_LAGS, "cases_mobility_interaction"]
        + (["temp_category_encoded", "humidity_high", "has_precipitation", "temp_weekday"] if weather else [])
    )
    cols = ", ".join(f"coalesce({c}::DOUBLE, (SELECT median({c}::DOUBLE) FROM f2)) AS {c}" for c in dbl)
    extra = {"g": g["g"].format(src=src), "f1": f1, "f2": f2}
    return extra | {"f3": f"SELECT {part + ', ' if part else ''}date, {'temp_category, ' if weather else ''}{cols} FROM f2"}, dbl, ["temp_category"] if weather else []


_NUM = ["new_cases", "new_deaths", "confirmed", "deaths"]
_panel_extra, _panel_cols, _ = all_features_sql("panel", "state", _NUM, True)


@query("build_all_features", sql(f"SELECT state, date, temp_category, {rs(_panel_cols)} FROM f3", "panel", extra=_panel_extra))
def build_all_features(spark, sf):
    return as_doubles(features.build_all_features(joined_panel(spark, sf), BY_STATE))


def as_doubles(df):
    keys = {"state", "date", "temp_category"}
    return rounded(df.select(*[F.col(c) if c in keys else F.col(c).cast("double").alias(c) for c in df.columns]))


_nat_extra, _nat_cols, _ = all_features_sql("fo", "", _NUM, False)
_outer = {"o": "SELECT * FROM cases FULL JOIN mob_row USING (date)", "fo": fill_sql("o", ["date"], _NUM + MOB)}


def national_features(spark, sf):
    """Outer-joined, filled and featured national series without NULL rows."""
    full = merge_outer(views.cases(spark, sf), national_row_mean_raw(spark, sf))
    return clean.drop_nulls(features.build_all_features(full, NATIONAL))


@query("quick_process", sql(f"SELECT date, {rs(_nat_cols)} FROM f3", "cases", "mob_row", extra=_outer | _nat_extra))
def quick_process(spark, sf):
    return as_doubles(national_features(spark, sf))


_model_cols = [c for c in _nat_cols if c not in ("new_cases", "confirmed", "deaths")]


@query("prepare_xy", sql(f"SELECT date, new_cases::DOUBLE AS label, {rs(_model_cols)} FROM f3", "cases", "mob_row", extra=_outer | _nat_extra))
def prepare_xy(spark, sf):
    """The feature vector, taken apart under the names that come with it."""
    full = merge_outer(views.cases(spark, sf), national_row_mean_raw(spark, sf))
    ready, names = features.prepare_xy(full, NATIONAL)
    values = ready.select("date", "label", vector_to_array("features").alias("_v"))
    return rounded(values.select("date", "label", *[F.col("_v")[i].alias(n) for i, n in enumerate(names)]))


@query("feature_minmax", sql("SELECT feature, min, max, CASE WHEN max = min THEN 1.0::DOUBLE ELSE round(max - min, 6) END AS range FROM (SELECT unnest([" + ", ".join(f"{{'feature': '{c}', 'min': min({c}) + 0.0::DOUBLE, 'max': max({c})::DOUBLE}}" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")) + "], recursive := true) FROM lineitem)"))
def feature_minmax(spark, sf):
    return rounded(features.feature_minmax(views.table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


@query("min_max_scale", f"SELECT l_orderkey, l_linenumber, {r('(l_quantity - (SELECT min(l_quantity) FROM lineitem)) / (SELECT max(l_quantity) - min(l_quantity) FROM lineitem)', 'l_quantity')}, {r('(l_tax - (SELECT min(l_tax) FROM lineitem)) / (SELECT max(l_tax) - min(l_tax) FROM lineitem)', 'l_tax')} FROM lineitem")
def min_max_scale(spark, sf):
    lines_ = views.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    return rounded(features.min_max_scale(lines_, ["l_quantity", "l_tax"]))


_seq_w = f"OVER ({S} {last_k(14)})"


@query(
    "sequences",
    sql(f"SELECT state, date, 14::INTEGER AS length, first_value(new_cases) {_seq_w} ::DOUBLE AS first_cases, sum(new_cases) {_seq_w} ::DOUBLE AS sum_cases, sum(new_deaths) {_seq_w} ::DOUBLE AS sum_deaths, new_cases::DOUBLE AS target FROM state_daily QUALIFY row_number() OVER ({S}) >= 14", "state_daily"),
)
def sequences(spark, sf):
    blocks = features.sequences(views.daily_cases_by_state(spark, sf), ["new_cases", "new_deaths"], "new_cases", BY_STATE)

    def total(i):
        return F.aggregate("sequence", F.lit(0.0), lambda a, row: a + row[i])

    return blocks.select(
        "state", "date", F.size("sequence").alias("length"), F.col("sequence")[0][0].alias("first_cases"),
        total(0).alias("sum_cases"), total(1).alias("sum_deaths"), F.col("sequence_target").cast("double").alias("target"),
    )


@query("position", sql(f"SELECT state, date, new_cases, row_number() OVER ({S}) - 1 AS pos FROM state_daily", "state_daily"))
def position(spark, sf):
    return number_rows(state_cases(spark, sf), BY_STATE)


@query("position_rows", sql(f"SELECT {', '.join(LINE_KEYS)}, row_number() {over('l_suppkey', '', LINE_ORDER)} - 1 AS pos FROM lines", "lines"))
def position_rows(spark, sf):
    return number_rows(lines(spark, sf).select(*LINE_KEYS), LINES)


_pct = pct_sql("new_deaths", "before")


@query("pct_change", sql(f"SELECT state, date, CASE WHEN isinf(p) THEN sign(p) * 999.0 ELSE round(p, 6) + 0.0 END::DOUBLE AS pct FROM (SELECT state, date, {_pct} AS p FROM (SELECT *, lag(new_deaths) OVER ({S}) AS before FROM state_daily))", "state_daily"))
def pct_change(spark, sf):
    """Ratio to the previous row; the infinity over a zero base is shown as 999."""
    cases = views.daily_cases_by_state(spark, sf)
    out = over_rows(
        cases, BY_STATE, lambda w: {"pct": pct_change_of(F.col("new_deaths").cast("double"), F.lag("new_deaths", 1).over(w))}, back=1
    )
    shown = F.when(F.abs("pct") == F.lit(float("inf")), F.signum("pct") * 999.0).otherwise(F.round("pct", 6))
    return out.select("state", "date", shown.alias("pct"))


@query("mobility_features", sql(f"SELECT state, date, {rs(MOB)}, {r(INDEX, 'mobility_index')}, {rs(MOB_LAGS)} FROM (SELECT *, {MOB_LAG_SQL} FROM mobility)", "mobility"))
def mobility_features(spark, sf):
    return rounded(features.mobility_features(views.mobility(spark, sf), BY_STATE))


@query("weather_features", sql(f"SELECT state, date, {rs(WX, 9)}, {WEATHER} FROM weather", "weather"))
def weather_features(spark, sf):
    return rounded(features.weather_features(views.weather(spark, sf)), 9)


@query("feature_columns", sql(f"SELECT state, date, {rs([c for c in _panel_cols if c not in ('new_cases', 'confirmed', 'deaths')])} FROM f3", "panel", extra=_panel_extra))
def feature_columns(spark, sf):
    """The feature table cut down to its keys and the columns a model may see."""
    built = features.build_all_features(joined_panel(spark, sf), BY_STATE)
    return as_doubles(built.select("state", "date", *features.feature_columns(built)))
