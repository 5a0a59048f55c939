"""Imputation, clipping and the three cleaners."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgeline.operators import clean
from ridgeline.operators.segments import running_sum
from ridgeline.operators.merge import union_states
from ridgeline.panel import BY_STATE, NATIONAL, Panel
from ridgeline.plans import views
from ridgeline.plans.catalog import query, rounded
from ridgeline.plans.oracle import LINE_ORDER, MOB, WX, clip_sql, fill_sql, interp_sql, last_k, pct_sql, r, rs, sql

# Raw lines of one supplier are a series of any length: it is cut into segments.
LINES = Panel("date", ("l_suppkey",), ("l_orderkey", "l_linenumber", "l_partkey"), segment_rows=50_000)
LINE_KEYS = ["l_suppkey", "date", "l_orderkey", "l_linenumber", "l_partkey"]


def lines(spark, sf):
    """Raw line items in supplier order, with a gappy copy of the quantity."""
    return views.table(spark, sf, "lineitem").select(
        "l_suppkey", views.day("l_shipdate").alias("date"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
        "l_extendedprice", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity")).alias("gappy"),
    )


def raw_cases(spark, sf):
    """National cases with corrections (negatives) and gaps."""
    status = F.col("o_orderstatus")
    day = views.table(spark, sf, "orders").groupBy(views.day("o_orderdate").alias("date")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(status == "P").alias("p"), F.count_if(status == "F").alias("f")
    )
    named = day.select(
        "date",
        F.when(F.col("total") % 5 != 0, F.col("total") - 3 * F.col("p")).alias("new_cases"),
        F.when(F.col("total") % 4 != 0, F.col("f") - F.col("p")).alias("new_deaths"),
        "total",
        "f",
    )
    return running_sum(named, NATIONAL, {"confirmed": "total", "deaths": "f"}).drop("total", "f")


def raw_weather(spark, sf):
    """Weather by state with NULLs where a per-day checksum is divisible by 5, 4 and 3."""
    k = views._shipments(spark, sf, ["l_linenumber"], {"k": F.col("l_linenumber").cast("long")})
    both = views.weather(spark, sf).join(k, ["state", "date"])
    return both.select(
        "state", "date", *[F.when(F.col("k") % d != 0, F.col(c)).alias(c) for c, d in zip(WX, (5, 4, 3))]
    )


@query("interpolate_linear", sql(f"SELECT state, date, {rs(MOB)} FROM i", "mobility", extra={"i": interp_sql("mobility", ["state", "date"], MOB, "state")}))
def interpolate_linear(spark, sf):
    return rounded(clean.interpolate_linear(views.mobility(spark, sf), BY_STATE))


@query(
    "interpolate_linear_rows",
    sql(f"SELECT {', '.join(LINE_KEYS)}, {r('gappy')} FROM i", "lines", extra={"i": interp_sql("lines", LINE_KEYS, ["gappy"], "l_suppkey", LINE_ORDER)}),
)
def interpolate_linear_rows(spark, sf):
    return rounded(clean.interpolate_linear(lines(spark, sf).select(*LINE_KEYS, "gappy"), LINES, ["gappy"]))


_labelled = {"m": "SELECT *, CASE WHEN retail_recreation > 25 THEN 'high' WHEN retail_recreation < 10 THEN 'low' END AS level FROM mobility"}


@query("ffill_bfill", sql(f"SELECT state, date, {rs(MOB)}, level FROM f", "mobility", extra=_labelled | {"f": fill_sql("m", ["state", "date"], [*MOB, "level"], "state")}))
def ffill_bfill(spark, sf):
    level = F.when(F.col("retail_recreation") > 25, "high").when(F.col("retail_recreation") < 10, "low")
    return rounded(clean.fill(views.mobility(spark, sf).withColumn("level", level), BY_STATE))


@query("ffill_rows", sql(fill_sql("lines", LINE_KEYS, ["gappy"], "l_suppkey", LINE_ORDER, "ffill"), "lines"))
def ffill_rows(spark, sf):
    return clean.fill(lines(spark, sf).select(*LINE_KEYS, "gappy"), LINES, ["gappy"], how="ffill")


@query("backward_fill", sql(f"SELECT state, date, {rs(MOB)} FROM f", "mobility", extra={"f": fill_sql("mobility", ["state", "date"], MOB, "state", how="bfill")}))
def backward_fill(spark, sf):
    return rounded(clean.fill_missing(views.mobility(spark, sf), "backward_fill", BY_STATE))


@query("mean_fill", sql("SELECT state, date, " + ", ".join(r(f"coalesce({c}, (SELECT avg({c}) FROM mobility))", c) for c in MOB) + " FROM mobility", "mobility"))
def mean_fill(spark, sf):
    return rounded(clean.mean_fill(views.mobility(spark, sf)))


def _iqr(c: str, t: float) -> str:
    return clip_sql(f"{c}::DOUBLE", f"(q[1] - {t} * (q[2] - q[1]))", f"(q[2] + {t} * (q[2] - q[1]))")


@query(
    "clip_iqr",
    sql(
        f"SELECT state, date, {r(_iqr('new_cases', 1.5), 'new_cases')} FROM state_daily JOIN "
        "(SELECT state, quantile_cont(new_cases::DOUBLE, [0.25, 0.75]) AS q FROM state_daily GROUP BY 1) USING (state)",
        "state_daily",
    ),
)
def clip_iqr(spark, sf):
    return rounded(clean.clip_iqr(views.daily_cases_by_state(spark, sf).drop("new_deaths"), ["new_cases"], 1.5, BY_STATE))


@query(
    "clip_iqr_rows",
    sql(
        f"SELECT {', '.join(LINE_KEYS)}, {r(_iqr('l_extendedprice', 0.25), 'l_extendedprice', 4)} FROM lines, "
        "(SELECT quantile_cont(l_extendedprice, [0.25, 0.75]) AS q FROM lines)",
        "lines",
    ),
)
def clip_iqr_rows(spark, sf):
    whole = Panel("date", segment_rows=50_000)
    out = clean.clip_iqr(lines(spark, sf).select(*LINE_KEYS, "l_extendedprice"), ["l_extendedprice"], 0.25, whole)
    return rounded(out, 4)


@query(
    "clip_zscore",
    sql(
        f"SELECT state, date, {r(clip_sql('new_cases::DOUBLE', '(mu - 1.5 * sd)', '(mu + 1.5 * sd)'), 'new_cases')} FROM state_daily JOIN "
        "(SELECT state, avg(new_cases) AS mu, stddev_samp(new_cases) AS sd FROM state_daily GROUP BY 1) USING (state)",
        "state_daily",
    ),
)
def clip_zscore(spark, sf):
    out = clean.clip_outliers(views.daily_cases_by_state(spark, sf).drop("new_deaths"), ["new_cases"], "zscore", 1.5, BY_STATE)
    return rounded(out)


_nonneg = ", ".join(f"CASE WHEN {c} < 0 THEN 0 ELSE {c} END AS {c}" for c in ("new_cases", "new_deaths", "confirmed", "deaths"))


@query("clip_nonneg", sql(f"SELECT date, {_nonneg} FROM raw_cases", "raw_cases"))
def clip_nonneg(spark, sf):
    return clean.clip_nonneg(raw_cases(spark, sf))


@query(
    "fill_national",
    "SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END, 'National') AS state FROM orders",
)
def fill_national(spark, sf):
    state = F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("state")
    return clean.fill_national(views.table(spark, sf, "orders").select("o_orderkey", state))


@query("impute_median", sql("SELECT state, date, " + ", ".join(r(f"coalesce({c}, (SELECT median({c}) FROM mobility))", c) for c in MOB) + " FROM mobility", "mobility"))
def impute_median(spark, sf):
    return rounded(clean.impute_median(views.mobility(spark, sf), BY_STATE))


_clean_cases = {
    "nn": f"SELECT date, {_nonneg} FROM raw_cases",
    "ip": interp_sql("nn", ["date"], ["new_cases", "new_deaths", "confirmed", "deaths"]),
    "cc": f"SELECT date, {_iqr('new_cases', 3.0)} AS new_cases, new_deaths, confirmed, deaths FROM ip, (SELECT quantile_cont(new_cases, [0.25, 0.75]) AS q FROM ip)",
}


@query("clean_covid", sql(f"SELECT date, {rs(['new_cases', 'new_deaths', 'confirmed', 'deaths'])} FROM cc", "raw_cases", extra=_clean_cases))
def clean_covid(spark, sf):
    return rounded(clean.clean_cases(raw_cases(spark, sf)))


@query("clean_mobility", sql(f"SELECT state, date, {rs(MOB)} FROM i", "mobility", extra={"i": interp_sql("mobility", ["state", "date"], MOB, "state")}))
def clean_mobility(spark, sf):
    return rounded(clean.clean_mobility(views.mobility(spark, sf), BY_STATE))


@query("clean_weather", sql(f"SELECT state, date, {rs(WX, 9)} FROM i", "raw_weather", extra={"i": interp_sql("raw_weather", ["state", "date"], WX, "state")}))
def clean_weather(spark, sf):
    return rounded(clean.clean_weather(raw_weather(spark, sf), BY_STATE), 9)


_growth = f"coalesce({pct_sql('confirmed', 'before')}, 0) * 100"
_derived = (
    f"SELECT date, new_cases, new_deaths, confirmed, deaths, {r(f'avg(new_cases) OVER (ORDER BY date {last_k(7)})', 'new_cases_7day_avg')}, "
    f"{r(clip_sql(_growth, '-100', '500'), 'growth_rate')}, {r('deaths / greatest(confirmed, 1) * 100', 'case_fatality_rate')} "
    "FROM (SELECT *, lag(confirmed) OVER (ORDER BY date) AS before FROM {src})"
)


@query("covid_derived", sql(_derived.format(src="cases"), "cases"))
def covid_derived(spark, sf):
    return rounded(clean.cases_derived(views.cases(spark, sf)))


_CASE_COLS = ["new_cases", "new_deaths", "confirmed", "deaths", "new_cases_7day_avg", "growth_rate", "case_fatality_rate"]


@query(
    "clean_all",
    sql(f"SELECT 'cases' AS source, date, {rs(_CASE_COLS)} FROM d UNION ALL BY NAME SELECT 'mobility' AS source, state, date, {rs(MOB)} FROM mi UNION ALL BY NAME SELECT 'weather' AS source, state, date, {rs(WX)} FROM wi",
        "raw_cases", "mobility", "raw_weather",
        extra=_clean_cases | {
            "d": _derived.format(src="cc"),
            "mi": interp_sql("mobility", ["state", "date"], MOB, "state"),
            "wi": interp_sql("raw_weather", ["state", "date"], WX, "state"),
        }),
)
def clean_all(spark, sf):
    """Every row of the three cleaned sources, stacked by column name."""
    sources = {"cases": raw_cases(spark, sf), "mobility": views.mobility(spark, sf), "weather": raw_weather(spark, sf)}
    cleaned = clean.clean_all(sources, {"mobility": BY_STATE, "weather": BY_STATE})
    keep = {"cases": ["date", *_CASE_COLS], "mobility": ["state", "date", *MOB], "weather": ["state", "date", *WX]}
    return rounded(union_states([cleaned[s].select(F.lit(s).alias("source"), *cols) for s, cols in keep.items()]))


@query("dropna", sql(f"SELECT state, date, {rs(MOB)} FROM mobility WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in MOB), "mobility"))
def dropna(spark, sf):
    return rounded(clean.drop_nulls(views.mobility(spark, sf)))


@query(
    "constant_fill",
    sql("SELECT state, date, " + ", ".join(r(f"coalesce({c}, 0)", c) for c in MOB) + " FROM mobility", "mobility"),
)
def constant_fill(spark, sf):
    return rounded(clean.constant_fill(views.mobility(spark, sf), MOB))
