"""Joins of the four sources and their daily aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgeline.operators import clean, merge
from ridgeline.operators.clean import MOBILITY
from ridgeline.panel import BY_STATE, NATIONAL
from ridgeline.plans import views
from ridgeline.plans.catalog import query, rounded
from ridgeline.plans.oracle import MOB, WX, fill_sql, r, rs, sql

NUM = ["new_cases", "new_deaths", "confirmed", "deaths"]


def raw_mobility(spark, sf):
    """One row per line item with its supplier and the one measure it belongs to."""
    measures = [
        F.when((F.col("l_returnflag") == f) & (F.col("l_linestatus") == s), F.col("l_quantity")).alias(n)
        for n, (f, s) in zip(MOBILITY, views.MOBILITY_FLAGS)
    ]
    return views.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), views.day("l_shipdate").alias("date"), *measures)


def supplier_states(spark, sf):
    supplier = views.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    return supplier.join(views.nations(spark, sf, "s_nationkey"), "s_nationkey").select("s_suppkey", "state")


def mobility_by_state(spark, sf):
    return clean.daily_by_state(raw_mobility(spark, sf), lookup=supplier_states(spark, sf), key="s_suppkey")


@query("daily_by_state", sql(f"SELECT state, date, {rs(MOB)} FROM mobility", "mobility"))
def daily_by_state(spark, sf):
    return rounded(mobility_by_state(spark, sf))


@query("national_mean_of_means", sql(f"SELECT date, {rs(MOB)} FROM mob_nat", "mob_nat"))
def national_mean_of_means(spark, sf):
    return rounded(clean.daily_mean(mobility_by_state(spark, sf)))


def national_row_mean_raw(spark, sf):
    return clean.daily_mean(raw_mobility(spark, sf))


@query("national_row_mean", sql(f"SELECT date, {rs(MOB)} FROM mob_row", "mob_row"))
def national_row_mean(spark, sf):
    return rounded(national_row_mean_raw(spark, sf))


@query("population_share", sql(f"SELECT state, population_millions, population_millions * 0.5::DOUBLE AS population_density_estimate, {r('pop_proportion', digits=9)} FROM share", "share"))
def population_share(spark, sf):
    return rounded(merge.population_share(views.demographics(spark, sf)), 9)


_left = {"m": "SELECT * FROM cases LEFT JOIN mob_nat USING (date) LEFT JOIN wx_nat USING (date)"}


@query(
    "merge_national",
    sql(f"SELECT date, {', '.join(NUM)}, {rs(MOB + WX, 9)} FROM f", "cases", "mob_nat", "wx_nat", extra=_left | {"f": fill_sql("m", ["date"], NUM + MOB + WX)}),
)
def merge_national(spark, sf):
    return rounded(merge.merge_national(views.cases(spark, sf), views.mobility(spark, sf), views.weather(spark, sf)), 9)


@query(
    "merge_outer",
    sql(f"SELECT date, {', '.join(NUM)}, {rs(MOB)} FROM f", "cases", "mob_row",
        extra={"m": "SELECT * FROM cases FULL JOIN mob_row USING (date)", "f": fill_sql("m", ["date"], NUM + MOB)}),
)
def merge_outer(spark, sf):
    return rounded(merge.merge_outer(views.cases(spark, sf), national_row_mean_raw(spark, sf)))


@query("merge_inner", sql(f"SELECT date, {', '.join(NUM)}, {rs(MOB)} FROM inner_merged", "inner_merged"))
def merge_inner(spark, sf):
    return rounded(merge.merge_on_date(views.cases(spark, sf), clean.daily_mean(views.mobility(spark, sf))))


_scaled = ", ".join(f"round_even({c} * pop_proportion, 0)::DOUBLE AS {c}" for c in ("new_cases", "confirmed", "deaths"))
_alloc = f"SELECT state, date, new_deaths, {_scaled}, population_millions, population_millions AS estimated_population FROM cases, share"


@query("allocate_by_population", sql(_alloc, "cases", "share"))
def allocate_by_population(spark, sf):
    return merge.allocate_by_population(views.cases(spark, sf), views.demographics(spark, sf))


@query("merge_panel", sql(f"SELECT state, date, {', '.join(NUM)}, {rs(MOB + WX, 9)} FROM f", "panel", extra={"f": fill_sql("panel", ["state", "date"], NUM + MOB + WX, "state")}))
def merge_panel(spark, sf):
    return rounded(merge.merge_panel(views.cases_by_state(spark, sf), views.mobility(spark, sf), views.weather(spark, sf)), 9)


@query(
    "merge_fill_panel",
    sql(f"SELECT state, date, {rs(MOB + WX, 9)} FROM f", "mobility", "weather",
        extra={"m": "SELECT * FROM mobility JOIN weather USING (state, date)", "f": fill_sql("m", ["state", "date"], MOB + WX, "state")}),
)
def merge_fill_panel(spark, sf):
    return rounded(merge.fill_numeric(views.mobility(spark, sf).join(views.weather(spark, sf), ["state", "date"]), BY_STATE), 9)


_master_cols = ["new_cases", "new_deaths", "confirmed", "deaths", "population_millions", "estimated_population"]


@query(
    "master_dataset",
    sql(f"SELECT state, date, {', '.join(_master_cols)}, {rs(MOB + WX, 9)} FROM f", "cases", "share", "mobility", "weather",
        extra={"a": _alloc, "m": "SELECT * FROM a LEFT JOIN mobility USING (state, date) LEFT JOIN weather USING (state, date)",
               "f": fill_sql("m", ["state", "date"], _master_cols + MOB + WX, "state")}),
)
def master_dataset(spark, sf):
    datasets = {
        "cases": views.cases(spark, sf),
        "mobility": views.mobility(spark, sf),
        "weather": views.weather(spark, sf),
        "demographics": views.demographics(spark, sf),
    }
    return rounded(merge.master_dataset(datasets, "state"), 9)




def _holiday(month: int, day: int, name: str) -> str:
    hs = f"make_date(year(date), {month}, {day})"
    return f"CASE WHEN date BETWEEN {hs} - 1 AND {hs} + 1 THEN 1 ELSE 0 END::INTEGER AS {name}"


# The festival's days in the years of the orders.
FESTIVALS = ("1995-10-23", "1996-11-10", "1997-10-30", "1998-10-19", "1999-11-07", "2000-10-26", "2001-11-14")
_festival = "CASE WHEN " + " OR ".join(f"date BETWEEN DATE '{d}' - 1 AND DATE '{d}' + 1" for d in FESTIVALS) + " THEN 1 ELSE 0 END::INTEGER AS holiday_diwali"


@query(
    "holiday_features",
    sql(f"SELECT date, new_cases, {_holiday(1, 26, 'holiday_republic_day')}, {_holiday(8, 15, 'holiday_independence_day')}, {_holiday(10, 2, 'holiday_gandhi_jayanti')}, {_festival} FROM daily", "daily"),
)
def holiday_features(spark, sf):
    daily = views.daily_cases(spark, sf).drop("new_deaths")
    return merge.holiday_features(daily, merge.calendar_for(daily, festivals=FESTIVALS), merge.HOLIDAY_NAMES)


@query(
    "merge_fill_national",
    sql(f"SELECT date, {rs(MOB + WX, 9)} FROM f", "mob_nat", "wx_nat",
        extra={"m": "SELECT * FROM wx_nat LEFT JOIN mob_nat USING (date)", "f": fill_sql("m", ["date"], MOB + WX)}),
)
def merge_fill_national(spark, sf):
    sources = merge.merge_on_date(
        clean.daily_mean(views.weather(spark, sf), clean.WEATHER), clean.daily_mean(views.mobility(spark, sf)), "left"
    )
    return rounded(merge.fill_numeric(sources, NATIONAL), 9)


@query("distinct_series", "SELECT DISTINCT n_name AS state FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def distinct_series(spark, sf):
    return views.daily_cases_by_state(spark, sf).select("state").distinct()
