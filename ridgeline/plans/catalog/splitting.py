"""Splits and folds."""

from __future__ import annotations

from ridgeline.operators import splits
from ridgeline.panel import BY_STATE, NATIONAL
from ridgeline.plans import views
from ridgeline.plans.catalog import query
from ridgeline.plans.oracle import sql

_placed = {
    "placed": "SELECT state, date, new_cases, row_number() OVER (PARTITION BY state ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY state) AS n FROM state_daily",
    "f": "SELECT unnest(range(5))::INTEGER AS fold",
}
_expanding = "SELECT state, date, new_cases, fold, CASE WHEN pos < (fold + 1) * (n // 6) THEN 'train' ELSE 'test' END AS role FROM placed, f WHERE (fold + 1) * (n // 6) + {gap} < n AND (pos < (fold + 1) * (n // 6) OR (pos >= (fold + 1) * (n // 6) + {gap} AND pos < (fold + 1) * (n // 6) + {gap} + (n // 6)))"
_sliding = (
    "SELECT state, date, new_cases, fold, CASE WHEN pos < lo + 100 THEN 'train' ELSE 'test' END AS role FROM "
    "(SELECT *, fold * ((n - 100) // 5) AS lo, (n - 100) // 5 AS step FROM placed, f) "
    "WHERE lo + 100 + 3 < n AND ((pos >= lo AND pos < lo + 100) OR (pos >= lo + 103 AND pos < lo + 103 + step))"
)
_calendar = {
    "b": "SELECT state, fold, mn + (fold + 1) * 202 AS start, mx FROM (SELECT state, min(date) AS mn, max(date) AS mx FROM state_daily GROUP BY 1), f",
    "m": "SELECT d.state, d.date, d.new_cases, b.fold, CASE WHEN d.date < b.start - 2 THEN 'train' ELSE 'test' END AS role FROM state_daily d JOIN b USING (state) WHERE b.start + 60 <= b.mx AND (d.date < b.start - 2 OR (d.date >= b.start AND d.date < b.start + 60))",
}


def state_cases(spark, sf):
    return views.daily_cases_by_state(spark, sf).drop("new_deaths")


@query("split_by_date", sql("SELECT state, date, new_cases, role FROM state_split", "state_split"))
def split_by_date(spark, sf):
    return splits.split_by_date(state_cases(spark, sf), BY_STATE)


@query("split_report", sql("SELECT role, count(*) AS rows, min(date) AS first_date, max(date) AS last_date FROM split GROUP BY 1", "split"))
def split_report(spark, sf):
    return splits.split_report(splits.split_by_date(views.daily_cases(spark, sf), NATIONAL, 0.15, 0.1))


@query("union_train_val", sql("SELECT state, date, new_cases, role FROM state_split WHERE role <> 'test'", "state_split"))
def union_train_val(spark, sf):
    return splits.train_and_val(splits.split_by_date(state_cases(spark, sf), BY_STATE))


@query("expanding_folds", sql(_expanding.format(gap=2), "state_daily", extra=_placed))
def expanding_folds(spark, sf):
    return splits.expanding_folds(state_cases(spark, sf), BY_STATE, 5, 2)


@query("sliding_folds", sql(_sliding, "state_daily", extra=_placed))
def sliding_folds(spark, sf):
    return splits.sliding_folds(state_cases(spark, sf), 100, BY_STATE, 5, 3)


@query("calendar_folds", sql("SELECT state, date, new_cases, fold, role FROM m WHERE (state, fold) IN (SELECT (state, fold) FROM m WHERE role = 'test')", "state_daily", extra={"f": _placed["f"]} | _calendar))
def calendar_folds(spark, sf):
    return splits.calendar_folds(state_cases(spark, sf), 200, 60, BY_STATE, 5, 2)


@query(
    "rolling_origin_cutoffs",
    sql("SELECT state, (mx - 30 - 30 * k::INTEGER)::DATE AS cutoff FROM (SELECT state, mn, mx, unnest(range(0, greatest(floor((mx - mn - 210) / 30)::BIGINT + 1, 0))) AS k FROM (SELECT state, min(date) AS mn, max(date) AS mx FROM state_daily GROUP BY 1))", "state_daily"),
)
def rolling_origin_cutoffs(spark, sf):
    return splits.rolling_origin_cutoffs(state_cases(spark, sf), BY_STATE, 180, 30, 30)
