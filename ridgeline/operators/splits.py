"""Time-ordered splits and folds as columns of one lazy frame.

Fold bounds follow from a row's position and its series length, so membership is computed
on the row itself and no bounds table has to be joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.keys import attach
from ridgeline.operators.segments import POS, number_rows, series_length
from ridgeline.panel import NATIONAL, Panel

LENGTH = "_ridgeline_length"


def positioned(df: DataFrame, panel: Panel = NATIONAL) -> DataFrame:
    """Add the 0-based position of each row in its series (POS) and the length of the series (LENGTH)."""
    return series_length(number_rows(df, panel, POS), panel, LENGTH)


def split_by_date(
    df: DataFrame, panel: Panel = NATIONAL, test_size: float = 0.2, val_size: float = 0.1
) -> DataFrame:
    """Add ``role``: the last ``test_size`` of each series is test, the tail of the rest is val."""
    placed = positioned(df, panel)
    test_from = F.floor(F.col(LENGTH) * F.lit(1 - test_size))
    val_from = F.floor(test_from * F.lit(1 - val_size))
    role = F.when(F.col(POS) >= test_from, "test").when(F.col(POS) >= val_from, "val").otherwise("train")
    return placed.withColumn("role", role).drop(POS, LENGTH)


def train_and_val(split: DataFrame) -> DataFrame:
    return split.filter(F.col("role").isin("train", "val"))


def split_report(split: DataFrame, panel: Panel = NATIONAL) -> DataFrame:
    return split.groupBy(*panel.series, "role").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(panel.order).alias("first_date"),
        F.max(panel.order).alias("last_date"),
    )


def _explode_folds(df: DataFrame, n_splits: int, role_of) -> DataFrame:
    """One copy of a row for every fold it belongs to."""
    member = F.transform(
        F.sequence(F.lit(0), F.lit(n_splits - 1)),
        lambda i: F.struct(i.alias("fold"), role_of(i).alias("role")),
    )
    member = F.filter(member, lambda m: m["role"].isNotNull())
    return df.select("*", F.inline(member))


def expanding_folds(df: DataFrame, panel: Panel = NATIONAL, n_splits: int = 5, gap: int = 0) -> DataFrame:
    """Fold i trains on everything before block i+1 and tests on the next block after the gap."""
    placed = positioned(df, panel).withColumn("_size", F.floor(F.col(LENGTH) / F.lit(n_splits + 1)))

    def role_of(i: Column) -> Column:
        train_end = (i + 1) * F.col("_size")
        start = train_end + gap
        test = (F.col(POS) >= start) & (F.col(POS) < start + F.col("_size"))
        return F.when(start >= F.col(LENGTH), None).when(F.col(POS) < train_end, "train").when(test, "test")

    return _explode_folds(placed, n_splits, role_of).drop("_size", POS, LENGTH)


def sliding_folds(
    df: DataFrame, window_size: int, panel: Panel = NATIONAL, n_splits: int = 5, gap: int = 0
) -> DataFrame:
    """Fold i trains on a fixed window that advances by one step and tests on the next step."""
    placed = positioned(df, panel).withColumn(
        "_step", F.floor((F.col(LENGTH) - F.lit(window_size)) / F.lit(n_splits))
    )

    def role_of(i: Column) -> Column:
        train_start = i * F.col("_step")
        train_end = train_start + window_size
        start = train_end + gap
        train = (F.col(POS) >= train_start) & (F.col(POS) < train_end)
        test = (F.col(POS) >= start) & (F.col(POS) < start + F.col("_step"))
        return F.when(start >= F.col(LENGTH), None).when(train, "train").when(test, "test")

    return _explode_folds(placed, n_splits, role_of).drop("_step", POS, LENGTH)


def calendar_folds(
    df: DataFrame, train_days: int, test_days: int, panel: Panel = NATIONAL, n_splits: int = 5, gap: int = 0
) -> DataFrame:
    """Folds cut by calendar days; a fold without test rows is dropped, as is one past the end."""
    span = df.groupBy(*panel.series).agg(
        F.struct(F.min(panel.order).alias("first"), F.max(panel.order).alias("last")).alias("_span")
    )
    if panel.series:
        placed = attach(df, span, panel.series)
    else:
        placed = df.withColumn("_span", span.scalar())
    day = F.col(panel.order)

    def role_of(i: Column) -> Column:
        start = F.date_add(F.col("_span")["first"], (i + 1) * (train_days + gap))
        train_end, test_end = F.date_add(start, -gap), F.date_add(start, test_days)
        return (
            F.when(test_end > F.col("_span")["last"], None)
            .when(day < train_end, "train")
            .when((day >= start) & (day < test_end), "test")
        )

    tests = F.filter(F.sequence(F.lit(0), F.lit(n_splits - 1)), lambda i: role_of(i) == "test")
    # At most n_splits numbers per series: which folds have a test row.  They join like the span, before rows are copied to folds.
    tested = placed.groupBy(*panel.series).agg(F.array_distinct(F.flatten(F.collect_set(tests))).alias("_tested"))
    known = attach(placed, tested, panel.series) if panel.series else placed.withColumn("_tested", tested.scalar())
    return _explode_folds(known, n_splits, lambda i: F.when(F.array_contains("_tested", i), role_of(i))).drop("_span", "_tested")


def _origins(df: DataFrame, panel: Panel, initial: int, period: int, horizon: int) -> DataFrame:
    """(series, _last, _steps): cutoffs lie horizon + k * period days before the last date, for k = 0 ... _steps."""
    span = df.groupBy(*panel.series).agg(F.min(panel.order).alias("_first"), F.max(panel.order).alias("_last"))
    steps = F.floor((F.datediff("_last", "_first") - initial - horizon) / F.lit(period)).cast("int")
    return span.select(*panel.series, "_last", steps.alias("_steps")).filter("_steps >= 0")


def rolling_origin_cutoffs(
    df: DataFrame, panel: Panel, initial: int = 180, period: int = 30, horizon: int = 30
) -> DataFrame:
    """(series, cutoff): every ``period`` days back from the last date minus the horizon, while
    at least ``initial`` days of history remain."""
    placed = _origins(df, panel, initial, period, horizon).withColumn("_k", F.explode(F.sequence(F.lit(0), "_steps")))
    return placed.select(*panel.series, F.date_add("_last", -(F.lit(horizon) + F.col("_k") * period)).alias("cutoff"))


def rolling_origin_tests(
    df: DataFrame, panel: Panel, initial: int = 180, period: int = 30, horizon: int = 30
) -> DataFrame:
    """The rows of the ``horizon`` days after each cutoff, with their ``cutoff``; a row meets the few cutoffs that it
    follows this closely, whatever the number of cutoffs."""
    origins = _origins(df, panel, initial, period, horizon)
    if panel.series:
        placed = attach(df, origins, panel.series)
    else:
        placed = df.withColumn("_o", origins.select(F.struct("_last", "_steps")).scalar()).select("*", "_o.*").drop("_o")
    back = F.datediff("_last", F.col(panel.order))
    low = F.greatest(F.ceil((back - horizon + 1) / F.lit(period)), F.lit(0)).cast("int")
    high = F.least(F.floor(back / F.lit(period)), F.col("_steps")).cast("int")
    met = placed.withColumn("_k", F.explode(F.when(low <= high, F.sequence(low, high))))
    cutoff = F.date_add("_last", -(F.lit(horizon) + F.col("_k") * period))
    return met.withColumn("cutoff", cutoff).drop("_last", "_steps", "_k")
