"""Baseline forecasts and the long prediction frame (series, date, model, y_true, y_pred)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.keys import attach
from ridgeline.operators.clean import fill
from ridgeline.operators.segments import over_rows
from ridgeline.panel import NATIONAL, Panel, trailing

BASELINES = ("naive", "seasonal", "ma7")


def shifted(df: DataFrame, panel: Panel, target: str, rows: int, name: str) -> DataFrame:
    """The value ``rows`` earlier, the leading gap filled from the first known value after it."""
    lagged = over_rows(df, panel, lambda w: {name: F.lag(target, rows).over(w).cast("double")}, back=rows)
    return fill(lagged, panel, [name], how="bfill")


def naive(df: DataFrame, panel: Panel = NATIONAL, target: str = "new_cases", name: str = "naive") -> DataFrame:
    return shifted(df, panel, target, 1, name)


def seasonal(df: DataFrame, panel: Panel = NATIONAL, target: str = "new_cases", name: str = "seasonal") -> DataFrame:
    return shifted(df, panel, target, 7, name)


def moving_average(
    df: DataFrame,
    panel: Panel = NATIONAL,
    target: str = "new_cases",
    name: str = "ma7",
    rows: int = 7,
    closed: str = "right",
) -> DataFrame:
    """Mean of the last ``rows`` rows, today included unless ``closed='left'``."""
    return over_rows(df, panel, lambda w: {name: F.avg(target).over(trailing(w, rows, closed))}, back=rows)


def moving_average_lagged(
    df: DataFrame,
    panel: Panel = NATIONAL,
    target: str = "new_cases",
    name: str = "ma7_lagged",
    rows: int = 7,
    missing: str = "mean",
) -> DataFrame:
    """Mean of the ``rows`` rows before today, which must all exist; the rest takes the
    series mean (``missing='mean'``) or the last known value (``'ffill'``)."""

    def build(w):
        frame = trailing(w, rows, "left")
        return {name: F.when(F.count(target).over(frame) == rows, F.avg(target).over(frame))}

    out = over_rows(df, panel, build, back=rows)
    if missing == "ffill":
        return fill(out, panel, [name], how="ffill")
    if not panel.series:
        return out.withColumn(name, F.coalesce(F.col(name), df.agg(F.avg(target).alias("m")).scalar()))
    means = df.groupBy(*panel.series).agg(F.avg(target).alias("_mean"))
    return attach(out, means, panel.series).withColumn(name, F.coalesce(name, "_mean")).drop("_mean")


def baselines(df: DataFrame, panel: Panel = NATIONAL, target: str = "new_cases") -> DataFrame:
    """The three baselines in long form."""
    wide = moving_average(seasonal(naive(df, panel, target), panel, target), panel, target)
    return to_long(wide, list(BASELINES), target, panel)


def to_long(df: DataFrame, models: list[str], target: str, panel: Panel = NATIONAL) -> DataFrame:
    """Melt prediction columns; a missing value counts as zero, as in the reports."""
    zero = F.lit(0.0)
    values = {c: F.coalesce(F.col(c).cast("double"), zero).alias(c) for c in models}
    wide = df.select(*panel.keys, F.coalesce(F.col(target).cast("double"), zero).alias("y_true"), *values.values())
    return wide.unpivot([*panel.keys, "y_true"], models, "model", "y_pred")
