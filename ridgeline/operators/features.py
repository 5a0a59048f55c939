"""Feature engineering over one series or a panel of them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.calendar import temporal_columns
from ridgeline.functions.numeric import clip, existing, flag, min_max_scaled, not_nan, numeric_columns, pct_change
from ridgeline.operators.clean import MOBILITY, drop_nulls, fill, impute_median
from ridgeline.operators.segments import over_rows, running_sum
from ridgeline.panel import NATIONAL, Panel, trailing

LAGS = (1, 3, 7, 14)
WINDOWS = (3, 7, 14)

# Signed weights of the composite mobility index.
INDEX_WEIGHTS = {"retail_recreation": -0.25, "transit": -0.25, "workplaces": -0.25, "residential": 0.25}
# Right-closed temperature bins (low, high] and their labels.
TEMPERATURE_BINS = ((-50, 15, "cold"), (15, 25, "mild"), (25, 35, "warm"), (35, 50, "hot"))
HUMID_ABOVE = 70
# Columns that are never features.
NOT_FEATURES = ("date", "state", "country", "confirmed", "deaths", "temp_category", "estimated_population")


def temporal_features(df: DataFrame, date_col: str = "date") -> DataFrame:
    return df.withColumns(temporal_columns(F.col(date_col)))


def lag_features(df: DataFrame, panel: Panel = NATIONAL, target: str = "new_cases", lags: Iterable[int] = LAGS) -> DataFrame:
    """``{target}_lag_{k}``: the value k rows (not days) earlier in the same series."""
    lags = tuple(lags)
    return over_rows(
        df, panel, lambda w: {f"{target}_lag_{k}": F.lag(target, k).over(w) for k in lags}, back=max(lags)
    )


def rolling_features(
    df: DataFrame,
    panel: Panel = NATIONAL,
    target: str = "new_cases",
    windows: Iterable[int] = WINDOWS,
    closed: str = "right",
) -> DataFrame:
    """Rolling mean, sample std and max; ``closed='left'`` leaves the current row out."""
    windows = tuple(windows)

    def build(w) -> dict[str, Column]:
        out = {}
        for k in windows:
            frame = trailing(w, k, closed)
            out[f"{target}_rolling_mean_{k}"] = F.avg(target).over(frame)
            out[f"{target}_rolling_std_{k}"] = F.stddev_samp(target).over(frame)
            out[f"{target}_rolling_max_{k}"] = F.max(target).over(frame)
        return out

    return over_rows(df, panel, build, back=max(windows))


def growth_features(df: DataFrame, panel: Panel = NATIONAL, target: str = "new_cases") -> DataFrame:
    """Percent growth in [-100, 500], its change in [-100, 100], and the running total.

    Gaps are carried forward before the ratio is taken.
    """
    known = "_known"
    carried = fill(df.withColumn(known, F.col(target).cast("double")), panel, [known], how="ffill")

    def build(w) -> dict[str, Column]:
        cur, one, two = F.col(known), F.lag(known, 1).over(w), F.lag(known, 2).over(w)
        now, before = not_nan(pct_change(cur, one)), not_nan(pct_change(one, two))
        return {
            f"{target}_growth_rate": clip(now * 100, -100.0, 500.0),
            f"{target}_acceleration": clip(not_nan((now - before) * 100), -100.0, 100.0),
        }

    grown = over_rows(carried, panel, build, back=2).drop(known)
    return running_sum(grown, panel, {f"{target}_cumulative": target})


def mobility_index(df: DataFrame) -> DataFrame:
    if len(existing(df, MOBILITY)) < 3:
        return df
    terms = [F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in INDEX_WEIGHTS.items() if c in df.columns]
    return df.withColumn("mobility_index", sum(terms, F.lit(0.0)))


def mobility_lags(df: DataFrame, panel: Panel = NATIONAL, lags: Iterable[int] = (7, 14)) -> DataFrame:
    cols, lags = existing(df, MOBILITY), tuple(lags)
    if not cols:
        return df
    return over_rows(
        df, panel, lambda w: {f"{c}_lag_{k}": F.lag(c, k).over(w) for c in cols for k in lags}, back=max(lags)
    )


def mobility_features(df: DataFrame, panel: Panel = NATIONAL) -> DataFrame:
    return mobility_lags(mobility_index(df), panel)


def temperature_bin(value: Column) -> tuple[Column, Column]:
    """(label, code) of a right-closed temperature bin; NULL and -1 outside every bin."""
    label, code = None, None
    for i, (low, high, name) in enumerate(TEMPERATURE_BINS):
        inside = (value > low) & (value <= high)
        label = F.when(inside, name) if label is None else label.when(inside, name)
        code = F.when(inside, i) if code is None else code.when(inside, i)
    return label, code.otherwise(-1)


def weather_features(df: DataFrame) -> DataFrame:
    new: dict[str, Column] = {}
    if "temperature_mean" in df.columns:
        new["temp_category"], new["temp_category_encoded"] = temperature_bin(F.col("temperature_mean"))
    if "humidity_mean" in df.columns:
        new["humidity_high"] = flag(F.col("humidity_mean") > HUMID_ABOVE)
    if "precipitation" in df.columns:
        new["has_precipitation"] = flag(F.col("precipitation") > 0)
    return df.withColumns(new) if new else df


def interactions(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    new: dict[str, Column] = {}
    if {"mobility_index", "population_millions"} <= have:
        new["mobility_pop_interaction"] = F.col("mobility_index") * F.log1p("population_millions")
    if {"temperature_mean", "day_of_week"} <= have:
        new["temp_weekday"] = F.col("temperature_mean") * (F.col("day_of_week") < 5).cast("int")
    if {"new_cases_lag_7", "workplaces_lag_7"} <= have:
        new["cases_mobility_interaction"] = F.col("new_cases_lag_7") * F.col("workplaces_lag_7") / 100
    return df.withColumns(new) if new else df


def build_all_features(
    df: DataFrame,
    panel: Panel = NATIONAL,
    target: str = "new_cases",
    lags: Iterable[int] = LAGS,
    windows: Iterable[int] = WINDOWS,
    closed: str = "right",
    fit_on: Column | None = None,
) -> DataFrame:
    """Every feature group, then infinities and NULLs replaced by column medians."""
    out = temporal_features(df, panel.order)
    out = lag_features(out, panel, target, lags)
    out = rolling_features(out, panel, target, windows, closed)
    out = growth_features(out, panel, target)
    out = mobility_features(out, panel)
    out = interactions(weather_features(out))
    return impute_median(out, panel, fit_on=fit_on)


def feature_columns(df: DataFrame, target: str = "new_cases", exclude: Iterable[str] = ()) -> list[str]:
    """Numeric columns that are neither the target, nor metadata, nor excluded."""
    skip = {target, *NOT_FEATURES, *exclude}
    return [c for c in numeric_columns(df) if c not in skip]


def prepare_xy(
    df: DataFrame, panel: Panel = NATIONAL, target: str = "new_cases", drop_na: bool = True
) -> tuple[DataFrame, list[str]]:
    """Features plus ``features`` vector and the target as ``label``; and the feature names."""
    from pyspark.ml.feature import VectorAssembler

    built = build_all_features(df, panel, target)
    names = feature_columns(built, target)
    ready = drop_nulls(built) if drop_na else built
    vector = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep")
    return vector.transform(ready.withColumn("label", F.col(target).cast("double"))), names


def feature_minmax(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, min, max, range) with a zero range replaced by one."""
    stats = df.agg(*[F.struct(F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max")).alias(c) for c in cols])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c)["min"].alias("min"), F.col(c)["max"].alias("max")) for c in cols])
    width = F.col("max") - F.col("min")
    return stats.select(F.inline(rows)).withColumn("range", F.when(width == 0, 1.0).otherwise(width))


def min_max_scale(df: DataFrame, cols: list[str], fit_on: Column | None = None) -> DataFrame:
    """Scale columns to [0, 1] with the bounds of the rows selected by ``fit_on``."""
    base = df if fit_on is None else df.filter(fit_on)
    bounds = base.agg(
        F.struct(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in cols]).alias("b")
    ).scalar()
    scaled = {c: min_max_scaled(F.col(c).cast("double"), F.col("_b")[c]["lo"], F.col("_b")[c]["hi"]) for c in cols}
    return df.withColumn("_b", bounds).withColumns(scaled).drop("_b")


def sequences(df: DataFrame, cols: list[str], target: str, panel: Panel = NATIONAL, length: int = 14) -> DataFrame:
    """Sliding blocks of ``length`` rows ending at each row, with that row's target."""
    block = F.array(*[F.col(c).cast("double") for c in cols])

    def build(w) -> dict[str, Column]:
        return {"sequence": F.collect_list(block).over(trailing(w, length)), "sequence_target": F.col(target)}

    out = over_rows(df, panel, build, back=length - 1)
    return out.filter(F.size("sequence") == length).select(*panel.keys, "sequence", "sequence_target")


def smoothed_growth(df: DataFrame, panel: Panel = NATIONAL, col: str = "growth_rate") -> DataFrame:
    """Growth clipped to [-20, 50] and its 7-row mean clipped to [-10, 30]."""

    def build(w) -> dict[str, Column]:
        return {
            "growth_rate_clipped": clip(F.col(col), -20.0, 50.0),
            "growth_rate_smooth": clip(F.avg(col).over(trailing(w, 7)), -10.0, 30.0),
        }

    return over_rows(df, panel, build, back=6)
