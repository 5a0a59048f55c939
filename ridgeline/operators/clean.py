"""Imputation, clipping and the per-source cleaners."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ridgeline.functions.keys import attach
from ridgeline.functions.numeric import (
    clip, existing, finite, finite_sql, float_columns, not_nan, numeric_columns, pct_change, quoted, require,
)
from ridgeline.functions.sizing import fits_broadcast, written
from ridgeline.operators.quantiles import exact_quantiles, quantile_struct
from ridgeline.operators.segments import POS, drop_neighbours, over_rows, with_neighbours
from ridgeline.panel import NATIONAL, Panel, so_far, trailing

# Column names of the three daily sources.
CASE_MEASURES = ("confirmed", "deaths", "new_cases", "new_deaths")
MOBILITY = ("retail_recreation", "grocery_pharmacy", "parks", "transit", "workplaces", "residential")
WEATHER = ("temperature_mean", "precipitation", "humidity_mean")
NATIONAL_STATE = "National"


def interpolate_linear(df: DataFrame, panel: Panel = NATIONAL, cols: list[str] | None = None) -> DataFrame:
    """Fill gaps on the straight line between known rows; end gaps take the nearest known value."""
    cols = [c for c in numeric_columns(df) if c not in panel.keys] if cols is None else existing(df, cols)
    if not cols:
        return df
    keep_pos = POS in df.columns
    near = with_neighbours(df, panel, cols)
    filled = {}
    for c in cols:
        prev, nxt = F.col(f"_prev_{c}"), F.col(f"_next_{c}")
        share = F.try_divide(F.col(POS) - prev["pos"], nxt["pos"] - prev["pos"])
        line = prev["v"] + (nxt["v"] - prev["v"]) * share
        filled[c] = F.coalesce(F.col(c), line, prev["v"], nxt["v"]).cast("double")
    return drop_neighbours(near.withColumns(filled), cols, keep_pos)


def fill(df: DataFrame, panel: Panel = NATIONAL, cols: list[str] | None = None, how: str = "ffill_bfill") -> DataFrame:
    """Carry known values along the series: ``ffill``, ``bfill`` or one then the other."""
    cols = [c for c in df.columns if c not in panel.keys] if cols is None else existing(df, cols)
    keep_pos = POS in df.columns
    cols = [c for c in cols if c != POS]
    if not cols:
        return df
    sides = {"ffill": ("prev",), "bfill": ("next",), "ffill_bfill": ("prev", "next")}[how]
    if not panel.long:
        order = {"prev": so_far(panel.window()), "next": so_far(panel.latest_first())}
        return df.withColumns({c: F.coalesce(*[F.last(c, True).over(order[s]) for s in sides]) for c in cols})
    near = with_neighbours(df, panel, cols, sides)
    filled = {c: F.coalesce(*[F.col(f"_{s}_{c}")["v"] for s in sides]) for c in cols}
    return drop_neighbours(near.withColumns(filled), cols, keep_pos)


def mean_fill(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Replace NULLs by the column mean over the whole frame."""
    cols = numeric_columns(df) if cols is None else existing(df, cols)
    means = df.agg(F.struct(*[F.avg(c).alias(c) for c in cols]).alias("m")).scalar()
    return df.withColumn("_m", means).withColumns({c: F.coalesce(F.col(c), F.col("_m")[c]) for c in cols}).drop("_m")


def constant_fill(df: DataFrame, cols: list[str], value: float = 0.0) -> DataFrame:
    """Replace NULL, NaN and infinities by one value."""
    floats = set(float_columns(df))
    return df.withColumns(
        {c: F.coalesce(finite(F.col(c)) if c in floats else F.col(c), F.lit(value)) for c in existing(df, cols)}
    )


def fill_missing(df: DataFrame, method: str = "interpolate", panel: Panel = NATIONAL) -> DataFrame:
    """``interpolate``, ``forward_fill`` (then backward), ``backward_fill`` or ``mean``."""
    if method == "interpolate":
        return interpolate_linear(df, panel)
    if method == "forward_fill":
        return fill(df, panel)
    if method == "backward_fill":
        return fill(df, panel, how="bfill")
    if method == "mean":
        return mean_fill(df)
    raise ValueError(f"unknown fill method {method!r}")


def clip_iqr(
    df: DataFrame, cols: list[str], threshold: float = 1.5, panel: Panel = NATIONAL, fit_on=None
) -> DataFrame:
    """Clip to [Q1 - t*IQR, Q3 + t*IQR], per series; ``fit_on`` restricts the rows the quartiles see."""
    cols = existing(df, cols)
    base = df if fit_on is None else df.filter(fit_on)
    if panel.series:
        q = exact_quantiles(base, cols, [0.25, 0.75], panel.series, bounded=not panel.long)
        q = q.select(*panel.series, F.struct(*cols).alias("_q"))
        framed = attach(df, q, panel.series, "left")
    else:
        framed = df.withColumn("_q", quantile_struct(base, cols, [0.25, 0.75], bounded=not panel.long))
    out = {}
    for c in cols:
        q1, q3 = F.col("_q")[c][0], F.col("_q")[c][1]
        out[c] = clip(F.col(c).cast("double"), q1 - threshold * (q3 - q1), q3 + threshold * (q3 - q1))
    return framed.withColumns(out).drop("_q")


def clip_zscore(
    df: DataFrame, cols: list[str], threshold: float = 3.0, panel: Panel = NATIONAL, fit_on=None
) -> DataFrame:
    """Clip to mean +/- t sample standard deviations, per series."""
    cols = existing(df, cols)
    base = df if fit_on is None else df.filter(fit_on)
    moments = F.struct(*[F.struct(F.avg(c).alias("mu"), F.stddev_samp(c).alias("sd")).alias(c) for c in cols])
    stats = base.groupBy(*panel.series).agg(moments.alias("_z"))
    framed = attach(df, stats, panel.series, "left") if panel.series else df.withColumn("_z", stats.scalar())
    out = {}
    for c in cols:
        mu, sd = F.col("_z")[c]["mu"], F.col("_z")[c]["sd"]
        out[c] = clip(F.col(c).cast("double"), mu - threshold * sd, mu + threshold * sd)
    return framed.withColumns(out).drop("_z")


def clip_outliers(df: DataFrame, cols: list[str], method: str = "iqr", threshold: float = 1.5, panel: Panel = NATIONAL) -> DataFrame:
    if method == "iqr":
        return clip_iqr(df, cols, threshold, panel)
    if method == "zscore":
        return clip_zscore(df, cols, threshold, panel)
    raise ValueError(f"unknown outlier method {method!r}")


def clip_nonneg(df: DataFrame, cols: list[str] | tuple[str, ...] = CASE_MEASURES) -> DataFrame:
    return df.withColumns({c: clip(F.col(c), lo=0) for c in existing(df, cols)})


def fill_national(df: DataFrame, col: str = "state") -> DataFrame:
    if col not in df.columns:
        return df
    return df.withColumn(col, F.coalesce(F.col(col), F.lit(NATIONAL_STATE)))


def impute_median(df: DataFrame, panel: Panel = NATIONAL, cols: list[str] | None = None, fit_on=None) -> DataFrame:
    """Infinities become NULL, then NULLs become the column median over the whole frame.

    One daily series is bounded, so its medians are one aggregate; a panel has as many rows
    as it has series, so its medians are found by radix selection.
    """
    cols = [c for c in numeric_columns(df) if c not in panel.keys] if cols is None else existing(df, cols)
    if not cols:
        return df
    floats = set(float_columns(df))
    tidy = df.selectExpr(*[f"{finite_sql(c)} AS {quoted(c)}" if c in floats and c in cols else quoted(c) for c in df.columns])
    bounded = not panel.series and not panel.long
    if not bounded:
        tidy = written(tidy, "imputed")  # read a few more times for the medians: store it once
    base = tidy if fit_on is None else tidy.filter(fit_on)
    framed = tidy.withColumn("_med", quantile_struct(base, cols, [0.5], bounded=bounded))
    return framed.selectExpr(
        *[f"coalesce({quoted(c)}, _med.{quoted(c)}[0]) AS {quoted(c)}" if c in cols else quoted(c) for c in tidy.columns]
    )


def _as_dates(df: DataFrame, col: str) -> DataFrame:
    if isinstance(df.schema[col].dataType, StringType):
        return df.withColumn(col, F.try_to_date(F.col(col)))
    return df.withColumn(col, F.col(col).cast("date"))


def clean_cases(df: DataFrame, panel: Panel = NATIONAL, threshold: float = 3.0) -> DataFrame:
    """Parse dates, clip negatives, interpolate, then clip extreme daily counts."""
    require(df, panel.order)
    out = interpolate_linear(clip_nonneg(_as_dates(df, panel.order)), panel)
    return clip_iqr(out, ["new_cases"], threshold, panel) if "new_cases" in out.columns else out


def clean_mobility(df: DataFrame, panel: Panel) -> DataFrame:
    """Parse dates, name the missing region, interpolate the six measures within each series."""
    return interpolate_linear(fill_national(_as_dates(df, panel.order)), panel, list(MOBILITY))


def clean_weather(df: DataFrame, panel: Panel) -> DataFrame:
    return interpolate_linear(_as_dates(df, panel.order), panel)


def daily_by_state(
    df: DataFrame, cols: tuple[str, ...] = MOBILITY, lookup: DataFrame | None = None, key: str | None = None
) -> DataFrame:
    """Mean of each measure per (date, state): districts collapse into their state.

    Rows may name their state by a ``key`` of the ``lookup`` (key, state).  While the lookup passes the broadcast size check they
    meet it in place; beyond it they are summed per (key, date) first, so the join sees one row per key and day,
    however many rows a key has.
    """
    have = existing(df, cols)
    if lookup is not None and fits_broadcast(lookup):
        return daily_by_state(df.join(F.broadcast(lookup), key), cols)
    if lookup is not None:
        sums = [x for c in have for x in (F.sum(c).alias(f"_s_{c}"), F.count(c).alias(f"_n_{c}"))]
        again = [F.try_divide(F.sum(f"_s_{c}"), F.sum(f"_n_{c}")).alias(c) for c in have]
        return df.groupBy(key, "date").agg(*sums).join(lookup, key).groupBy("date", "state").agg(*again)
    if "state" not in df.columns or not have:
        return df
    return df.groupBy("date", "state").agg(*[F.avg(c).alias(c) for c in have])


def daily_mean(df: DataFrame, cols: tuple[str, ...] = MOBILITY) -> DataFrame:
    """Mean of each measure per date over whatever rows the frame has."""
    return df.groupBy("date").agg(*[F.avg(c).alias(c) for c in existing(df, cols)])


def first_difference(df: DataFrame, panel: Panel, pairs: dict[str, str], floor_zero: bool = True) -> DataFrame:
    """Add ``{new: cumulative}`` daily changes; the first row is 0 and, if asked, so are decreases."""

    def build(w):
        out = {}
        for new, c in pairs.items():
            change = F.coalesce(F.col(c) - F.lag(c, 1).over(w), F.lit(0))
            out[new] = (clip(change, lo=0) if floor_zero else change).cast("double")
        return out

    return over_rows(df, panel, build, back=1)


def cases_derived(df: DataFrame, panel: Panel = NATIONAL) -> DataFrame:
    """Daily cases (if absent), 7-row mean, bounded growth rate and case fatality rate."""
    out = df
    if "new_cases" not in out.columns and "confirmed" in out.columns:
        out = first_difference(out, panel, {"new_cases": "confirmed"})
    if "new_cases" in out.columns:
        out = over_rows(out, panel, lambda w: {"new_cases_7day_avg": F.avg("new_cases").over(trailing(w, 7))}, back=6)
    if "confirmed" in out.columns:
        out = confirmed_growth(out, panel)
        if "deaths" in out.columns:
            out = out.withColumn("case_fatality_rate", F.col("deaths") / clip(F.col("confirmed"), lo=1) * 100)
    return out


def confirmed_growth(df: DataFrame, panel: Panel, col: str = "confirmed", name: str = "growth_rate") -> DataFrame:
    """Percent change of a carried-forward column, 0 where undefined, clipped to [-100, 500]."""
    known = f"_known_{col}"
    carried = fill(df.withColumn(known, F.col(col).cast("double")), panel, [known], how="ffill")

    def build(w):
        rate = F.coalesce(not_nan(pct_change(F.col(known), F.lag(known, 1).over(w))), F.lit(0.0)) * 100
        return {name: clip(rate, -100.0, 500.0)}

    return over_rows(carried, panel, build, back=1).drop(known)


def clean_all(datasets: dict[str, DataFrame], panels: dict[str, Panel]) -> dict[str, DataFrame]:
    """Clean whichever of cases / mobility / weather are present; everything stays lazy."""
    out = dict(datasets)
    if "cases" in datasets:
        out["cases"] = cases_derived(clean_cases(datasets["cases"], panels.get("cases", NATIONAL)), panels.get("cases", NATIONAL))
    if "mobility" in datasets:
        out["mobility"] = daily_by_state(clean_mobility(datasets["mobility"], panels["mobility"]))
    if "weather" in datasets:
        out["weather"] = clean_weather(datasets["weather"], panels["weather"])
    return out


def drop_nulls(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return df.na.drop(how="any", subset=cols)


