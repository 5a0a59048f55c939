"""Additive forecasts: piecewise-linear trend, yearly and weekly seasonality, holidays and
regressors, fitted per series.

The design row of every date is a Spark array expression.  Each partition sums its rows' products
per series (a Gram matrix), only these sums are shuffled, and one small solve per series turns
their total into coefficients: changes of the trend have a Laplace prior, so most of them are exactly
zero, all other terms a Gaussian one.  The posterior covariance is kept with the model, so intervals widen
where the data says little, above all past its end.  A refit at many cutoffs reads a series once: its products
are prefix sums, and the hinges of the trend, which move with the cutoff, follow from prefix sums at their knots.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StructField, StructType

from ridgeline.functions.keys import attach
from ridgeline.functions.sizing import written
from ridgeline.operators.evaluate import metrics_all
from ridgeline.operators.explore import recent_rows
from ridgeline.operators.merge import HOLIDAY_NAMES, holiday_column, holiday_features
from ridgeline.operators.splits import rolling_origin_cutoffs, rolling_origin_tests
from ridgeline.panel import NATIONAL, Panel

YEAR_DAYS = 365.25
WEEK_DAYS = 7.0
#: Series whose sums a task holds before it hands them on.
HELD_SERIES = 512
SOLVED = [StructField("beta", ArrayType(DoubleType())), StructField("sigma", DoubleType()), StructField("cov", ArrayType(DoubleType()))]


@dataclass(frozen=True)
class AdditiveSpec:
    changepoints: int = 25
    changepoint_range: float = 0.8
    yearly: int = 10
    weekly: int = 3
    changepoint_scale: float = 0.05
    seasonality_scale: float = 10.0
    holidays_scale: float = 10.0
    noise: float = 0.1
    regressors: tuple[str, ...] = ()
    holidays: tuple[str, ...] = tuple(HOLIDAY_NAMES)
    level: float = 0.8

    def terms(self) -> list[str]:
        """Names of the design columns, in order."""
        return (
            ["intercept", "trend"]
            + [f"changepoint_{j}" for j in range(1, self.changepoints + 1)]
            + [f"{w}_{f}_{k}" for w, n in (("yearly", self.yearly), ("weekly", self.weekly)) for k in range(1, n + 1) for f in ("sin", "cos")]
            + [holiday_column(h) for h in self.holidays]
            + list(self.regressors)
        )

    def penalties(self) -> list[float]:
        """Noise variance over the variance of each term's prior."""

        def cost(scale: float) -> float:
            return (self.noise / scale) ** 2

        return (
            [0.0, cost(5.0)]
            + [cost(self.changepoint_scale)] * self.changepoints
            + [cost(self.seasonality_scale)] * (2 * self.yearly + 2 * self.weekly)
            + [cost(self.holidays_scale)] * (len(self.holidays) + len(self.regressors))
        )

    @property
    def absolute(self) -> float:
        """Weight of the absolute size of a trend change: noise variance over the scale of its Laplace prior."""
        return self.noise**2 / self.changepoint_scale


def lasso(gram: np.ndarray, cross: np.ndarray, weight: float) -> np.ndarray:
    """argmin of x'Gx / 2 - c'x + weight * sum |x|: the terms that may leave zero are tried one at a time, the others
    solved exactly for their signs, stopping where a sign would turn."""
    n = len(cross)
    x, signs = np.zeros(n), np.zeros(n)
    close = 1e-10 * max(1.0, float(np.abs(cross).max(initial=0)))

    def worth(v: np.ndarray) -> float:
        return float(v @ gram @ v / 2 - cross @ v + weight * np.abs(v).sum())

    for _ in range(40 * n):
        slope = gram @ x - cross
        free = signs != 0
        if free.any() and np.abs(slope[free] + weight * signs[free]).max() > close:
            at = np.flatnonzero(free)
            goal = np.zeros(n)
            goal[at] = np.linalg.lstsq(gram[np.ix_(at, at)], cross[at] - weight * signs[at], rcond=None)[0]
            turns = at[(goal[at] * x[at] < 0)]
            shares = np.unique(np.append(x[turns] / (x[turns] - goal[turns]), 1.0))
            stops = [x + share * (goal - x) for share in shares]
            for stop, share in zip(stops, shares, strict=True):
                stop[turns[np.isclose(x[turns] / (x[turns] - goal[turns]), share)]] = 0.0
            x = min([x, *stops], key=worth)
            new = np.sign(x)
            if (new == signs).all() and not (x == goal).any():
                break
            signs = new
            continue
        best = int(np.where(free, -np.inf, np.abs(slope)).argmax()) if n else 0
        if not n or free[best] or abs(slope[best]) <= weight + close:
            break
        signs[best] = -np.sign(slope[best])
        x[best] = signs[best] * 1e-300  # on the side that the next solve starts from
    return np.where(np.abs(x) < 1e-200, 0.0, x)


def solve_terms(gram: np.ndarray, rows: float, spec: AdditiveSpec) -> tuple[np.ndarray, float, np.ndarray]:
    """(coefficients, residual sigma, posterior covariance) from the Gram matrix of the design and the target, which comes last.

    Terms with a Gaussian prior are eliminated, which leaves a small problem in the changes of the trend alone.
    The covariance takes the Laplace prior as the Gaussian of the same scale.
    """
    xx, xy, yy = gram[:-1, :-1], gram[:-1, -1], gram[-1, -1]
    penalty = np.array(spec.penalties())
    knots = np.zeros(len(penalty), bool)
    knots[2 : 2 + spec.changepoints] = True
    rest = ~knots
    inner = np.linalg.pinv(xx[np.ix_(rest, rest)] + np.diag(penalty[rest]), hermitian=True)
    across = xx[np.ix_(knots, rest)]
    beta = np.zeros(len(penalty))
    beta[knots] = lasso(xx[np.ix_(knots, knots)] - across @ inner @ across.T, xy[knots] - across @ inner @ xy[rest], spec.absolute)
    beta[rest] = inner @ (xy[rest] - across.T @ beta[knots])
    sigma = float(np.sqrt(max(yy - 2 * beta @ xy + beta @ xx @ beta, 0.0) / rows))
    return beta, sigma, sigma**2 * np.linalg.pinv(xx + np.diag(penalty), hermitian=True)


def _smooth(date: Column, spec: AdditiveSpec) -> list[Column]:
    """Seasonal and holiday terms, which do not depend on the span of the data."""
    days = F.unix_date(date).cast("double")
    cols = []
    for period, order in ((YEAR_DAYS, spec.yearly), (WEEK_DAYS, spec.weekly)):
        for k in range(1, order + 1):
            angle = days * (2 * np.pi * k / period)
            cols += [F.sin(angle), F.cos(angle)]
    return cols + [F.col(holiday_column(h)).cast("double") for h in spec.holidays]


def _design(date: Column, scale: Column, spec: AdditiveSpec) -> Column:
    """The design row of a date as array<double>; ``scale`` carries the fit's scaling."""
    days = F.unix_date(date).cast("double")
    t = F.coalesce(F.try_divide(days - scale["first"], scale["days"]), F.lit(0.0))
    cols = [F.lit(1.0), t]
    for j in range(1, spec.changepoints + 1):
        knot = spec.changepoint_range * j / spec.changepoints
        cols.append(F.greatest(t - knot, F.lit(0.0)))
    cols += _smooth(date, spec)
    for i, r in enumerate(spec.regressors):
        centred = F.coalesce(F.col(r).cast("double"), scale["centre"][i]) - scale["centre"][i]
        cols.append(F.coalesce(F.try_divide(centred, scale["spread"][i]), F.lit(0.0)))
    return F.array(*cols)


def fit(
    df: DataFrame,
    calendar: DataFrame,
    panel: Panel = NATIONAL,
    target: str = "new_cases",
    spec: AdditiveSpec = AdditiveSpec(),
    by: Iterable[str] = (),
) -> DataFrame:
    """One row per series (and per ``by`` group): scaling, coefficients, residual sigma, posterior covariance by rows."""
    keys = [*panel.series, *by]
    narrow = df.select(*keys, panel.order, F.col(target).cast("double").alias("y"), *spec.regressors).filter("y is not null")
    spans = narrow.groupBy(*keys).agg(
        F.struct(
            F.unix_date(F.min(panel.order)).cast("double").alias("first"),
            F.datediff(F.max(panel.order), F.min(panel.order)).cast("double").alias("days"),
            F.greatest(F.max(F.abs("y")), F.lit(1e-9)).alias("y_scale"),
            F.array(*[F.avg(r) for r in spec.regressors]).cast("array<double>").alias("centre"),
            F.array(*[F.stddev_samp(r) for r in spec.regressors]).cast("array<double>").alias("spread"),
        ).alias("scale")
    )
    rows = _with_holidays(narrow, calendar, spec)
    rows = attach(rows, spans, keys) if keys else rows.withColumn("scale", spans.scalar())
    wide = rows.select(*keys, (F.col("y") / F.col("scale.y_scale")).alias("y"), _design(F.col(panel.order), F.col("scale"), spec).alias("x"))
    named = [f for f in wide.schema if f.name in keys]
    sums = StructType([*named, StructField("rows", LongType()), StructField("gram", BinaryType())])
    schema = StructType([*named, *SOLVED])
    size = len(spec.terms()) + 1

    def add_up(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}

        def flush() -> pd.DataFrame:
            out = pd.DataFrame([(*k, n, g.tobytes()) for k, (n, g) in held.items()], columns=sums.names)
            held.clear()
            return out

        for pdf in batches:
            groups = pdf.groupby(keys, dropna=False, sort=False) if keys else [((), pdf)]
            for key, part in groups:
                key = tuple(None if pd.isna(k) else k for k in key)
                xy = np.column_stack([np.stack(part["x"].to_numpy()), part["y"].to_numpy()])
                total = held.setdefault(key, [0, np.zeros((size, size))])
                total[0] += len(xy)
                total[1] += xy.T @ xy
            if len(held) >= HELD_SERIES:
                yield flush()
        if held:
            yield flush()

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        gram = sum(np.frombuffer(g).reshape(size, size) for g in pdf["gram"])
        beta, sigma, cov = solve_terms(gram, float(pdf["rows"].sum()), spec)
        return pd.DataFrame([(*[pdf[k].iloc[0] for k in keys], beta.tolist(), sigma, cov.ravel().tolist())], columns=schema.names)

    betas = wide.mapInPandas(add_up, sums).groupBy(*keys).applyInPandas(solve, schema)
    # A row per series, read by the design, the scores and reports: computed once.
    return written(attach(betas, spans, keys) if keys else betas.withColumn("scale", spans.scalar()), "model")


def fit_at_cutoffs(
    df: DataFrame,
    cutoffs: DataFrame,
    calendar: DataFrame,
    panel: Panel = NATIONAL,
    target: str = "new_cases",
    spec: AdditiveSpec = AdditiveSpec(),
) -> DataFrame:
    """The models that ``fit`` finds on the rows up to each of the (series, cutoff) rows, with the column ``cutoff``.

    A series is sorted once and no row is copied.  Products of all terms that do not move with the cutoff are summed up
    to the few row numbers where a cutoff or a knot lies; a hinge (t - knot) is zero before its knot, so
    its products are differences of these sums.  A series of daily rows is no longer than the calendar.
    """
    keys = list(panel.series)
    base = _with_holidays(df.select(*keys, panel.order, F.col(target).cast("double").alias("y"), *spec.regressors).filter("y is not null"), calendar, spec)
    day = F.unix_date(F.col(panel.order)).cast("long")
    none = F.array().cast("array<double>")
    rows = base.select(
        *keys, day.alias("day"), "y", _doubles(_smooth(F.col(panel.order), spec)).alias("smooth"),
        _doubles([F.col(r).cast("double") for r in spec.regressors]).alias("outer"), F.lit(False).alias("is_cutoff"),
    )
    marks = cutoffs.select(*keys, F.unix_date("cutoff").cast("long"), F.lit(None).cast("double"), none, none, F.lit(True))
    named = [f for f in rows.schema if f.name in keys]
    pair = [StructField(n, DoubleType()) for n in ("first", "days", "y_scale")] + [StructField(n, ArrayType(DoubleType())) for n in ("centre", "spread")]
    schema = StructType([*named, StructField("cutoff", LongType()), *SOLVED, *pair])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        key = [pdf[k].iloc[0] for k in keys]
        known = pdf[~pdf["is_cutoff"]].sort_values("day", kind="stable")
        return pd.DataFrame([(*key, *row) for row in _prefix_fits(known, sorted(pdf.loc[pdf["is_cutoff"], "day"]), spec)], columns=schema.names)

    fits = rows.union(marks).groupBy(*keys).applyInPandas(solve, schema)
    scale = F.struct("first", "days", "y_scale", "centre", "spread").alias("scale")
    out = fits.select(*keys, F.date_from_unix_date(F.col("cutoff").cast("int")).alias("cutoff"), *[f.name for f in SOLVED], scale)
    return written(out, "models")


def _prefix_fits(rows: pd.DataFrame, cutoffs: list[int], spec: AdditiveSpec) -> Iterator[tuple]:
    """Per cutoff with rows: the cutoff, its solution and scaling, from prefix sums of the sorted rows' products."""
    days = rows["day"].to_numpy()
    ends = np.searchsorted(days, cutoffs, "right")
    if not len(days) or not ends.any():
        return
    first, y = float(days[0]), rows["y"].to_numpy(float)
    since = days - first
    smooth = np.array(rows["smooth"].tolist(), float).reshape(len(days), -1)
    outer = np.array(rows["outer"].tolist(), float).reshape(len(days), -1)  # NULL is NaN here
    seen = ~np.isnan(outer)
    level = np.array([v[s].mean() if s.any() else 0.0 for v, s in zip(outer.T, seen.T, strict=True)])
    around = np.where(seen, outer - level, 0.0)
    base = np.column_stack([np.ones(len(days)), since, smooth, seen, around, y])
    peak = np.maximum.accumulate(np.abs(y))
    m, r, j = smooth.shape[1], outer.shape[1], spec.changepoints
    share = spec.changepoint_range * np.arange(1, j + 1) / j if j else np.zeros(0)
    spans = np.where(ends > 0, since[np.maximum(ends, 1) - 1], 0.0)
    starts = np.searchsorted(since, np.outer(spans, share), "right")
    places = np.unique(np.concatenate([[0], ends, np.minimum(starts, ends[:, None]).ravel()]))
    sums = np.zeros((len(places), base.shape[1], base.shape[1]))
    for i in range(1, len(places)):
        part = base[places[i - 1] : places[i]]
        sums[i] = sums[i - 1] + part.T @ part
    for cutoff, end, span, knots in zip(cutoffs, ends, spans, starts, strict=True):
        if not end:
            continue
        total = sums[np.searchsorted(places, end)]
        n_seen = np.diag(total)[2 + m : 2 + m + r]
        mean = np.divide(total[0, 2 + m + r : -1], n_seen, out=np.zeros(r), where=n_seen > 0)
        spread = np.sqrt(np.divide(np.maximum(np.diag(total)[2 + m + r : -1] - n_seen * mean**2, 0), n_seen - 1, out=np.full(r, np.nan), where=n_seen > 1))
        unit = np.divide(1.0, spread, out=np.zeros(r), where=spread > 0)
        y_scale = max(float(peak[end - 1]), 1e-9)
        # The terms in order of the base: intercept, trend, smooth ones, regressors, target.
        line = np.zeros((3 + m + r, base.shape[1]))
        line[0, 0], line[1, 1], line[-1, -1] = 1, 1 / span if span else 0, 1 / y_scale
        line[2 : 2 + m, 2 : 2 + m] = np.eye(m)
        line[2 + m : -1, 2 + m : 2 + m + r], line[2 + m : -1, 2 + m + r : -1] = np.diag(-mean * unit), np.diag(unit)
        gram = np.zeros((3 + m + r + j,) * 2)
        at = np.r_[0, 1, 2 + j : 3 + m + r + j]
        gram[np.ix_(at, at)] = line @ total @ line.T
        if span:
            where = share * span
            tails = [total - sums[np.searchsorted(places, min(k, end))] for k in knots]
            for a in range(j):
                row = line @ (tails[a][:, 1] - where[a] * tails[a][:, 0]) / span
                gram[2 + a, at] = gram[at, 2 + a] = row
                for b in range(a + 1):
                    t = tails[a]
                    gram[2 + a, 2 + b] = gram[2 + b, 2 + a] = (t[1, 1] - (where[a] + where[b]) * t[0, 1] + where[a] * where[b] * t[0, 0]) / span**2
        beta, sigma, cov = solve_terms(gram, float(end), spec)
        spread_out = [None if np.isnan(v) else float(v) for v in spread]
        centre = [float(c) if k else None for c, k in zip(level + mean, n_seen, strict=True)]
        yield int(cutoff), beta.tolist(), sigma, cov.ravel().tolist(), first, float(span), y_scale, centre, spread_out


def _doubles(cols: list[Column]) -> Column:
    return F.array(*cols).cast("array<double>")


def _with_holidays(df: DataFrame, calendar: DataFrame, spec: AdditiveSpec) -> DataFrame:
    return holiday_features(df, calendar, list(spec.holidays)) if spec.holidays else df


def score(
    df: DataFrame,
    model: DataFrame,
    calendar: DataFrame,
    panel: Panel = NATIONAL,
    spec: AdditiveSpec = AdditiveSpec(),
    by: Iterable[str] = (),
    keep: Iterable[str] = (),
) -> DataFrame:
    """Add yhat and its interval at the frame's own dates and regressors.

    The interval holds the residual noise and the uncertainty of the coefficients.  Rows meet their
    model as a group, so a model's matrices are never copied to its rows.
    """
    keys, keep = [*panel.series, *by], list(keep)
    dated = _with_holidays(df, calendar, spec)
    if keys:
        joined = attach(dated, model.select(*keys, "scale"), keys)
    else:
        joined = dated.withColumn("scale", model.select("scale").scalar())
    one = F.lit(1).alias("_one")
    x = _design(F.col(panel.order), F.col("scale"), spec)
    kept = list(dict.fromkeys([*keys, panel.order, *keep]))
    rows = joined.select(*kept, x.alias("_x"), one)
    fitted = model.select(*keys, *[f.name for f in SOLVED], F.col("scale.y_scale").alias("_y_scale"), one)
    schema = StructType([*[f for f in rows.schema if f.name in kept], *[StructField(n, DoubleType()) for n in ("yhat", "yhat_lower", "yhat_upper")]])
    z, size = NormalDist().inv_cdf(0.5 + spec.level / 2), len(spec.terms())

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        yhat = half = np.zeros(0)
        if left.num_rows and right.num_rows:
            found = right.slice(0, 1).to_pylist()[0]
            design = left.column("_x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            cov = np.array(found["cov"]).reshape(size, size)
            yhat = design @ np.array(found["beta"]) * found["_y_scale"]
            half = z * found["_y_scale"] * np.sqrt(found["sigma"] ** 2 + np.maximum(((design @ cov) * design).sum(axis=1), 0))
        else:
            left = left.slice(0, 0)
        cols = [*[left.column(c) for c in kept], pa.array(yhat), pa.array(yhat - half), pa.array(yhat + half)]
        return pa.table(cols, names=schema.names)

    group = [*keys, "_one"]
    return rows.groupBy(*group).cogroup(fitted.groupBy(*group)).applyInArrow(apply, schema)


def as_observations(df: DataFrame, panel: Panel = NATIONAL, target: str = "new_cases", regressors: Iterable[str] = ()) -> DataFrame:
    """(series, ds, y, regressors), the shape that forecasting tools exchange; rows without a date or a truth are left out."""
    named = df.select(*panel.series, F.col(panel.order).cast("date").alias("ds"), F.col(target).cast("double").alias("y"), *[F.col(r).cast("double") for r in regressors])
    return named.filter("ds IS NOT NULL AND y IS NOT NULL")


def future_dates(df: DataFrame, panel: Panel, horizon: int) -> DataFrame:
    """(series, date) for the ``horizon`` days after the last date of each series."""
    last = df.groupBy(*panel.series).agg(F.max(panel.order).alias("_last"))
    ahead = F.sequence(F.date_add("_last", 1), F.date_add("_last", horizon))
    return last.filter("_last is not null").select(*panel.series, F.explode(ahead).alias(panel.order))


def forecast_horizon(
    df: DataFrame,
    model: DataFrame,
    calendar: DataFrame,
    horizon: int = 30,
    panel: Panel = NATIONAL,
    spec: AdditiveSpec = AdditiveSpec(),
) -> DataFrame:
    """Forecast past the end; regressors are held at the mean of their last seven rows."""
    future = future_dates(df, panel, horizon)
    if spec.regressors:
        held = recent_rows(df, panel, 7).groupBy(*panel.series).agg(*[F.avg(r).alias(r) for r in spec.regressors])
        if panel.series:
            future = future.join(held, list(panel.series))
        else:
            one = held.select(F.struct(*spec.regressors).alias("h")).scalar()
            future = future.withColumn("_h", one).select(panel.order, "_h.*")
    return score(future, model, calendar, panel, spec)


def regressor_effect(model: DataFrame, panel: Panel = NATIONAL, spec: AdditiveSpec = AdditiveSpec()) -> DataFrame:
    """Absolute coefficient of each regressor, matched by name."""
    terms = spec.terms()
    items = [
        F.struct(F.lit(r).alias("regressor"), F.abs(F.col("beta")[terms.index(r)]).alias("effect")) for r in spec.regressors
    ]
    return model.select(*panel.series, F.inline(F.array(*items)))


def rolling_origin(
    df: DataFrame,
    calendar: DataFrame,
    panel: Panel = NATIONAL,
    target: str = "new_cases",
    spec: AdditiveSpec = AdditiveSpec(),
    initial: int = 180,
    period: int = 30,
    horizon: int = 30,
) -> DataFrame:
    """Refit at each cutoff and score the days after it, in long prediction form with ``horizon``."""
    cuts = rolling_origin_cutoffs(df, panel, initial, period, horizon)
    model = fit_at_cutoffs(df, cuts, calendar, panel, target, spec)
    test = rolling_origin_tests(df, panel, initial, period, horizon)
    out = score(test, model, calendar, panel, spec, by=["cutoff"], keep=[target])
    return out.select(
        *panel.series,
        "cutoff",
        panel.order,
        F.datediff(F.col(panel.order), F.col("cutoff")).alias("horizon"),
        F.lit("additive").alias("model"),
        F.col(target).cast("double").alias("y_true"),
        F.col("yhat").alias("y_pred"),
        F.col("yhat_lower").alias("y_lower"),
        F.col("yhat_upper").alias("y_upper"),
    )


def rolling_origin_metrics(predictions: DataFrame, panel: Panel = NATIONAL) -> DataFrame:
    """Metrics by days ahead, over all cutoffs, and the share of truths inside their interval."""
    metrics = metrics_all(predictions, ["model", "horizon"], panel)
    inside = F.col("y_true").between(F.col("y_lower"), F.col("y_upper")).cast("double")
    return metrics.join(predictions.groupBy("model", "horizon").agg(F.avg(inside).alias("coverage")), ["model", "horizon"])
