"""Forecast accuracy on long prediction frames (series, date, model, y_true, y_pred)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions.keys import attach
from ridgeline.functions.numeric import INF
from ridgeline.operators.explore import share_of_rows
from ridgeline.operators.segments import number_rows, over_rows
from ridgeline.panel import NATIONAL, Panel

HORIZONS = (1, 3, 7, 14)


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg((y - p) * (y - p)))


def mape(y: Column, p: Column) -> Column:
    """Mean absolute percentage error over non-zero truths; infinite when there are none."""
    share = F.avg(F.abs(F.try_divide(y - p, y))) * 100
    return F.when(F.count(y) > 0, F.coalesce(share, F.lit(INF)))


def r2(y: Column, p: Column) -> Column:
    """1 - SSE/SST; over a constant truth 1 if perfect, else 0."""
    sse, sst = F.sum((y - p) * (y - p)), F.var_pop(y) * F.count(y)
    return F.when(sst == 0, F.when(sse == 0, 1.0).otherwise(0.0)).otherwise(1 - F.try_divide(sse, sst))


def mda(y: Column, p: Column) -> Column:
    """Share of rows that move the way the truth moves, in percent; reads the ``hit`` of ``with_direction``."""
    return F.avg("hit") * 100


#: Every metric by name; ``metrics_all`` computes whatever is registered here, in this order.
METRICS: dict[str, Callable[[Column, Column], Column]] = {"mae": mae, "rmse": rmse, "mape": mape, "mda": mda, "r2": r2}


def with_direction(df: DataFrame, panel: Panel) -> DataFrame:
    """Add ``hit``: does the prediction move the way the truth moves?  NULL on first rows."""

    def build(w) -> dict[str, Column]:
        dy = F.col("y_true") - F.lag("y_true", 1).over(w)
        dp = F.col("y_pred") - F.lag("y_pred", 1).over(w)
        return {"hit": (F.signum(dy) == F.signum(dp)).cast("double")}

    return over_rows(df, panel, build, back=1)


def metrics_all(df: DataFrame, by: Iterable[str] = ("model",), panel: Panel = NATIONAL) -> DataFrame:
    """mae, rmse, mape, mda and r2 per group; directions are taken inside each series and group."""
    by = list(by)
    inner = Panel(panel.order, tuple(dict.fromkeys([*by, *panel.series])), panel.ties, panel.segment_rows)
    marked = with_direction(df, inner)
    y, p = F.col("y_true"), F.col("y_pred")
    return marked.groupBy(*by).agg(*[f(y, p).alias(name) for name, f in METRICS.items()])


def mean_directional_accuracy(df: DataFrame, by: Iterable[str] = ("model",), panel: Panel = NATIONAL) -> DataFrame:
    return metrics_all(df, by, panel).select(*by, "mda")


def metrics_by_horizon(
    df: DataFrame, horizons: Iterable[int] = HORIZONS, by: Iterable[str] = ("model",), panel: Panel = NATIONAL
) -> DataFrame:
    """Truth h rows ahead against today's prediction; all NULL where a series is too short."""
    hs, by = tuple(horizons), list(by)
    inner = Panel(panel.order, tuple(dict.fromkeys([*by, *panel.series])), panel.ties, panel.segment_rows)
    ahead = over_rows(
        df, inner, lambda w: {f"_y{h}": F.lead("y_true", h).over(w) for h in hs}, ahead=max(hs)
    )
    pairs = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"_y{h}").alias("y_true")) for h in hs])
    keep = list(dict.fromkeys([*inner.keys, "y_pred"]))
    return metrics_all(ahead.select(*keep, F.inline(pairs)), [*by, "horizon"], panel)


def rank_models(metrics: DataFrame, by: str = "mae") -> DataFrame:
    """Add the rank of each model; the metrics table has one row per model."""
    return metrics.withColumn("rank", F.row_number().over(Window.orderBy(F.col(by).asc_nulls_last(), "model")))


def best_model(metrics: DataFrame, by: str = "mae") -> DataFrame:
    """The model with the smallest metric; one without a metric is never better."""
    return metrics.orderBy(F.col(by).asc_nulls_last(), "model").limit(1)


def model_comparison(metrics: DataFrame, baseline: str) -> DataFrame:
    """Metrics with Better / Worse against the MAE of a named baseline model."""
    reference = metrics.filter(F.col("model") == baseline).select(F.max("mae")).scalar()
    verdict = F.when(F.col("model") == baseline, "N/A").when(F.col("mae") < reference, "Better").otherwise("Worse")
    return metrics.withColumn("vs_baseline", verdict)


def with_regime(df: DataFrame, col: str = "y_true", panel: Panel = NATIONAL) -> DataFrame:
    """Label rows Surge / Endemic / Low by one population standard deviation around the mean."""
    stats = df.groupBy(*panel.series).agg(F.struct(F.avg(col).alias("mu"), F.stddev_pop(col).alias("sd")).alias("_s"))
    framed = attach(df, stats, panel.series) if panel.series else df.withColumn("_s", stats.scalar())
    mu, sd = F.col("_s.mu"), F.col("_s.sd")
    label = F.when(F.col(col) > mu + sd, "Surge").when(F.col(col) < mu - sd, "Low").otherwise("Endemic")
    return framed.withColumn("regime", label).drop("_s")


def regime_mae(df: DataFrame, panel: Panel = NATIONAL) -> DataFrame:
    """MAE and row count per regime and model; every model must cover the same dates."""
    labelled = with_regime(df, "y_true", panel)
    return labelled.groupBy("regime", "model").agg(
        mae(F.col("y_true"), F.col("y_pred")).alias("mae"), F.count(F.lit(1)).alias("n_samples")
    )


def regime_share(truth: DataFrame, col: str = "y_true", panel: Panel = NATIONAL) -> DataFrame:
    return share_of_rows(with_regime(truth, col, panel), "regime")


def residual_stats(df: DataFrame, by: Iterable[str] = ("model",)) -> DataFrame:
    """Bias, spread and range of y_true - y_pred."""
    e = F.col("y_true") - F.col("y_pred")
    return df.groupBy(*by).agg(
        F.count(e).alias("n"), F.avg(e).alias("mean"), F.stddev_samp(e).alias("std"),
        F.min(e).alias("min"), F.max(e).alias("max"),
    )


def residuals(df: DataFrame) -> DataFrame:
    return df.withColumn("residual", F.col("y_true") - F.col("y_pred"))


def normality(df: DataFrame, by: Iterable[str] = ("model",)) -> DataFrame:
    """Jarque-Bera statistic and p-value (chi-square, two degrees) of the residuals."""
    e = F.col("y_true") - F.col("y_pred")
    stats = df.groupBy(*by).agg(F.count(e).alias("n"), F.skewness(e).alias("skewness"), F.kurtosis(e).alias("excess_kurtosis"))
    jb = F.col("n") / 6 * (F.pow("skewness", F.lit(2)) + F.pow("excess_kurtosis", F.lit(2)) / 4)
    return stats.withColumn("jarque_bera", jb).withColumn("p_value", F.exp(-F.col("jarque_bera") / 2))


def _two_sided_p(z: Column) -> Column:
    """2 * (1 - Phi(|z|)) by the series of the error function, whose terms are all positive; exact to
    about 1e-15, and 0 from the ninth standard deviation on."""
    size = F.least(F.abs(z), F.lit(9.0))
    square = size * size
    terms = F.sequence(F.lit(200), F.lit(1), F.lit(-1))
    series = F.aggregate(terms, F.lit(1.0), lambda acc, k: 1 + square / (2 * k + 1) * acc)
    inside = math.sqrt(2 / math.pi) * size * F.exp(-square / 2) * series
    return F.when(z.isNotNull() & ~F.isnan(z), F.greatest(1 - inside, F.lit(0.0)))


#: No probability of a normal value is taken to be nearer to 0 or 1.
SMALLEST_TAIL = 1e-15


def anderson_darling(df: DataFrame, by: Iterable[str] = ("model",), segment_rows: int = 65_536) -> DataFrame:
    """Anderson-Darling statistic of the residuals against a normal of their own mean and spread, and its p-value.

    Every residual needs its rank in its group.  Ranks come from a range-partitioned sort, so a group of any size
    is spread over tasks; groups without spread have no statistic.
    """
    by = list(by)
    known = df.select(*by, (F.col("y_true") - F.col("y_pred")).alias("_e")).filter(F.col("_e").isNotNull() & ~F.isnan("_e"))
    moments = known.groupBy(*by).agg(F.count("_e").alias("n"), F.avg("_e").alias("_mean"), F.stddev_samp("_e").alias("_sd"))
    ranked = number_rows(known, Panel("_e", tuple(by), (), segment_rows), "_rank")
    framed = attach(ranked, moments, by) if by else ranked.withColumn("_m", moments.select(F.struct("*")).scalar()).select("_e", "_rank", "_m.*")
    z = F.try_divide(F.col("_e") - F.col("_mean"), F.col("_sd"))
    tail = F.when(z.isNotNull(), F.greatest(_two_sided_p(z) / 2, F.lit(SMALLEST_TAIL)))
    below, above = (F.when(flip, 1 - tail).otherwise(tail) for flip in (z > 0, z <= 0))
    i, n = F.col("_rank") + 1, F.col("n")
    term = (2 * i - 1) * F.log(below) + (2 * (n - i) + 1) * F.log(above)
    stats = framed.groupBy(*by, "n").agg(F.sum(term).alias("_s")).withColumn("anderson_darling", -F.col("n") - F.col("_s") / F.col("n"))
    a = F.col("anderson_darling") * (1 + 0.75 / F.col("n") + 2.25 / (F.col("n") * F.col("n")))
    # The usual approximation of the p-value with estimated mean and variance.
    p = (
        F.when(a >= 10, F.lit(3.7e-24))
        .when(a >= 0.6, F.exp(1.2937 - 5.709 * a + 0.0186 * a * a))
        .when(a > 0.34, F.exp(0.9177 - 4.279 * a - 1.38 * a * a))
        .when(a > 0.2, 1 - F.exp(-8.318 + 42.796 * a - 59.938 * a * a))
        .otherwise(1 - F.exp(-13.436 + 101.14 * a - 223.73 * a * a))
    )
    return stats.select(*by, "n", "anderson_darling", F.when(a.isNotNull(), F.least(p, F.lit(1.0))).alias("p_value"))


def diebold_mariano(
    df: DataFrame, first: str, second: str, loss: str = "mse", by: Iterable[str] = (), panel: Panel = NATIONAL,
    p_value: bool = True,
) -> DataFrame:
    """Loss-difference test of two models over the dates both predict: statistic, n and p-value."""
    e = F.col("y_true") - F.col("y_pred")
    if loss not in ("mse", "mae"):
        raise ValueError("loss must be 'mse' or 'mae'")
    cost = e * e if loss == "mse" else F.abs(e)
    side = F.when(F.col("model") == first, cost), F.when(F.col("model") == second, cost)
    pairs = (
        df.filter(F.col("model").isin(first, second))
        .groupBy(*panel.keys)
        .agg((F.max(side[0]) - F.max(side[1])).alias("d"))
    )
    out = pairs.groupBy(*by).agg(F.count("d").alias("n"), F.avg("d").alias("mean_d"), F.stddev_samp("d").alias("std_d"))
    out = out.withColumn("dm_stat", F.try_divide(F.col("mean_d"), F.col("std_d") / F.sqrt("n")))
    return out.withColumn("p_value", _two_sided_p(F.col("dm_stat"))) if p_value else out
