"""Combining models.  Everything works on the long frame (series, date, model, y_true, y_pred)
and joins by key, so predictions never have to start on the same row."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ridgeline.functions.keys import attach
from ridgeline.operators.evaluate import metrics_all
from ridgeline.operators.explore import recent_rows
from ridgeline.panel import NATIONAL, Panel

SMALLEST_ERROR = 1e-8
LOOKBACK = 14
#: Share of the Gram matrix's mean diagonal that makes optimal weights unique where models are collinear.
NUDGE = 1e-6


def weights_static(spark: SparkSession, weights: dict[str, float]) -> DataFrame:
    """(model, weight) normalised to sum to one."""
    total = float(sum(weights.values()))
    rows = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(w / total).alias("weight")) for m, w in weights.items()])
    return spark.range(1).select(F.inline(rows))


def normalised(weights: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    total = F.sum("weight").over(Window.partitionBy(*by))
    return weights.withColumn("weight", F.try_divide(F.col("weight"), total))


def restored_weights(stored: DataFrame, models: dict[str, float]) -> DataFrame:
    """Stored (model, weight) rows completed with default weights, then normalised."""
    rows = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(float(d)).alias("default")) for m, d in models.items()])
    wanted = stored.sparkSession.range(1).select(F.inline(rows))
    full = wanted.join(stored.select("model", "weight"), "model", "left")
    return normalised(full.select("model", F.coalesce("weight", "default").alias("weight")))


def weights_inverse_rmse(
    df: DataFrame,
    panel: Panel = NATIONAL,
    lookback: int = LOOKBACK,
    fallback: dict[str, float] | None = None,
    by: Iterable[str] = (),
) -> DataFrame:
    """Weights proportional to 1/RMSE over the last ``lookback`` rows of each group.

    Groups in which some series has fewer rows take the ``fallback`` weights (equal ones if not given).
    """
    by = list(by)
    inner = Panel(panel.order, tuple(dict.fromkeys([*by, "model", *panel.series])), panel.ties)
    recent = recent_rows(df, inner, lookback)
    e = F.col("y_true") - F.col("y_pred")
    per_series = recent.groupBy(*inner.series).agg(
        F.sum(e * e).alias("_sse"), F.count(e * e).alias("_n"), F.count(F.lit(1)).alias("_rows")
    )
    errors = per_series.groupBy(*by, "model").agg(
        F.greatest(F.sqrt(F.try_divide(F.sum("_sse"), F.sum("_n"))), F.lit(SMALLEST_ERROR)).alias("rmse"),
        F.min("_rows").alias("rows"),
    )
    group = Window.partitionBy(*by)
    inverse = 1 / F.col("rmse")
    if fallback:
        total = float(sum(fallback.values()))
        static = F.coalesce(
            F.try_element_at(
                F.create_map(*[x for m, w in fallback.items() for x in (F.lit(m), F.lit(w / total))]), F.col("model")
            ),
            F.lit(0.0),
        )
    else:
        static = 1 / F.count(F.lit(1)).over(group)
    enough = F.min("rows").over(group) >= lookback
    weight = F.when(enough, inverse / F.sum(inverse).over(group)).otherwise(static)
    return errors.select(*by, "model", weight.alias("weight"))


def align_predictions(df: DataFrame, models: list[str], panel: Panel = NATIONAL) -> DataFrame:
    """One row per date with a column per model; dates some model lacks are dropped."""
    side = [F.max(F.when(F.col("model") == m, F.col("y_pred"))).alias(m) for m in models]
    wide = df.filter(F.col("model").isin(*models)).groupBy(*panel.keys).agg(F.max("y_true").alias("y_true"), *side)
    return wide.na.drop(subset=models)


def ensemble_predict(
    df: DataFrame, weights: DataFrame, panel: Panel = NATIONAL, by: Iterable[str] = (), name: str = "ensemble"
) -> DataFrame:
    """Weighted sum per date over the dates that every weighted model predicts, in long form.

    Weighted models without any prediction are left aside; the others' weights stay as they are.
    """
    by = list(by)
    present = attach(weights, df.select(*by, "model").distinct(), [*by, "model"], "left_semi")
    needed = present.groupBy(*by).agg(F.count(F.lit(1)).alias("_models"))
    sized = attach(present, needed, by) if by else present.withColumn("_models", needed.scalar())
    joined = attach(df, sized, [*by, "model"])
    out = joined.groupBy(*panel.keys).agg(
        F.max("y_true").alias("y_true"),
        F.sum(F.col("weight") * F.col("y_pred")).alias("y_pred"),
        F.count(F.lit(1)).alias("_have"),
        F.max("_models").alias("_models"),
    )
    return out.filter("_have = _models").select(*panel.keys, F.lit(name).alias("model"), "y_true", "y_pred")


def ensemble_interval(df: DataFrame, panel: Panel = NATIONAL, confidence: float = 0.95) -> DataFrame:
    """Mean across models +/- z population standard deviations, the lower end at least zero."""
    z = 1.96 if confidence == 0.95 else 1.0
    out = df.groupBy(*panel.keys).agg(F.avg("y_pred").alias("mean"), F.stddev_pop("y_pred").alias("std"))
    lower = F.col("mean") - z * F.col("std")
    return out.withColumn("lower", F.when(lower < 0, 0.0).otherwise(lower)).withColumn("upper", F.col("mean") + z * F.col("std"))


def evaluate_models(df: DataFrame, weights: DataFrame, panel: Panel = NATIONAL) -> DataFrame:
    """Metrics of every model and of their weighted combination."""
    cols = [*panel.keys, "model", "y_true", "y_pred"]
    return metrics_all(df.select(*cols).unionByName(ensemble_predict(df, weights, panel).select(*cols)), ["model"], panel)


def weight_history(runs: DataFrame, run: str = "run", panel: Panel = NATIONAL, lookback: int = LOOKBACK) -> DataFrame:
    """(run, model, weight) for predictions tagged by run."""
    return weights_inverse_rmse(runs, panel, lookback, by=[run])


def _gram(df: DataFrame, models: list[str], panel: Panel, by: list[str]) -> DataFrame:
    """Per group: n, the sums of y and each x, and the sums of their products, as arrays."""
    wide = align_predictions(df, models, Panel(panel.order, tuple(dict.fromkeys([*by, *panel.series])), panel.ties))
    xs = ["y_true", *models]
    pairs = [(i, j) for i in range(len(xs)) for j in range(i, len(xs))]
    return wide.groupBy(*by).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.array(*[F.sum(x) for x in xs]).alias("s"),
        F.array(*[F.sum(F.col(xs[i]) * F.col(xs[j])) for i, j in pairs]).alias("g"),
    )


def _unpack(row, k: int) -> tuple[float, np.ndarray, np.ndarray]:
    g = np.zeros((k, k))
    g[np.triu_indices(k)] = row.g
    return row.n, np.asarray(row.s, float), g + np.triu(g, 1).T


def simplex_weights(gram: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """argmin of w'Gw - 2c'w + r w'w over w >= 0 with sum one, by an active set.

    The small r (NUDGE of G's mean diagonal) decides where models are collinear: of the weights that fit equally
    well, those nearest to equal ones.  Starts from equal weights; a step that would leave the simplex stops at
    its edge and fixes that weight at zero, and a fixed weight is freed while that lowers the error.
    """
    k = len(cross)
    scale = np.trace(gram) / k
    if scale <= 0:
        return np.full(k, 1 / k)
    g, c = gram / scale + NUDGE * np.eye(k), cross / scale
    w, free = np.full(k, 1 / k), np.ones(k, bool)
    for _ in range(50 * k):
        idx = np.flatnonzero(free)
        inverse = np.linalg.solve(g[np.ix_(idx, idx)], np.column_stack([c[idx], np.ones(len(idx))]))
        level = (inverse[:, 0].sum() - 1) / inverse[:, 1].sum()
        step = np.zeros(k)
        step[idx] = inverse[:, 0] - level * inverse[:, 1] - w[idx]
        short = np.flatnonzero(free & (w + step < 0))
        if len(short):
            reach = w[short] / -step[short]
            w = np.clip(w + reach.min() * step, 0, None)
            w[short[reach.argmin()]] = 0.0
            free[short[reach.argmin()]] = False
            continue
        w = w + step
        slope = g @ w - c + level  # zero on the free weights
        lowest = int(np.where(free, 0, slope).argmin())
        if free[lowest] or slope[lowest] > -1e-12:
            break
        free[lowest] = True
    return w


def _solve_rows(df: DataFrame, models: list[str], by: list[str], solve, terms: list[str], label: str) -> DataFrame:
    schema = StructType(
        [f for f in df.schema if f.name in by] + [StructField("model", StringType()), StructField(label, DoubleType())]
    )

    def run(batches):
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                values = solve(*_unpack(row, len(models) + 1))
                rows += [(*[getattr(row, b) for b in by], t, float(v)) for t, v in zip(terms, values)]
            yield pd.DataFrame(rows, columns=[f.name for f in schema])

    return df.mapInPandas(run, schema)


def weights_optimal(df: DataFrame, models: list[str], panel: Panel = NATIONAL, by: Iterable[str] = ()) -> DataFrame:
    """Non-negative weights summing to one that minimise RMSE, from one Gram row per group."""
    by = list(by)

    def solve(n, s, g):
        return simplex_weights(g[1:, 1:], g[1:, 0])

    return _solve_rows(_gram(df, models, panel, by), models, by, solve, models, "weight")


def choose_weights(
    df: DataFrame, static: dict[str, float], panel: Panel = NATIONAL, method: str = "dynamic", lookback: int = LOOKBACK
) -> DataFrame:
    """(model, weight) by one entry: ``dynamic`` weights by recent error, or the ``static`` ones where a series is shorter than
    ``lookback``; ``optimal`` ones over all rows; or the ``static`` ones as given.  Only the models of ``static`` take part."""
    if not static:
        raise ValueError("no models to weight")
    known = df.filter(F.col("model").isin(*static))
    if method == "dynamic":
        return weights_inverse_rmse(known, panel, lookback, fallback=static)
    if method == "optimal":
        return weights_optimal(known, list(static), panel)
    if method == "static":
        return weights_static(df.sparkSession, static)
    raise ValueError(f"unknown method {method!r}")


INTERCEPT = "(intercept)"


def stacking_fit(
    df: DataFrame, models: list[str], panel: Panel = NATIONAL, alpha: float = 1.0, by: Iterable[str] = ()
) -> DataFrame:
    """Ridge coefficients of the truth on the model predictions; the intercept is not penalised."""
    by = list(by)

    def solve(n, s, g):
        centred = g - np.outer(s, s) / n
        coef = np.linalg.solve(centred[1:, 1:] + alpha * np.eye(len(models)), centred[1:, 0])
        return [*coef, (s[0] - s[1:] @ coef) / n]

    return _solve_rows(_gram(df, models, panel, by), models, by, solve, [*models, INTERCEPT], "coefficient")


def stacking_predict(
    df: DataFrame, coefficients: DataFrame, panel: Panel = NATIONAL, name: str = "stacking"
) -> DataFrame:
    """Apply stacking coefficients to long predictions of the same models."""
    betas = coefficients.filter(F.col("model") != INTERCEPT)
    base = coefficients.filter(F.col("model") == INTERCEPT).select("coefficient").scalar()
    count = betas.agg(F.count(F.lit(1))).scalar()
    out = df.join(betas, "model").groupBy(*panel.keys).agg(
        F.max("y_true").alias("y_true"),
        F.sum(F.col("coefficient") * F.col("y_pred")).alias("_sum"),
        F.count(F.lit(1)).alias("_have"),
    )
    return (
        out.withColumn("_need", count)
        .withColumn("y_pred", F.col("_sum") + base)
        .filter("_have = _need")
        .select(*panel.keys, F.lit(name).alias("model"), "y_true", "y_pred")
    )


def stacking_with(df: DataFrame, models: list[str], meta_learner, panel: Panel = NATIONAL):
    """Fit any Spark ML regressor on the aligned predictions."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    wide = align_predictions(df, models, panel).withColumn("label", F.col("y_true"))
    return Pipeline(stages=[VectorAssembler(inputCols=models, outputCol="features"), meta_learner]).fit(wide)


def ensemble_report(weights: DataFrame, metrics: DataFrame, horizons: DataFrame) -> DataFrame:
    """Weights, metrics and horizon metrics as one long (section, model, name, value) table."""

    def melt(df: DataFrame, keys: list[str], section: str) -> DataFrame:
        values = [c for c in df.columns if c not in keys]
        long = df.select(*keys, *[F.col(v).cast("double") for v in values]).unpivot(keys, values, "name", "value")
        suffix = F.concat(F.col("name"), F.lit("@"), F.col("horizon").cast("string")) if "horizon" in keys else F.col("name")
        return long.select(F.lit(section).alias("section"), "model", suffix.alias("name"), "value")

    return (
        melt(weights, ["model"], "weights")
        .unionByName(melt(metrics, ["model"], "metrics"))
        .unionByName(melt(horizons, ["model", "horizon"], "horizons"))
    )
