"""Forecasters on Spark ML: boosted trees, a staged random search and windowed sequences."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.sizing import written
from ridgeline.operators.features import min_max_scale, sequences
from ridgeline.panel import NATIONAL, Panel


@dataclass(frozen=True)
class BoostedTrees:
    """Boosted regression trees; names follow the usual gradient-boosting vocabulary."""

    n_estimators: int = 500
    max_depth: int = 6
    learning_rate: float = 0.1
    subsample: float = 0.8
    colsample: float = 0.8
    min_child_weight: int = 3
    gamma: float = 0.0
    tolerance: float = 0.01
    seed: int = 42
    features: tuple[str, ...] = field(default=())
    target: str = "new_cases"

    def trees(self, validation_col: str | None = None) -> GBTRegressor:
        trees = GBTRegressor(
            featuresCol="features",
            labelCol="label",
            predictionCol="y_pred",
            maxIter=self.n_estimators,
            maxDepth=self.max_depth,
            stepSize=self.learning_rate,
            subsamplingRate=self.subsample,
            featureSubsetStrategy="all" if self.colsample >= 1 else str(self.colsample),
            minInstancesPerNode=self.min_child_weight,
            minInfoGain=self.gamma,
            validationTol=self.tolerance,
            seed=self.seed,
        )
        return trees.setValidationIndicatorCol(validation_col) if validation_col else trees

    def vectors(self) -> VectorAssembler:
        return VectorAssembler(inputCols=list(self.features), outputCol="features", handleInvalid="skip")

    def labelled(self, df: DataFrame) -> DataFrame:
        return df.withColumn("label", F.col(self.target).cast("double"))

    def fit(self, train: DataFrame, validation: DataFrame | None = None) -> PipelineModel:
        """Fit; with a validation frame, boosting stops when its error stops improving."""
        labelled = self.labelled(train)
        if validation is None:
            return Pipeline(stages=[self.vectors(), self.trees()]).fit(few_parts(labelled))
        both = labelled.withColumn("_held", F.lit(False)).unionByName(self.labelled(validation).withColumn("_held", F.lit(True)))
        return Pipeline(stages=[self.vectors(), self.trees("_held")]).fit(few_parts(both))


#: Rows that one task of a tree's passes takes; a frame of fewer rows is trained in one.
ROWS_PER_TASK = 50_000


def few_parts(df: DataFrame) -> DataFrame:
    """The rows in as many partitions as their number asks for: boosting is thousands of small passes, whose cost on a
    small frame is the number of tasks."""
    parts = max(1, -(-df.count() // ROWS_PER_TASK))
    return df if parts >= df.sparkSession.sparkContext.defaultParallelism else df.coalesce(parts)


def predict(model: PipelineModel, df: DataFrame, panel: Panel = NATIONAL, target: str = "new_cases", name: str = "boosted") -> DataFrame:
    """Predictions in long form (series, date, model, y_true, y_pred)."""
    scored = model.transform(df)
    return scored.select(*panel.keys, F.lit(name).alias("model"), F.col(target).cast("double").alias("y_true"), "y_pred")


def feature_importance(model: PipelineModel, df: DataFrame) -> DataFrame:
    """(feature, importance) in descending order."""
    names = model.stages[0].getInputCols()
    values = model.stages[-1].featureImportances.toArray()
    rows = F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(float(v)).alias("importance")) for n, v in zip(names, values)])
    table = df.sparkSession.range(1).select(F.inline(rows))
    return table.orderBy(F.col("importance").desc(), "feature")


# Search ranges as (low, high, kind).
SEARCH_SPACE = {
    "max_depth": (3, 10, "int"),
    "learning_rate": (0.01, 0.3, "log"),
    "n_estimators": (100, 1000, "int"),
    "subsample": (0.5, 1.0, "uniform"),
    "colsample": (0.5, 1.0, "uniform"),
    "min_child_weight": (1, 10, "int"),
    "gamma": (1e-8, 1.0, "log"),
}


def draw(space: dict[str, tuple], rng: np.random.Generator) -> dict[str, float]:
    out = {}
    for name, (low, high, kind) in space.items():
        if kind == "int":
            out[name] = int(rng.integers(low, high + 1))
        elif kind == "log":
            out[name] = float(np.exp(rng.uniform(np.log(low), np.log(high))))
        else:
            out[name] = float(rng.uniform(low, high))
    return out


@dataclass
class Trial:
    """One draw of a search: its parameters, the best validation error so far and the number of trees that reached it."""

    number: int
    params: dict[str, float]
    loss: float = float("inf")
    trees: int = 0
    grown: int = 0
    rung: int = 0
    ended: bool = False

    def learn(self, losses: list[float], rung: int, patience: int) -> None:
        """Take in the errors after each tree of a fit.  The trial has ended where all its trees are grown or the
        error has not improved for ``patience`` trees."""
        best = int(np.argmin(losses))
        self.loss, self.trees, self.grown, self.rung = float(losses[best]), best + 1, len(losses), rung
        self.ended = self.grown >= self.params["n_estimators"] or self.grown - self.trees >= patience


def random_search(
    train: DataFrame,
    validation: DataFrame,
    base: BoostedTrees,
    n_trials: int = 20,
    space: dict[str, tuple] | None = None,
    parallelism: int = 8,
    objective: Callable[[DataFrame], float] | None = None,
    seed: int = 42,
    first_trees: int = 16,
    keep: float = 1 / 3,
    patience: int = 20,
) -> tuple[DataFrame, BoostedTrees]:
    """Random parameter draws, fitted on the training rows in rungs of more and more trees; the lowest validation error wins.

    A fit is scored after every one of its trees, so one fit tells how many trees its draw needs.  The first rung grows
    ``first_trees``; the best share ``keep`` of the trials goes on with 1 / ``keep`` times as many, until
    each has grown all its trees or not improved for ``patience`` trees.  Features are assembled and stored once.

    Returns the table of trials (trial, loss, trees, grown, rung, params) and the best parameters, with that
    number of trees.  ``objective`` maps predictions (y_true, y_pred) to the number to minimise; RMSE by default.
    It is then asked once per fit, about all its trees.
    """
    rng = np.random.default_rng(seed)
    trials = [Trial(i, {"n_estimators": base.n_estimators, **draw(space or SEARCH_SPACE, rng)}) for i in range(n_trials)]
    assembled = [
        few_parts(written(base.vectors().transform(base.labelled(df)).select("features", "label"), "search")).persist()
        for df in (train, validation)
    ]

    def grow(trial: Trial, trees: int, rung: int) -> None:
        wanted = min(trees, int(trial.params["n_estimators"]))
        model = replace(base, **{**trial.params, "n_estimators": wanted}).trees().fit(assembled[0])
        if objective is None:
            losses = [float(np.sqrt(v)) for v in model.evaluateEachIteration(assembled[1], "squared")]
        else:
            worst = [float("inf")] * (model.getNumTrees - 1)
            losses = [*worst, float(objective(model.transform(assembled[1]).withColumnRenamed("label", "y_true")))]
        trial.learn(losses, rung, patience)

    alive, trees, rung = trials, first_trees, 0
    with ThreadPool(parallelism) as pool:
        while alive:
            pool.map(lambda t: grow(t, trees, rung), alive)
            first = sorted((t for t in trials if t.rung == rung or t.ended), key=lambda t: (t.loss, t.number))
            alive = [t for t in first[: math.ceil(keep * len(first))] if not t.ended]
            trees, rung = math.ceil(trees / keep), rung + 1
    for frame in assembled:
        frame.unpersist()
    rows = [(t.number, t.loss, t.trees, t.grown, t.rung, {k: float(v) for k, v in t.params.items()}) for t in trials]
    table = train.sparkSession.createDataFrame(rows, "trial int, loss double, trees int, grown int, rung int, params map<string,double>")
    best = min(trials, key=lambda t: (t.loss, t.number))
    return table, replace(base, **{**best.params, "n_estimators": best.trees})


def sequence_forecast(
    split: DataFrame,
    cols: list[str],
    panel: Panel = NATIONAL,
    target: str = "new_cases",
    length: int = 14,
    estimator=None,
    name: str = "sequence",
) -> DataFrame:
    """Regress the target on scaled, flattened blocks of ``length`` rows; test predictions.

    ``split`` carries ``role``; scaling bounds come from the training rows only and blocks
    never cross a role boundary.
    """
    scaled = min_max_scale(split, cols, fit_on=F.col("role") == "train")
    blocks = sequences(scaled, cols, target, panel.with_series("role"), length)
    flat = blocks.withColumn("features", array_to_vector(F.flatten("sequence"))).withColumn(
        "label", F.col("sequence_target").cast("double")
    )
    learner = estimator or LinearRegression(regParam=0.1, elasticNetParam=0.0)
    model = learner.fit(flat.filter("role = 'train'"))
    scored = model.transform(flat.filter("role = 'test'"))
    return scored.select(*panel.keys, F.lit(name).alias("model"), F.col("label").alias("y_true"), F.col("prediction").alias("y_pred"))
