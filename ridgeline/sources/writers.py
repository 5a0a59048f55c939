"""Stage outputs: tables, metrics, feature lists, weights and fitted models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions.sizing import estimated_bytes
from ridgeline.operators.ensemble import restored_weights
from ridgeline.sources.readers import path_exists


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


#: Bytes of a bucket, about, and the fewest buckets.
BUCKET_BYTES = 256 * 2**20
LEAST_BUCKETS = 64


def panel_buckets(df: DataFrame) -> int:
    """As many buckets as the planner's estimate of the frame's size asks for."""
    return max(LEAST_BUCKETS, -(-(estimated_bytes(df) or 0) // BUCKET_BYTES))


def write_panel(df: DataFrame, path: str, series: str, buckets: int | None = None) -> None:
    """Parquet partitioned by a hash bucket of the series key and sorted by date inside it."""
    count = buckets or panel_buckets(df)
    bucketed = df.withColumn("series_bucket", F.pmod(F.xxhash64(series), F.lit(count)).cast("int"))
    years = bucketed.repartition("series_bucket", F.year("date"))
    years.sortWithinPartitions(series, "date").write.mode("overwrite").partitionBy("series_bucket").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    write_table(df, path, "csv")


def write_json(df: DataFrame, path: str) -> None:
    """Long metrics, weights or feature lists as JSON lines."""
    df.write.mode("overwrite").json(path)


def write_feature_list(spark: SparkSession, names: list[str], path: str) -> None:
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("feature")) for i, n in enumerate(names)])
    write_json(spark.range(1).select(F.inline(rows)), path)


def write_weights_document(spark: SparkSession, path: str, weights: DataFrame, settings: dict, history: DataFrame | None = None) -> None:
    """Weights (model, weight), settings and past weights (run, model, weight) as JSON lines of one layout."""
    rows = weights.select(F.lit("weights").alias("section"), F.lit(None).cast("string").alias("key"), "model", F.col("weight").cast("double").alias("value"))
    told = F.array(*[F.struct(F.lit("settings").alias("section"), F.lit(k).alias("key"), F.lit(None).cast("string").alias("model"), F.lit(float(v)).alias("value")) for k, v in settings.items()])
    rows = rows.union(spark.range(1).select(F.inline(told))) if settings else rows
    if history is not None:
        rows = rows.union(history.select(F.lit("history"), F.col("run").cast("string"), "model", F.col("weight").cast("double")))
    write_json(rows, path)


def read_weights_document(spark: SparkSession, path: str) -> DataFrame:
    """(section, key, model, value): the weights, the settings by key, the past weights by run."""
    return spark.read.schema("section string, key string, model string, value double").json(path)


def read_weights(spark: SparkSession, path: str, defaults: dict[str, float]) -> DataFrame:
    """Stored weights, completed with defaults and normalised."""
    stored = spark.read.schema("model string, weight double").json(path)
    return restored_weights(stored, defaults)


def reuse_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read a stage's table when it was written to the end, otherwise build and store it first."""
    if not path_exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
