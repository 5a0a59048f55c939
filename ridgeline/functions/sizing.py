"""Size checks before a broadcast, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def broadcast_limit(spark: SparkSession) -> int:
    """The session's own broadcast threshold in bytes (-1 when broadcasts are off)."""
    raw = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760").strip().lower()
    units = {"kb": 2**10, "mb": 2**20, "gb": 2**30, "k": 2**10, "m": 2**20, "g": 2**30, "b": 1}
    for suffix, factor in units.items():
        if raw.endswith(suffix):
            return int(raw[: -len(suffix)]) * factor
    return int(raw)


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate, or None where the session does not expose the plan."""
    jdf = getattr(df, "_jdf", None)
    if jdf is None:
        return None
    return int(str(jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fits_broadcast(df: DataFrame) -> bool:
    size = estimated_bytes(df)
    return size is not None and size <= broadcast_limit(df.sparkSession)


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Hint a broadcast only for a frame whose estimate is below the session's threshold."""
    return F.broadcast(df) if fits_broadcast(df) else df


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only in local mode."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="ridgeline-checkpoint-")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder; the stored rows survive the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written once as Parquet in the shared folder; unlike a checkpoint's, their size is known to the planner."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
