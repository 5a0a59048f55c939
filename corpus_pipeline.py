"""The corpus pipeline: each stage reads what the one before kept, as Parquet.

A stage takes (spark, docs, sf_dir) and returns the columns of documents, but for the last, which returns
the packed pieces.  Null texts count as empty, repeated rows as copies, and an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ridgeline.functions.sizing import scratch_path
from ridgeline.llm import chosen_path, line_quality, mixing, packing, secret_ledger
from ridgeline.llm.common import table
from ridgeline.llm.queries import vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def of_quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return line_quality.keep_good(docs, line_quality.train(docs, table(spark, folder, "labels")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each class of near duplicates stays, the one with the smallest id."""
    return chosen_path.one_of_each(docs, chosen_path.join(docs))


def without_secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Every document stays; what the ledger's scan finds in its text is replaced by a mark."""
    return secret_ledger.redact(docs, secret_ledger.update(docs.select("text")))


def mixed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Every document, whole, as often as the mix takes it; a copy taken in part stays if that is at least half."""
    return mixing.taken_copies(docs, mixing.mix(docs))


def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One row per piece of the sequences."""
    return packing.pack(docs, vocabulary())


STAGES: list[tuple[str, Stage]] = [
    ("quality", of_quality),
    ("near_duplicates", without_near_duplicates),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("packing", packed),
]

#: The learned classifier and the tokenizer have no SQL form; tests/llm/test_pipeline.py holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
