"""Registered queries: name -> (Spark function of (spark, folder), SQL twin or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ridgeline.functions.numeric import float_columns, quoted

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Entry(fn, sql)
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded so that the order of additions does not show."""
    cols = set(float_columns(df))
    return df.selectExpr(*[f"round({quoted(c)}, {digits}) AS {quoted(c)}" if c in cols else quoted(c) for c in df.columns])


def load() -> dict[str, Entry]:
    from ridgeline.plans.catalog import (  # noqa: F401
        cleaning, combining, exploring, feature_sets, forecasting, merging, reshaping, scoring, splitting,
    )

    return REGISTRY
