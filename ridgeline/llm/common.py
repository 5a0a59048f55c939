"""Helpers shared by the corpus operators: stored tables, ranks, blocks of pairs, components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.functions.sizing import scratch_path

Batches = Iterator[pa.RecordBatch]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once as Parquet in the shared folder; columns are pruned when read."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def ranked(df: DataFrame, group: list[str], order: list[str], name: str, bucket_rows: int = 16384) -> DataFrame:
    """Add the 0-based rank of each row inside its group, gapless.

    The order is (hash bucket of ``order``, ``order``): a group is cut into buckets of about
    ``bucket_rows`` rows, the buckets are counted, and rows are numbered inside a bucket only, so
    no task holds a whole group.  Reads ``df`` three times: pass a stored table.  The result does
    not depend on the partitioning; rows equal in all ``order`` columns are interchangeable.
    """
    buckets = max(1, math.ceil(df.count() / bucket_rows))
    placed = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    keys = [*group, "_bucket"]
    sizes = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"),
    )
    inside = placed.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    match = reduce(lambda a, b: a & b, [same(F.col(k), F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return (
        inside.join(starts, match)
        .withColumn(name, F.col(name) + F.col("_start"))
        .drop("_bucket", "_start", *[f"_k{i}" for i in range(len(keys))])
    )


def cut_buckets(members: DataFrame, bucket: str, load: str, max_rows: int, max_load: int) -> DataFrame:
    """Adds ``chunks``, the pieces that each bucket of ``members`` is cut into, so that pairs can be compared a
    bounded piece at a time: 1 for a bucket within both limits.  Buckets of one row have no pairs and are
    left out.  Pass narrow rows (item, bucket, load); what is wide is joined afterwards."""
    sizes = (
        members.groupBy(F.col(bucket).alias("_b"))
        .agg(F.count(F.lit(1)).alias("_n"), F.sum(load).alias("_load"))
        .filter("_n > 1")
        .select("_b", F.ceil(F.greatest(F.col("_n") / max_rows, F.col("_load") / max_load)).alias("chunks"))
    )
    return members.join(sizes, F.col(bucket) == F.col("_b")).drop("_b")


def in_blocks(members: DataFrame, bucket: str, item: str) -> DataFrame:
    """Rows dealt to blocks (bucket, lo, hi), placed and sorted by them.

    Items fall by hash into the bucket's ``chunks``; block (lo, hi) holds the chunks lo and hi, so every
    pair of a bucket meets in exactly one block: as (chunk lo, chunk hi), or inside one when lo = hi.
    """
    return (
        members.withColumn("chunk", F.pmod(F.xxhash64(item), F.col("chunks")))
        .withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .withColumn("lo", F.least("chunk", "_j"))
        .withColumn("hi", F.greatest("chunk", "_j"))
        .drop("chunks", "_j")
        .repartition(bucket, "lo", "hi")
        .sortWithinPartitions(bucket, "lo", "hi")
    )


def whole_groups(batches: Batches, keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From batches sorted by integer keys: tables of whole groups, with each group's first row and the end."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        if held:
            last = held[-1]
            change[0] = any(last.column(k)[last.num_rows - 1].as_py() != c[0] for k, c in zip(keys, cols, strict=True))
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = np.flatnonzero(change)
        if not len(cuts):
            held.append(batch)
            continue
        end = int(cuts[-1])
        done = pa.Table.from_batches([*held, batch.slice(0, end)] if end else held)
        if done.num_rows:
            yield done, _bounds(done, keys)
        held = [batch.slice(end)]
    if held:
        done = pa.Table.from_batches(held)
        yield done, _bounds(done, keys)


def _bounds(rows: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(rows.num_rows, bool)
    change[0] = True
    for k in keys:
        c = rows.column(k).to_numpy()
        change[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(change), rows.num_rows)


def lists_of(rows: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A list column as (values, offsets)."""
    col = rows.column(name).combine_chunks()
    col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
    offsets = col.offsets.to_numpy()
    return col.values.to_numpy(zero_copy_only=False), offsets


def binaries_of(rows: pa.Table, name: str) -> list[bytes]:
    return rows.column(name).to_pylist()


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of all sets of two lists (of one list with itself), as products of
    incidence blocks over the shingles that occur in more than one set."""
    sets = left if right is None else [*left, *right]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = counts > 1
    column = np.cumsum(often) - 1
    keep = often[inverse]
    owner, column = owner[keep], column[inverse[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    n, total, width = len(sets), int(often.sum()), 2048
    k = len(left)
    out = np.zeros((k, n if right is None else n - k), np.float32)
    for at in range(0, total, width):
        a, b = np.searchsorted(column, [at, at + width])
        block = np.zeros((n, min(width, total - at)), np.float32)
        block[owner[a:b], column[a:b] - at] = 1
        out += block[:k] @ (block if right is None else block[k:]).T
    return out


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index joined to each of n indices by the edges a-b (a few rounds of minima)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if np.array_equal(new, root):
            break
        root = new
    return root


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the smallest node that the undirected edges (a, b) reach; nodes of edges only.

    Alternates large-star and small-star steps until no edge changes.  Every round is written to
    the shared folder; the driver sees one count and one checksum.
    """
    def mark(df: DataFrame) -> tuple:
        row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return row[0], row[1]

    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    seen = mark(now)
    while seen[0]:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("b > a").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        near = large.join(down, F.col("a") == F.col("u"))
        small = near.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(near.select("a", F.col("m").alias("b"))).distinct()
        now = stored(small, name)
        mine = mark(now)
        if mine == seen:
            break
        seen = mine
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
