"""Embedding near-duplicates by a forest of random-projection trees with spill.

Equal vectors of one label are one class from the start; classes are unit vectors that the trees
split.  A node projects on a random direction and splits at the median of a bounded sample; a vector
within ``SPILL`` of the split goes to both sides, so a close pair is parted only when it straddles the
whole band.  Several trees with other directions make that rare.  Inside each leaf (per label) all
pairs are compared in blocks of bounded size; cosine in double precision decides.  A pair that meets in
several leaves counts in the smallest of them only, so links are counted without listing the pairs of
a group, and each block hands on no more edges than it has classes.

The trees (directions and split values, a few hundred kilobytes) are fitted on the driver on at most
``SAMPLE`` vectors; every row is then placed by them.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, rows without
a label and rows without an id link with nothing; vectors of different lengths never link, each length has a forest of its own;
repeated rows are rows of the same class and count in n_links; a null vec_id is its own class
(component_id null, kept true); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import Batches, components, cut_buckets, in_blocks, lists_of, local_roots, overlaps, stored, whole_groups

COSINE = 0.98
TREES = 6
SPILL = 0.03
LEAF = 256
#: Vectors that the trees are fitted on, by hash order (a documented bound).
SAMPLE = 16_384
DEEPEST = 16
BLOCK_ROWS = 1024
SEED = 7


@dataclass(frozen=True)
class Tree:
    """A complete binary tree: node i has children 2i+1 and 2i+2; direction by level and node."""

    depth: int
    directions: np.ndarray
    cuts: np.ndarray


def usable(vectors: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose vector can be compared, with it as doubles (``v``)."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(*columns, v.alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0))
    return rows.filter(finite & F.exists("v", lambda x: x != 0))


def of_each_length(rows: DataFrame) -> list[DataFrame]:
    """The rows by the length of ``v``: only vectors of one length can be compared."""
    lengths = rows.select(F.size("v").alias("d")).distinct().collect()  # one number per length
    return [rows.filter(F.size("v") == r["d"]) for r in sorted(lengths)]


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows divided by their length; scaled first, so that no square over- or underflows."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def grow(sample: np.ndarray, depth: int, seed: int) -> Tree:
    """A tree on unit vectors: random directions, cuts at the medians of what reaches each node."""
    rng = np.random.default_rng(seed)
    nodes = 2**depth - 1
    directions = rng.standard_normal((max(nodes, 1), sample.shape[1]))
    directions /= np.linalg.norm(directions, axis=1, keepdims=True)
    cuts = np.zeros(max(nodes, 1))
    at = np.zeros(len(sample), np.int64)
    for level in range(depth):
        first = 2**level - 1
        height = (sample * directions[at]).sum(axis=1)
        order = np.lexsort((height, at))
        for node, rows in zip(*_runs(at[order], order), strict=True):
            cuts[node] = float(np.median(height[rows]))
        at = 2 * at + 1 + (height >= cuts[at])
        # A node that no sample reaches splits at 0.
        assert at.min() >= first  # noqa: S101
    return Tree(depth, directions, cuts)


def _runs(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    values, starts = np.unique(keys, return_index=True)
    return values, np.split(rows, starts[1:])


def descend(tree: Tree, vectors: np.ndarray, spill: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf): every leaf that each vector reaches, spilling over near a cut."""
    row, at = np.arange(len(vectors)), np.zeros(len(vectors), np.int64)
    for _ in range(tree.depth):
        gap = (vectors[row] * tree.directions[at]).sum(axis=1) - tree.cuts[at]
        left, right = gap < spill, gap >= -spill
        row = np.concatenate([row[left], row[right]])
        at = np.concatenate([2 * at[left] + 1, 2 * at[right] + 2])
    return row, at - (2**tree.depth - 1)


def forest(sample: np.ndarray, rows: int, trees: int = TREES, leaf: int = LEAF) -> list[Tree]:
    depth = min(DEEPEST, max(0, math.ceil(math.log2(max(rows, 1) / leaf))), max(0, int(math.log2(max(len(sample), 1)))))
    return [grow(sample, depth, SEED + t) for t in range(trees)]


def _placer(trees: list[Tree], spill: float):  # noqa: ANN202
    def run(batches: Batches) -> Batches:
        for batch in batches:
            if not batch.num_rows:
                continue
            values, offsets = lists_of(pa.Table.from_batches([batch]), "u")
            vectors = values[offsets[0] : offsets[-1]].reshape(batch.num_rows, -1)
            found = [descend(t, vectors, spill) for t in trees]
            row = np.concatenate([r for r, _ in found])
            leaf = np.concatenate([(k << 48) + at for k, (_, at) in enumerate(found)])
            pick = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column("class").take(pick), batch.column("label").take(pick), pa.array(leaf)], names=["class", "label", "leaf"])

    return run


LINKS = "class long, links long, root long"


def _compare(least: float):  # noqa: ANN202
    def run(batches: Batches) -> Batches:
        for rows, cuts in whole_groups(batches, ["bucket", "lo", "hi"]):
            ids, docs = rows.column("class").to_numpy(), rows.column("docs").to_numpy()
            bucket, chunk, lo, hi = (rows.column(c).to_numpy() for c in ("bucket", "chunk", "lo", "hi"))
            values, offsets = lists_of(rows, "u")
            homes, home_at = lists_of(rows, "homes")
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                u = values[offsets[a] : offsets[b]].reshape(b - a, -1)
                left, right = np.flatnonzero(chunk[a:b] == lo[a]), np.flatnonzero(chunk[a:b] == hi[a])
                near = u[left] @ u[right].T >= least
                if lo[a] == hi[a]:
                    near = np.triu(near, 1)
                x, y = np.nonzero(near)
                if not len(x):
                    continue
                # A pair that shares a smaller leaf is counted there.
                smaller = [[h[h < bucket[a]] for h in (homes[home_at[a + i] : home_at[a + i + 1]] for i in side)] for side in (left, right)]
                first = overlaps(smaller[0], None if lo[a] == hi[a] else smaller[1])[x, y] == 0
                x, y = left[x], right[y]
                linked = np.zeros(b - a, np.int64)
                np.add.at(linked, x[first], docs[a + y[first]])
                np.add.at(linked, y[first], docs[a + x[first]])
                root = local_roots(b - a, x, y)
                some = np.unique(np.concatenate([x, y]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[a + some]), pa.array(linked[some]), pa.array(ids[a + root[some]])], names=["class", "links", "root"])

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, trees: int = TREES, spill: float = SPILL) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    ok = usable(vectors.filter(F.col("label").isNotNull() & F.col("vec_id").isNotNull()), ["vec_id", "label"])
    # The exact values are the key: equal vectors of a label are one class, named by its smallest id and hash.
    keyed = stored(ok.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.array_join("v", ",").alias("key"), "v"), "vectors")
    # The rows that took no part, by the same test the compared ones passed.
    alone = _left_out(vectors).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    every = reduce(DataFrame.union, [_linked(rows, cosine, trees, spill) for rows in of_each_length(keyed)], alone)
    return every.select("vec_id", "n_links", "component_id", (F.col("vec_id").eqNullSafe(F.col("component_id"))).alias("kept"))


def _linked(keyed: DataFrame, cosine: float, trees: int, spill: float) -> DataFrame:
    """vec_id, n_links and component_id of vectors of one length."""
    first = keyed.groupBy("label", "key").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("docs"), F.first("v").alias("v"))
    classes = stored(first.select(F.xxhash64("label", "key").alias("class"), "label", "key", "low", "docs", F.transform("v", lambda x: x / F.array_max(F.transform("v", F.abs))).alias("w")).select(
        "class", "label", "key", "low", "docs",
        F.transform("w", lambda x: x / F.sqrt(F.aggregate("w", F.lit(0.0), lambda s, y: s + y * y))).alias("u"),
    ), "classes")
    n = classes.count()
    sample = np.array([r["u"] for r in classes.select("u", "class").orderBy("class").limit(SAMPLE).collect()], np.float64)
    grown = forest(sample, n, trees)
    leaves = classes.select("class", "label", "u").mapInArrow(_placer(grown, spill), "class long, label long, leaf long")
    placed = stored(leaves.select("class", F.xxhash64("label", "leaf").alias("bucket")), "leaves")
    # Leaves of one class have no pairs: they leave before the vectors move.
    shared = placed.groupBy(F.col("bucket").alias("b")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("b")
    met = placed.join(shared, F.col("bucket") == F.col("b"), "left_semi")
    homes = met.groupBy(F.col("class").alias("c")).agg(F.sort_array(F.collect_set("bucket")).alias("homes"))
    full = homes.join(classes.select(F.col("class").alias("k"), "docs", "u"), F.col("c") == F.col("k")).select("c", "homes", "docs", "u")
    cut = cut_buckets(placed.distinct().withColumn("one", F.lit(1)), "bucket", "one", BLOCK_ROWS, 2**62).drop("one")
    members = in_blocks(cut.join(full, F.col("class") == F.col("c")).drop("c"), "bucket", "class")
    found = stored(members.mapInArrow(_compare(cosine), LINKS), "links")
    joined = components(found.select(F.col("class").alias("a"), F.col("root").alias("b")))
    return _rows(keyed, classes, found, joined)


def _rows(keyed: DataFrame, classes: DataFrame, found: DataFrame, joined: DataFrame) -> DataFrame:
    links = found.groupBy(F.col("class").alias("l")).agg(F.sum("links").alias("links"))
    table = classes.select("class", "low", "docs").join(links, F.col("class") == F.col("l"), "left").join(joined, F.col("class") == F.col("node"), "left")
    table = stored(table.select("class", "low", (F.col("docs") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "class").alias("component")), "table")
    lowest = table.groupBy(F.col("component").alias("c")).agg(F.min("low").alias("component_id"))
    of_class = table.join(lowest, F.col("component") == F.col("c")).select(F.col("class").alias("t"), "n_links", "component_id")
    return keyed.select("vec_id", F.xxhash64("label", "key").alias("class")).join(of_class, F.col("class") == F.col("t")).select("vec_id", "n_links", "component_id")


def _left_out(vectors: DataFrame) -> DataFrame:
    """Rows that cannot be compared."""
    v = F.col("embedding").cast("array<double>")
    fine = (
        F.col("label").isNotNull() & F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    )
    return vectors.filter(~F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"))
