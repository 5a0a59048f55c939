"""Approximate nearest neighbours by balanced posting lists.

Centroids come from halving a bounded sample again and again at the median of its two-means direction,
so every list gets its even share.  Each vector is posted to its nearest centroid, its home, and a boundary
vector also to further ones almost as near (closure by distance ratio, near the plane between the two),
unless such a centroid all but coincides with one already chosen.  A query walks an in-memory neighbour
graph over the centroids, and the lists met whose centroid is within a distance ratio of the nearest are
searched first, never fewer than hold ten candidates.  Every other list is searched too unless its centroid
is farther away, by more than the list's radius, than the tenth neighbour found: the result is exact, and
the ratio, the walk and the replicas decide only how soon the limit is tight.
Lists are compared in blocks: a list or a set of queries that is too large is dealt into chunks, so no
task holds a hot list whole, and each block hands on ten rows a query at most.

The index on the driver is the centroids (``MAX_LISTS`` at most) and their graph; every row is posted.

Defined results: vectors that are null, empty, zero or hold null or non-finite components and rows without
an id take no part; vectors of different lengths are not compared, each length is searched apart; repeated ids are candidates
once each with their nearest vector; ties go to the smaller id; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import Batches, lists_of, stored, whole_groups
from ridgeline.llm.tree_forest import of_each_length, usable

#: Vectors that the centroids are fitted on, by hash order (a documented bound), and centroids at most.
SAMPLE = 65_536
MAX_LISTS = 4096
LIST_ROWS = 256
REPLICAS = 4
CLOSURE = 0.15
RATIO = 0.35
NEIGHBOURS = 24
#: Width of the walk that chooses the lists searched first; the lists it does not meet are left to the second pass.
BEAM = 96
TOP = 10
BLOCK_ROWS = 2048
#: Vectors of the neighbouring lists that the second pass compares in one block.
REST_ROWS = 4096


@dataclass(frozen=True)
class Index:
    centroids: np.ndarray
    graph: np.ndarray  # neighbours of each centroid
    entries: np.ndarray  # where walks start


def halved(sample: np.ndarray, lists: int) -> np.ndarray:
    """Centroids of a balanced tree of halves, then a few rounds of means that keep them."""
    parts = [np.arange(len(sample))]
    while len(parts) < lists and len(parts[0]) >= 2:
        new = []
        for rows in parts:
            x = sample[rows]
            a, b = x[0], x[np.argmax(((x - x[0]) ** 2).sum(axis=1))]
            for _ in range(4):
                side = ((x - a) ** 2).sum(axis=1) - ((x - b) ** 2).sum(axis=1)
                order = np.argsort(side, kind="stable")
                half = len(rows) // 2
                a, b = x[order[:half]].mean(axis=0), x[order[half:]].mean(axis=0)
            new += [rows[order[:half]], rows[order[half:]]]
        parts = sorted(new, key=lambda r: -len(r))
    return np.stack([sample[rows].mean(axis=0) for rows in parts])


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centroids (used to choose lists, not for results)."""
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)[None], 0)


def build(sample: np.ndarray, rows: int) -> Index:
    lists = min(MAX_LISTS, max(1, 2 ** round(math.log2(max(1, rows / LIST_ROWS)))))
    c = halved(sample, lists)
    k = min(NEIGHBOURS, len(c) - 1)
    graph = np.zeros((len(c), 0), np.int64)
    if k > 0:
        near = []
        for at in range(0, len(c), 1024):
            d = distances(c[at : at + 1024], c)
            d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
            near.append(np.argpartition(d, k - 1, axis=1)[:, :k])
        # A few far links keep the graph in one piece.
        rng = np.random.default_rng(11)
        graph = np.concatenate([np.concatenate(near), rng.integers(0, len(c), (len(c), 4))], axis=1)
    entries = np.unique(np.linspace(0, len(c) - 1, min(len(c), 16)).astype(np.int64))
    return Index(c, graph, entries)


def walk(index: Index, queries: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroids met by a best-first walk of the graph: (ids, squared distances), nearest first.

    All queries step together: each expands its nearest centroid not yet expanded until all ``beam``
    nearest ones are.
    """
    c, n, size = index.centroids, len(queries), min(beam, len(index.centroids))
    seen = np.zeros((n, len(c)), bool)
    d = distances(queries, c[index.entries])
    ids = np.full((n, size), -1)
    dist = np.full((n, size), np.inf)
    open_ = np.zeros((n, size), bool)
    first = np.argsort(d, axis=1)[:, :size]
    k = first.shape[1]
    ids[:, :k], dist[:, :k], open_[:, :k] = index.entries[first], np.take_along_axis(d, first, 1), True
    seen[:, index.entries] = True
    rows = np.arange(n)
    while index.graph.shape[1] and (active := open_.any(axis=1)).any():
        who = rows[active]
        best = np.where(open_[who], dist[who], np.inf).argmin(axis=1)
        open_[who, best] = False
        near = index.graph[ids[who, best]]
        fresh = ~seen[who[:, None], near]
        seen[who[:, None], near] = True
        nd = ((c[near] - queries[who][:, None, :]) ** 2).sum(axis=2)
        # The same neighbour twice in a row of the graph counts once.
        order = np.argsort(near, axis=1, kind="stable")
        ranked = np.take_along_axis(near, order, 1)
        twice = np.zeros_like(fresh)
        np.put_along_axis(twice, order[:, 1:], ranked[:, 1:] == ranked[:, :-1], 1)
        nd = np.where(fresh & ~twice, nd, np.inf)
        all_ids = np.concatenate([ids[who], near], axis=1)
        all_d = np.concatenate([dist[who], nd], axis=1)
        all_o = np.concatenate([open_[who], np.isfinite(nd)], axis=1)
        keep = np.argsort(all_d, axis=1, kind="stable")[:, :size]
        ids[who], dist[who], open_[who] = (np.take_along_axis(x, keep, 1) for x in (all_ids, all_d, all_o))
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    values, offsets = lists_of(pa.Table.from_batches([batch]), "v")
    return values[offsets[0] : offsets[-1]].reshape(batch.num_rows, -1)


def _poster(index: Index):  # noqa: ANN202
    """Each vector to the lists it is posted in; the first is its home."""
    c = index.centroids
    between = distances(c, c)

    def run(batches: Batches) -> Batches:
        k = min(REPLICAS, len(c))
        for batch in batches:
            if not batch.num_rows:
                continue
            out_row, out_list, out_home, out_far = [], [], [], []
            x = _vectors(batch)
            for at in range(0, len(x), 512):
                d = distances(x[at : at + 512], c)
                near = np.argpartition(d, k - 1, axis=1)[:, :k]
                near = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1)
                dist = np.take_along_axis(d, near, 1)
                take = dist <= (1 + CLOSURE) ** 2 * dist[:, :1]
                for j in range(1, k):
                    # Near the plane half way between home and the other centroid, by their distance.
                    take[:, j] &= dist[:, j] - dist[:, 0] <= 2 * CLOSURE * between[near[:, 0], near[:, j]]
                    for i in range(j):
                        take[:, j] &= ~(take[:, i] & (between[near[:, i], near[:, j]] < CLOSURE**2 * dist[:, j]))
                take[:, 0] = True
                row, slot = np.nonzero(take)
                out_row.append(at + row)
                out_list.append(near[row, slot])
                out_home.append(slot == 0)
                out_far.append(np.sqrt(((x[at + row] - c[near[row, slot]]) ** 2).sum(axis=1)))
            pick = pa.array(np.concatenate(out_row))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pick), batch.column("v").take(pick), pa.array(np.concatenate(out_list).astype(np.int64)), pa.array(np.concatenate(out_home)), pa.array(np.concatenate(out_far))],
                names=["vec_id", "v", "list", "home", "far"],
            )

    return run


def _prober(index: Index, held: np.ndarray, top: int):  # noqa: ANN202
    """Each query with the lists it searches first.  held: the vectors at home in each list."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch)
            lists: list[np.ndarray] = []
            for at in range(0, len(x), 256):
                ids, d = walk(index, x[at : at + 256])
                keep = d <= (1 + RATIO) ** 2 * d[:, :1]
                have = np.cumsum(np.where(ids >= 0, held[ids], 0), axis=1)
                # A list before which fewer than top candidates and the query itself were held is searched too.
                keep |= (have - held[ids]) < top + 1
                keep &= np.isfinite(d)
                # Where the walk met too few vectors, the query searches every list.
                lists += [np.arange(len(held)) if few else row[k] for row, k, few in zip(ids, keep, have[:, -1] < top + 1, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), _arrays(lists)], names=["vec_id", "v", "lists"])

    return run


def _arrays(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(rows).astype(np.int64)))


def _rest(index: Index, held: np.ndarray, radius: np.ndarray, group: np.ndarray):  # noqa: ANN202
    """Each query with the groups of lists that the first pass left out and that may hold a vector within its limit.

    A vector at home in a list is at most the list's radius from its centroid, so none is nearer to the
    query than the centroid's distance less the radius.
    """
    c = index.centroids

    def run(batches: Batches) -> Batches:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, limit = _vectors(batch), batch.column("limit").to_numpy()
            searched, cuts = lists_of(pa.Table.from_batches([batch]), "lists")
            groups = []
            for i in range(len(x)):
                d = np.sqrt(((c - x[i]) ** 2).sum(axis=1))
                # Rounding, or a distance that is no number, rules no list out.
                open_ = ~(d - radius > limit[i] + 1e-9 * (d + radius)) & (held > 0)
                open_[searched[cuts[i] : cuts[i + 1]]] = False
                groups.append(np.unique(group[open_]))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), batch.column("limit"), _arrays(groups)], names=["vec_id", "v", "limit", "lists"])

    return run


def _search(top: int):  # noqa: ANN202
    """Per block: each query's nearest vectors of the list chunk within its limit, exactly."""

    def run(batches: Batches) -> Batches:
        for rows, cuts in whole_groups(batches, ["list", "part", "deal"]):
            ids, limits = rows.column("vec_id").to_numpy(), rows.column("limit").to_numpy()
            asks = limits >= 0
            values, offsets = lists_of(rows, "v")
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                q, p = a + np.flatnonzero(asks[a:b]), a + np.flatnonzero(~asks[a:b])
                if not len(q) or not len(p):
                    continue
                dim = (offsets[b] - offsets[a]) // (b - a)
                x = values[offsets[a] : offsets[b]].reshape(b - a, dim)
                posted, names = x[p - a], ids[p]
                distinct = len(np.unique(names)) == len(names)
                norms = (posted * posted).sum(axis=1)
                for at in range(0, len(q), 32):
                    some = q[at : at + 32]
                    # A product rules out what is beyond the limit by more than its rounding; the rest is measured.
                    rough = distances(x[some - a], posted)
                    for k, row in enumerate(some):
                        asked = x[row - a]
                        maybe = np.flatnonzero(~(rough[k] > limits[row] ** 2 + 1e-9 * (norms + asked @ asked)) & (names != ids[row]))
                        d = np.sqrt(((asked - posted[maybe]) ** 2).sum(axis=1))
                        near = np.isfinite(d) & (d <= limits[row])
                        maybe, d = maybe[near], d[near]
                        order = np.lexsort((names[maybe], d))
                        if not distinct:
                            order = order[np.sort(np.unique(names[maybe[order]], return_index=True)[1])]
                        order = order[:top]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.repeat(ids[row], len(order))), pa.array(names[maybe[order]]), pa.array(d[order])], names=["query_id", "vec_id", "score"]
                        )

    return run


def _compared(posted: DataFrame, asked: DataFrame, sizes: dict[int, int], block: int, top: int) -> DataFrame:
    """query_id, vec_id and score of the nearest vectors in every list that a query asks.

    posted: vec_id, v and list, of the given sizes; asked: vec_id, v, limit and lists.
    """
    spark = posted.sparkSession
    asks = asked.select("vec_id", "v", "limit", F.explode("lists").alias("list"))
    wanted = asks.groupBy("list").count().collect()  # MAX_LISTS rows at most
    shape = [(r["list"], -(-sizes[r["list"]] // block), -(-r["count"] // BLOCK_ROWS)) for r in wanted if sizes.get(r["list"])]
    shape = F.broadcast(spark.createDataFrame(shape, "of long, parts long, deals long"))  # MAX_LISTS rows at most
    p = posted.join(shape, F.col("list") == F.col("of")).select(
        "vec_id", "v", F.lit(-1.0).alias("limit"), "list", F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")).alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)).alias("deal")
    )
    q = asks.join(shape, F.col("list") == F.col("of")).select(
        "vec_id", "v", "limit", "list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("vec_id"), F.col("deals")).alias("deal")
    )
    both = p.union(q).repartition("list", "part", "deal").sortWithinPartitions("list", "part", "deal")
    return both.mapInArrow(_search(top), "query_id long, vec_id long, score double")


def _best(near: DataFrame, top: int) -> DataFrame:
    # A vector in several lists, or an id with several vectors, is one candidate.
    once = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id and score of each query's nearest vectors.  queries: rows of the same table.  Each length of
    vectors has an index of its own."""
    rows = stored(usable(vectors.filter(F.col("vec_id").isNotNull()), ["vec_id"]).withColumn("vec_id", F.col("vec_id").cast("long")), "vectors")
    wanted = queries.select(F.col("vec_id").cast("long").alias("q")).distinct()
    found = [_nearest(mine, mine.join(wanted, F.col("vec_id") == F.col("q"), "left_semi"), top) for mine in of_each_length(rows)]
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # An id with vectors of several lengths is one query.
    return found[0] if len(found) == 1 else _best(reduce(DataFrame.union, found).select("query_id", "vec_id", "score"), top)


def _nearest(rows: DataFrame, asked: DataFrame, top: int) -> DataFrame:
    """The search among the stored vectors (vec_id, v) of one length."""
    spark, n = rows.sparkSession, rows.count()
    sample = np.array([r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()], np.float64)
    index = build(sample, n)
    posted = stored(rows.mapInArrow(_poster(index), "vec_id long, v array<double>, list long, home boolean, far double"), "postings")
    held, radius = np.zeros(len(index.centroids), np.int64), np.zeros(len(index.centroids))
    at_home = F.when(F.col("home"), F.col("far"))
    sizes = posted.groupBy("list").agg(F.sum(F.col("home").cast("long")).alias("home"), F.max(at_home).alias("radius"), F.count(F.lit(1)).alias("n")).collect()  # MAX_LISTS rows at most
    for r in sizes:
        held[r["list"]], radius[r["list"]] = r["home"], r["radius"] or 0.0
    probes = stored(asked.mapInArrow(_prober(index, held, top), "vec_id long, v array<double>, lists array<long>"), "probes")
    first = probes.withColumn("limit", F.lit(float("inf")))
    found = stored(_best(_compared(posted, first, {r["list"]: r["n"] for r in sizes}, BLOCK_ROWS, top), top), "found")
    # The second pass: vectors at home in the lists left out, several small neighbouring lists in one block.
    tenth = found.filter(F.col("rank") == top).select(F.col("query_id").alias("q"), F.col("score").alias("limit"))
    limited = probes.join(tenth, F.col("vec_id") == F.col("q"), "left").select("vec_id", "v", "lists", F.coalesce("limit", F.lit(float("inf"))).alias("limit"))
    group = np.unique((np.cumsum(held) - held) // REST_ROWS, return_inverse=True)[1]
    rest = stored(limited.mapInArrow(_rest(index, held, radius, group), "vec_id long, v array<double>, limit double, lists array<long>"), "rest")
    of = F.broadcast(spark.createDataFrame([(i, int(g)) for i, g in enumerate(group)], "of long, to long"))  # MAX_LISTS rows at most
    homes = posted.filter("home").join(of, F.col("list") == F.col("of")).select("vec_id", "v", F.col("to").alias("list"))
    more = _compared(homes, rest, dict(enumerate(np.bincount(group, held).astype(int).tolist())), REST_ROWS, top)
    return _best(found.select("query_id", "vec_id", "score").union(more), top)
