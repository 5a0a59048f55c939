"""N-gram Jaccard join by chosen paths.

A document is the set of its five-word shingles.  Equal sets are one class from the start, whatever
the number of documents in it, and only classes are joined:

1. A class has ``COORDINATES`` min-hashes (one per hash function, all taken from one pass over its
   shingles).  Two sets agree in a coordinate with the probability of their similarity.
2. Chosen paths: at the root of each run a set goes down the coordinates that the run samples, into
   the bucket of (coordinate, value), so sets meet on sampled tokens that they share.  Buckets of up
   to ``SMALL`` sets end there; larger ones split again on coordinates sampled for that bucket,
   ``LEVELS`` deep.  ``branching`` coordinates are sampled on average for a pair at the threshold.
3. In each final bucket all pairs are compared, in blocks of bounded size when a bucket stays large (a
   large group of near copies agrees everywhere and never splits).  Sketches decide which sets have
   a possible partner that they meet in no smaller bucket; the others leave before any shingle moves.
4. The remaining sets meet again with their whole shingle sets, and the exact similarity decides.  A
   pair that meets in several buckets counts in the smallest of them only, so links are counted
   without listing the pairs of a group, and each block hands on no more edges than it has sets.
5. Runs repeat until the chance that a pair at the threshold met in none is below 1 - target recall.

Defined results: words are what white space (space, tab to carriage return) separates; a text of one to
four words is one shingle; texts without words, null included, are copies of one another; null ids are
grouped like others (class_id null only when the whole class has none); repeated rows are copies; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import Batches, components, cut_buckets, in_blocks, lists_of, local_roots, overlaps, stored, whole_groups

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
COORDINATES = 64
BRANCHING = 2.0
LEVELS = 3
SMALL = 64
#: Sketch agreement below which a pair cannot be at the threshold: 4 standard deviations under it.
MARGIN = 4.0
#: Sets below this size skip the sketch.
FEW = 100
#: Sets and shingles of one side of a block.
BLOCK_ROWS = 512
BLOCK_LOAD = 400_000
#: Words that a worker remembers the hash of.
CACHE = 600_000

M1, M2, M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _Hashes()
_SPACES = str.maketrans("\t\v\f\r", "    ")


def words_of(text: str) -> list[str]:
    """The words between white space: space and the characters from tab to carriage return."""
    if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return text.split()
    return [w for w in text.translate(_SPACES).replace("\n", " ").split(" ") if w]


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The distinct 64-bit hashes of the text's runs of ``words`` words, sorted."""
    tokens = words_of(text)
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, tokens), np.uint64, len(tokens))
    n = max(1, len(h) - words + 1)
    size = min(words, len(h))
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = out * M3 + h[i : i + n]
        out ^= out >> np.uint64(29)
    return np.unique(mixed(out))


_SEEDS = mixed((np.arange(COORDINATES, dtype=np.uint64) + np.uint64(1)) * M3)


def min_hashes(items: np.ndarray) -> np.ndarray:
    """COORDINATES min-hashes of a sorted set: the minima of a few permutations over each of 8 parts of
    the hash range.  A part that is empty takes the minimum over the whole set under its own seed."""
    parts = 8
    out = np.empty(COORDINATES, np.uint64)
    cuts = np.searchsorted(items, np.arange(1, parts, dtype=np.uint64) << np.uint64(61))
    starts = np.concatenate([[0], cuts])
    empty = np.diff(np.append(starts, len(items))) == 0
    last = np.array([2**64 - 1], np.uint64)  # closes the parts; no minimum takes it
    for k in range(COORDINATES // parts):
        low = np.minimum.reduceat(np.append(mixed(items ^ _SEEDS[k]), last), starts)
        if empty.any():
            for j in np.flatnonzero(empty):
                low[j] = mixed(items ^ _SEEDS[k * parts + j] ^ M3).min()
        out[k * parts : (k + 1) * parts] = low
    return out


SETS = "doc_id long, key long, set_id binary, shingles int, hashes binary"


def _describe(batches: Batches) -> Batches:
    for batch in batches:
        ids, sizes, hashes = [], [], []
        for text in batch.column("text"):
            items = shingles(text.as_py() or "")
            ids.append(xxhash.xxh3_128_digest(items.tobytes()))
            sizes.append(len(items))
            hashes.append(min_hashes(items).tobytes() if len(items) else b"")
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("key"), pa.array(ids, pa.binary()), pa.array(sizes, pa.int32()), pa.array(hashes, pa.binary())],
            names=["doc_id", "key", "set_id", "shingles", "hashes"],
        )


def runs_for(recall: float, threshold: float, branching: float, coordinates: int = COORDINATES, levels: int = LEVELS) -> int:
    """Runs after which a pair at the threshold has met with the target probability.

    One level keeps a pair together unless none of the sampled coordinates agree; deeper levels ask
    that for one of the children (a branching process), which bounds the chance from below.
    """
    per = branching / (threshold * coordinates)
    meet = 1.0
    for _ in range(levels):
        meet = 1 - (1 - per * threshold * meet) ** coordinates
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def _children(share: float, seed: int):  # noqa: ANN202
    """Rows (set_id, path, hashes) to the buckets that they go down to: path, coordinate and value."""
    limit = np.uint64(min(share, 1.0) * (2**64 - 1025))

    def run(batches: Batches) -> Batches:
        numbers = (np.arange(COORDINATES, dtype=np.uint64) + np.uint64(1)) * M2
        for batch in batches:
            if not batch.num_rows:
                continue
            path = batch.column("path").to_numpy().view(np.uint64)
            values = np.frombuffer(b"".join(batch.column("hashes").to_pylist()), np.uint64).reshape(-1, COORDINATES)
            coin = mixed(path[:, None] * M3 + numbers[None] + np.uint64(seed))
            row, coordinate = np.nonzero(coin <= limit)
            bucket = mixed(mixed(path[row] + numbers[coordinate]) ^ values[row, coordinate])
            yield pa.RecordBatch.from_arrays([batch.column("set_id").take(pa.array(row)), pa.array(bucket.view(np.int64))], names=["set_id", "bucket"])

    return run


def buckets(sets: DataFrame, runs: int, branching: float, threshold: float, small: int = SMALL, levels: int = LEVELS) -> DataFrame:
    """(set_id, bucket): the final buckets of every set; buckets of one set are left out."""
    share = branching / (threshold * COORDINATES)
    now = sets.select("set_id", F.explode(F.array(*[F.lit(r).cast("long") for r in range(1, runs + 1)])).alias("path"), "hashes")
    final = None
    for level in range(levels):
        members = stored(now.mapInArrow(_children(share, level), "set_id binary, bucket long"), f"paths{level}")
        sizes = members.groupBy(F.col("bucket").alias("b")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        placed = members.join(sizes, F.col("bucket") == F.col("b")).select("set_id", "bucket", "n")
        last = level == levels - 1
        done = (placed if last else placed.filter(F.col("n") <= small)).select("set_id", "bucket")
        final = done if final is None else final.union(done)
        if last:
            break
        large = placed.filter(F.col("n") > small).select(F.col("set_id").alias("s"), F.col("bucket").alias("path"))
        now = large.join(sets.select("set_id", "hashes"), F.col("s") == F.col("set_id")).select("set_id", "path", "hashes")
    return stored(final.distinct(), "buckets")


def _sides(chunk: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the two sides of a block; the same rows twice inside one chunk."""
    return np.flatnonzero(chunk == lo), np.flatnonzero(chunk == hi)


def _first_here(homes: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray, bucket: int) -> np.ndarray:
    """Whether each pair of rows shares no bucket smaller than this one."""
    smaller = [[h[h < bucket] for h in (homes[at[i] : at[i + 1]] for i in side)] for side in (left, right)]
    inside = len(left) == len(right) and (left == right).all()
    return overlaps(smaller[0], None if inside else smaller[1]) == 0


def _sketch_filter(threshold: float):  # noqa: ANN202
    """Sets of each block with a possible partner that they meet in no smaller bucket: (set_id, bucket)."""
    # Eight-bit sketches agree by chance in 1 of 256.
    spread = math.sqrt(threshold * (1 - threshold) / COORDINATES)
    least = COORDINATES * (threshold - MARGIN * spread)

    def run(batches: Batches) -> Batches:
        for rows, cuts in whole_groups(batches, ["bucket", "lo", "hi"]):
            sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(-1, COORDINATES)
            size = rows.column("load").to_numpy()
            bucket, chunk, lo, hi = (rows.column(c).to_numpy() for c in ("bucket", "chunk", "lo", "hi"))
            homes, home_at = lists_of(rows, "homes")
            kept = np.zeros(rows.num_rows, bool)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                left, right = _sides(chunk[a:b], lo[a], hi[a])
                near = np.zeros((len(left), len(right)), bool)
                for at in range(0, len(left), 64):
                    some = left[at : at + 64]
                    like = (sketch[a + some][:, None, :] == sketch[a + right][None]).sum(axis=2) >= least
                    s, t = size[a + some][:, None], size[a + right][None]
                    like &= np.minimum(s, t) >= threshold * np.maximum(s, t)
                    # In small sets few tokens stand behind the sketch: their sizes alone decide here.
                    like |= (np.minimum(s, t) < FEW) & (np.minimum(s, t) >= threshold * np.maximum(s, t))
                    like &= some[:, None] != right[None]
                    near[at : at + 64] = like
                if near.any():
                    near &= _first_here(homes, home_at[a : b + 1], left, right, bucket[a])
                    kept[a + left] |= near.any(axis=1)
                    kept[a + right] |= near.any(axis=0)
            yield from rows.filter(pa.array(kept)).select(["set_id", "bucket"]).to_batches()

    return run


LINKS = "set_id binary, links long, root binary"


def _exact(threshold: float):  # noqa: ANN202
    """Per block: each set's documents linked there, and the set that the block's links join it to."""

    def run(batches: Batches) -> Batches:
        for rows, cuts in whole_groups(batches, ["bucket", "lo", "hi"]):
            ids, packed = (rows.column(c).to_pylist() for c in ("set_id", "items"))
            homes, home_at = lists_of(rows, "homes")
            docs = rows.column("docs").to_numpy()
            bucket, chunk, lo, hi = (rows.column(c).to_numpy() for c in ("bucket", "chunk", "lo", "hi"))
            out_id, out_links, out_root = [], [], []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                # A set whose text occurs in several rows of one id arrives more than once.
                left, right = ([i for i in dict((ids[a + r], a + r) for r in side).values()] for side in _sides(chunk[a:b], lo[a], hi[a]))
                inside = lo[a] == hi[a]
                if not left or not right or inside and len(left) < 2:
                    continue
                mine = [np.frombuffer(packed[i], np.uint64) for i in left]
                other = None if inside else [np.frombuffer(packed[i], np.uint64) for i in right]
                if inside and len(left) == 2:
                    both = np.zeros((2, 2), np.float32)
                    both[0, 1] = both[1, 0] = len(np.intersect1d(*mine, assume_unique=True))
                else:
                    both = overlaps(mine, other)
                n = np.array([len(s) for s in mine])
                m = n if inside else np.array([len(s) for s in other])
                # whole numbers: similarity >= threshold exactly when 1000 * both >= 1000 * threshold * union
                union = n[:, None] + m[None] - both
                near = np.round(both * 1000) >= np.round(threshold * 1000) * np.round(union)
                if inside:
                    near = np.triu(near, 1)
                x, y = np.nonzero(near)
                if not len(x):
                    continue
                linked = np.zeros(b - a, np.int64)
                # A pair that shares a smaller bucket is counted there.
                left, right = np.array(left), np.array(right)
                first = _first_here(homes, home_at, left, right, bucket[a])[x, y]
                x, y = left[x], right[y]
                np.add.at(linked, x[first] - a, docs[y[first]])
                np.add.at(linked, y[first] - a, docs[x[first]])
                root = local_roots(b - a, x - a, y - a)
                for i in np.unique(np.concatenate([x, y])):
                    out_id.append(ids[i])
                    out_links.append(int(linked[i - a]))
                    out_root.append(ids[a + root[i - a]])
            if out_id:
                yield pa.RecordBatch.from_arrays([pa.array(out_id, pa.binary()), pa.array(out_links, pa.int64()), pa.array(out_root, pa.binary())], names=["set_id", "links", "root"])

    return run


def _items(batches: Batches) -> Batches:
    for batch in batches:
        packed = [shingles(t.as_py()).tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(packed, pa.binary())], names=["item", "items"])


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, branching: float = BRANCHING) -> DataFrame:
    """doc_id, class_id, n_links, key and component of every document.

    class_id is the smallest doc_id that links reach; n_links counts the other documents at or above
    the threshold, copies included.  key is a hash of id and text, component the class as a set's hash.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    of_doc = stored(texts.mapInArrow(_describe, SETS), "described")
    first = of_doc.groupBy("set_id").agg(
        F.count(F.lit(1)).alias("docs"), F.min("key").alias("key"), F.min_by("shingles", "key").alias("load"), F.min_by("hashes", "key").alias("hashes")
    )
    sets = stored(first, "sets")
    some = sets.filter("load > 0")
    placed = buckets(some, runs_for(recall, threshold, branching), branching, threshold)

    homes = placed.groupBy("set_id").agg(F.sort_array(F.collect_list("bucket")).alias("homes"))
    sketched = homes.join(some.withColumnRenamed("set_id", "s"), F.col("set_id") == F.col("s")).select("set_id", "homes", "load", "docs", "key", "hashes")
    sketched = sketched.mapInArrow(_to_sketch, "set_id binary, homes array<long>, load int, docs long, key long, sketch binary")
    sketched = stored(sketched.withColumnRenamed("set_id", "s"), "sketches")
    cut = cut_buckets(placed.withColumn("one", F.lit(1)), "bucket", "one", BLOCK_ROWS, 2**62).drop("one")
    rough = in_blocks(cut.join(sketched.select("s", "homes", "load", "sketch"), F.col("set_id") == F.col("s")).drop("s"), "bucket", "set_id")
    likely = stored(rough.mapInArrow(_sketch_filter(threshold), "set_id binary, bucket long").distinct(), "likely")

    wanted = sketched.join(likely.select("set_id"), F.col("s") == F.col("set_id"), "left_semi").select(F.col("s").alias("item"), "homes", "load", "docs", F.col("key").alias("k"))
    wanted = stored(wanted, "wanted")
    fetched = texts.join(wanted.select("item", "k"), F.col("key") == F.col("k")).dropDuplicates(["item"]).select("item", "text").mapInArrow(_items, "item binary, items binary")
    full = wanted.join(fetched.withColumnRenamed("item", "f"), F.col("item") == F.col("f")).select("item", "homes", "load", "docs", "items")
    loads = likely.join(wanted.select("item", F.col("load").alias("n")), F.col("set_id") == F.col("item")).select("set_id", "bucket", "n")
    cut = cut_buckets(loads, "bucket", "n", BLOCK_ROWS, BLOCK_LOAD).drop("n")
    exact = in_blocks(cut.join(full, F.col("set_id") == F.col("item")).drop("item"), "bucket", "set_id").mapInArrow(_exact(threshold), LINKS)
    found = stored(exact, "links")

    joined = components(found.select(F.col("set_id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("set_id").agg(F.sum("links").alias("links"))
    table = (
        sets.select("set_id", "docs")
        .join(links.withColumnRenamed("set_id", "l"), F.col("set_id") == F.col("l"), "left")
        .join(joined, F.col("set_id") == F.col("node"), "left")
        .select("set_id", "docs", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "set_id").alias("component"))
    )
    table = stored(table, "classes")
    rows = of_doc.select("doc_id", "key", "set_id")
    smallest = (
        rows.groupBy(F.col("set_id").alias("m")).agg(F.min("doc_id").alias("low"))
        .join(table, F.col("m") == F.col("set_id")).groupBy(F.col("component").alias("c")).agg(F.min("low").alias("class_id"))
    )
    classes = table.join(smallest, F.col("component") == F.col("c")).select(
        F.col("set_id").alias("t"), "component", "class_id", (F.col("docs") - 1 + F.col("links")).cast("long").alias("n_links")
    )
    return rows.join(classes, F.col("set_id") == F.col("t")).select("doc_id", "class_id", "n_links", "key", "component")


def _to_sketch(batches: Batches) -> Batches:
    """Eight bits of each min-hash in place of all."""
    for batch in batches:
        values = np.frombuffer(b"".join(batch.column("hashes").to_pylist()), np.uint64)
        low = (values & np.uint64(255)).astype(np.uint8).reshape(-1, COORDINATES)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([r.tobytes() for r in low], pa.binary())], names=[*batch.schema.names[:-1], "sketch"])


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents, all columns, of which each class keeps one: the row with the smallest (id, key)."""
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    kept = found.groupBy("component").agg(F.min_by("key", order).alias("k")).select("k")
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("key"))
    chosen = rows.join(kept, F.col("key") == F.col("k"))
    # Rows repeated in full share a key: one of them stays.
    return chosen.dropDuplicates(["key"]).select("row.*")
