"""Packing: documents cut into pieces and laid into sequences by cutting-stock column generation.

A document becomes full pieces of the capacity and one remainder; where it is cut depends on its
length alone, so one pass over the texts gives every piece and its checksum.  The remainders'
lengths, rounded up to ``grain`` tokens, form a histogram of at most capacity / grain classes.  On
that histogram the driver solves the cutting-stock linear program: a knapsack dynamic program over
the dual prices makes new patterns until none helps.  Patterns are rounded down, what is left of the
histogram is laid by best-fill knapsacks, and the ranked pieces of each class look up their sequence.

Defined results: a null or empty text is one end-of-document id; repeated rows are packed once
each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import Batches, ranked, stored

CAPACITY = 2048
GRAIN = 8
END_ID = 1
#: Pre-tokens that a worker remembers; the dictionary is emptied when full.
CACHE = 600_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class WordIds(dict):
    """Ids (little-endian bytes) of texts; a bounded dictionary of the pre-tokens met so far.

    The tokenizer lower-cases a text, splits it into pre-tokens (contractions, runs of letters,
    single digits, runs of other marks; white space goes) and merges inside each.  In a Latin-1 text
    those steps are str.lower and one pattern, so only pre-tokens not yet known reach the merges.
    Any other text goes through the tokenizer whole.
    """

    LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
    DIGITS = "0-9²³¹¼½¾"
    SPACE = "\t-\r \x85\xa0"
    PRE_TOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^{SPACE}{LETTERS}{DIGITS}]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        by_byte = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelled = str.maketrans({c: by_byte.pre_tokenize_str(c)[0][0] for c in map(chr, range(256))})

    def __missing__(self, part: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        plain = part.isascii() and part.isalpha()
        tokens = self.model.tokenize(part if plain else part.translate(self.spelled))
        ids = self[part] = b"".join([t.id.to_bytes(4, "little") for t in tokens])
        return ids

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.whole(text)
        if "<|" in text:  # may spell a special token
            return self.whole(text)
        return b"".join(map(self.__getitem__, self.PRE_TOKEN.findall(text.lower())))


_WORDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _WORDS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _WORDS[path] = WordIds(path)
    return _WORDS[path]


def _cutter(vocabulary: str, capacity: int) -> Callable[[Batches], Batches]:
    def cut(batches: Batches) -> Batches:
        words, end = word_ids(vocabulary), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = words.ids(text.as_py() or "") + end
                n = len(ids) // 4
                view = memoryview(ids)
                for at in range(0, n, capacity):
                    size = min(capacity, n - at)
                    rows.append((doc, at, size, zlib.crc32(view[4 * at : 4 * (at + size)]), n))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if rows:
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    return cut


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): each document's ids, cut at the capacity."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_cutter(vocabulary, capacity), PIECES)


def price(duals: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack: the multiset of sizes within the room that is worth most."""
    useful = np.flatnonzero(duals > 1e-12)
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    order = useful[np.argsort(sizes[useful])]
    s, v = sizes[order], duals[order]
    upto = np.searchsorted(s, np.arange(room + 1), "right")
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        if k := upto[c]:
            worth = v[:k] + best[c - s[:k]]
            i = int(worth.argmax())
            if worth[i] > best[c] + 1e-15:
                best[c], pick[c] = worth[i], i
    counts, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            counts[order[pick[c]]] += 1
            c -= s[pick[c]]
    return float(best[room]), counts


def patterns_for(sizes: np.ndarray, demand: np.ndarray, room: int, seeds: list[np.ndarray], known: int, gap: float = 2e-4, rounds: int = 1500) -> tuple[np.ndarray, np.ndarray]:
    """The cutting-stock linear program by column generation: (patterns, how often each is used).

    A revised simplex over one row per size, into which the ``seeds`` are priced first.  It ends when the
    prices prove that no plan beats the ``known`` number of sequences, when no pattern is worth more than one
    sequence, when the number of sequences is within ``gap`` of the bound that the prices prove, when
    300 columns have gained less than a hundredth of that, or after ``rounds`` columns; every state on
    the way is a feasible packing, only less tight.  The inverse is updated in place; should rounding
    errors gather, ``plan`` still lays exactly the demand, as it only takes what is left.
    """
    m = len(sizes)
    columns = np.zeros((m, m), np.int64)
    np.fill_diagonal(columns, room // sizes)
    inverse = np.diag(1.0 / (room // sizes))
    used = (inverse * demand).sum(axis=1)
    earlier, waiting = np.inf, list(seeds)
    for step in range(rounds):
        duals = inverse.sum(axis=0)
        while waiting and (duals * waiting[-1]).sum() <= 1 + 1e-9:
            waiting.pop()
        if waiting:
            new = waiting.pop()
        else:
            worth, new = price(duals, sizes, room)
            bound = float((duals * demand).sum()) / max(worth, 1.0)
            if worth <= 1 + 1e-9 or used.sum() <= bound * (1 + gap) or np.ceil(bound - 1e-6) >= known:
                break
            if step % 300 == 299:
                if earlier - used.sum() < 0.01 * gap * used.sum():
                    break
                earlier = used.sum()
        move = (inverse * new).sum(axis=1)  # small matrices: threads of a matrix product only wait here
        rising = move > 1e-9
        if not rising.any():
            break
        ratio = np.full(m, np.inf)
        ratio[rising] = np.maximum(used[rising], 0) / move[rising]
        out = int(ratio.argmin())
        columns[:, out] = new
        pivot = inverse[out] / move[out]
        inverse -= np.outer(move, pivot)
        inverse[out] = pivot
        used = (inverse * demand).sum(axis=1)
    return columns.T, used


def fill_one(sizes: np.ndarray, left: np.ndarray, room: int) -> np.ndarray:
    """A pattern that holds the largest size left and fills the room as far as the sizes left allow."""
    take = np.zeros(len(sizes), np.int64)
    first = int(np.flatnonzero(left).max())
    take[first] = 1
    room -= int(sizes[first])
    reach = np.zeros(room + 1, bool)
    reach[0] = True
    by = np.full(room + 1, -1)
    for i in np.flatnonzero(left)[::-1]:
        s, n = int(sizes[i]), int(left[i]) - (i == first)
        for _ in range(min(n, room // s)):
            new = np.zeros(room + 1, bool)
            new[s:] = reach[:-s]
            new &= ~reach
            if not new.any():
                break
            by[new] = i
            reach |= new
        if reach[room]:
            break
    c = int(np.flatnonzero(reach).max())
    spare = left - take
    while c > 0:
        i = by[c]
        if spare[i] <= 0:
            break
        take[i] += 1
        spare[i] -= 1
        c -= int(sizes[i])
    return take


def filled(sizes: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """[(pattern, times)] by best-fill knapsacks, largest size first, until nothing is left."""
    left, out = demand.copy(), []
    while left.any():
        take = fill_one(sizes, left, room)
        has = take > 0
        times = max(1, int((left[has] // take[has]).min()))
        out.append((take, times))
        left = left - times * take
    return out


def plan(sizes: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """[(pattern, times)] that lays exactly the demand.  The work follows the number of sizes, not of pieces.

    Best-fill patterns seed the program.  Its patterns are rounded down and best-fill lays what that
    leaves; should the seeds alone need no more sequences, they are the plan.
    """
    if not len(sizes):
        return []
    seeds = filled(sizes, demand, room)
    found, used = patterns_for(sizes, demand, room, [p for p, _ in reversed(seeds)], sum(times for _, times in seeds))
    left, out = demand.copy(), []
    for k in np.argsort(-used):
        times = int(np.floor(used[k] + 1e-7))
        has = found[k] > 0
        if has.any():
            times = min(times, int((left[has] // found[k][has]).min()))
            if times > 0:
                out.append((found[k], times))
                left = left - times * found[k]
    out += filled(sizes, left, room)
    return min(seeds, out, key=lambda chosen: sum(times for _, times in chosen))


def slots(sizes: np.ndarray, chosen: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per run of ranks of a size: (size, first rank), per-sequence count and first sequence."""
    following, base = np.zeros(len(sizes), np.int64), 0
    rows = []
    for pattern, times in chosen:
        for i in np.flatnonzero(pattern):
            rows.append((int(sizes[i]), int(following[i]), int(pattern[i]), base))
            following[i] += times * pattern[i]
        base += times
    rows.sort()
    size, first, each, start = (np.array(c, np.int64) for c in zip(*rows, strict=True))
    return size, first, each, start


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """One row per piece: PIECES, sequence_id and the gapless offset there."""
    cut = stored(pieces(docs, vocabulary, capacity), "pieces").withColumn("size", F.ceil(F.col("length") / grain).cast("long"))
    histogram = cut.groupBy("size").count().collect()  # capacity / grain rows at most
    histogram.sort()
    sizes = np.array([r[0] for r in histogram], np.int64)
    chosen = plan(sizes, np.array([r[1] for r in histogram], np.int64), capacity // grain)
    if not chosen:
        return cut.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).drop("size").limit(0)
    size, first, each, start = slots(sizes, chosen)  # a few thousand numbers, whatever the corpus
    shift = 40
    keys = (size << shift) + first

    def place(batches: Batches) -> Batches:
        for batch in batches:
            key = (batch.column("size").to_numpy() << shift) + batch.column("rank").to_numpy()
            at = np.searchsorted(keys, key, "right") - 1
            sequence = start[at] + (key - keys[at]) // each[at]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence)], names=[*batch.schema.names, "sequence_id"])

    numbered = ranked(cut, ["size"], ["doc_id", "start", "ids_crc32", "length"], "rank")
    laid = numbered.mapInArrow(place, f"{PIECES}, size long, rank long, sequence_id long")
    before = Window.partitionBy("sequence_id").orderBy(F.desc("size"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    return laid.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("size", "rank")
