"""Best-fit packing by swap-based local search.

A document up to the capacity is one piece; a longer one is cut at multiples of the capacity, and its full pieces
are sequences of their own.  All other pieces are dealt to cells of bounded size.  In a cell every piece first goes
to the fullest sequence that has room (best fit in dealt order); then sequences exchange pieces: one piece moves, or
one is exchanged for one, two for one or one for two, always from an emptier to a fuller sequence, so that
the sum of squared fills rises, until the emptier ones run empty or no exchange is left.  Sequences that are
not full are then dealt anew, whole, to fewer cells, and search on among each other, until a round frees none.

The search sees lengths only; every task holds one cell at a time.  Cells follow a row number that is stored with
the pieces, so repeated rows and hot lengths spread evenly and a lost task is redone alike.

Defined results: a null or empty text is one end-of-document id; repeated rows are packed once each; a null id is
kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import Batches, stored, whole_groups
from ridgeline.llm.packing import pieces

CAPACITY = 4096
#: Pieces of a cell, about.
CELL = 8192
#: Rounds in which sequences that are not full are dealt anew.
ROUNDS = 3

COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]


class Bins:
    """Sequences of a cell: their pieces by length, and an index of the pieces that may be given away."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins: list[list[int]] = []
        self.fill: list[int] = []

    def best_fit(self, items: Iterable[int]) -> None:
        """Every piece to the fullest sequence with room for it, else to a new one."""
        by_room: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        rooms = 0  # bit r: a sequence has r left
        for b, f in enumerate(self.fill):
            by_room[self.capacity - f].append(b)
            rooms |= 1 << (self.capacity - f)
        for i in items:
            size = self.lengths[i]
            wide = rooms >> size
            if wide:
                room = size + (wide & -wide).bit_length() - 1
                b = by_room[room].pop()
                if not by_room[room]:
                    rooms ^= 1 << room
            else:
                b, room = len(self.bins), self.capacity
                self.bins.append([])
                self.fill.append(0)
            self.bins[b].append(i)
            self.fill[b] += size
            by_room[room - size].append(b)
            rooms |= 1 << (room - size)

    def search(self) -> None:
        """Exchange pieces until no exchange raises the sum of squared fills; it rises each time, so this ends."""
        while self._round():
            pass
        keep = [b for b, held in enumerate(self.bins) if held]
        self.bins, self.fill = [self.bins[b] for b in keep], [self.fill[b] for b in keep]

    def _round(self) -> bool:
        """Fill the sequences, fullest first, from the others that are less full."""
        n = self.capacity
        self.where: dict[int, int] = {}  # the sequences of the pieces on offer
        self.of_size: list[set[int]] = [set() for _ in range(n + 1)]
        self.sizes = 0  # bit s: a piece of s may be given away
        order = sorted((b for b, held in enumerate(self.bins) if held and self.fill[b] < n), key=lambda b: -self.fill[b])
        for b in order:
            for i in self.bins[b]:
                self._offer(i, b)
        changed = False
        for b in order:
            for i in self.bins[b]:
                self._withdraw(i)
            while self.bins[b] and self.fill[b] < n and self._improve(b):
                changed = True
        return changed

    def _offer(self, i: int, b: int) -> None:
        self.where[i] = b
        self.of_size[self.lengths[i]].add(i)
        self.sizes |= 1 << self.lengths[i]

    def _withdraw(self, i: int) -> None:
        if self.where.pop(i, None) is not None:
            same = self.of_size[self.lengths[i]]
            same.discard(i)
            if not same:
                self.sizes ^= 1 << self.lengths[i]

    def _largest(self, above: int, most: int, fill: int, gained: int) -> int | None:
        """A piece on offer of above < length <= most, the longest, from a sequence whose fill is below that of the
        taker after the exchange, which gains length - gained."""
        found = (self.sizes & ((1 << (most + 1)) - 1)) >> (above + 1)
        while found:
            size = above + found.bit_length()
            for i in self.of_size[size]:
                if self.fill[self.where[i]] < fill + size - gained:
                    return i
            found ^= 1 << (size - above - 1)
        return None

    def _improve(self, b: int) -> bool:
        """The exchange that fills sequence b best: moves first, then by what it is given away for."""
        fill, room, held, sizes = self.fill[b], self.capacity - self.fill[b], self.bins[b], self.lengths
        best: tuple[int, list[int], list[int]] = (0, [], [])
        i = self._largest(0, min(room, self.capacity), fill, 0)
        if i is not None:
            best = (sizes[i], [i], [])
        seen: set[int] = set()
        own: dict[int, int] = {}
        for k in held:
            own.setdefault(sizes[k], k)
        if best[0] < room:
            for size, k in own.items():  # one for one
                i = self._largest(size + best[0], min(size + room, self.capacity), fill, size)
                if i is not None:
                    best = (sizes[i] - size, [i], [k])
                    if best[0] == room:
                        break
        if best[0] < room and len(held) > 1:
            for x, k in enumerate(held):  # one for two of b's
                for m in held[x + 1 :]:
                    size = sizes[k] + sizes[m]
                    if size in seen or size + best[0] >= self.capacity:
                        continue
                    seen.add(size)
                    i = self._largest(size + best[0], min(size + room, self.capacity), fill, size)
                    if i is not None:
                        best = (sizes[i] - size, [i], [k, m])
                if best[0] == room:
                    break
        if best[0] < room:
            for size, k in own.items():  # two for one of b's, or two that move
                pair = self._pair(size, room, best[0], fill)
                if pair:
                    best = (sizes[pair[0]] + sizes[pair[1]] - size, pair, [k])
                    if best[0] == room:
                        break
        if not best[0]:
            return False
        gained, taken, given = best
        for i in taken:
            a = self.where[i]
            self._withdraw(i)
            self.bins[a].remove(i)
            self.fill[a] -= sizes[i]
            held.append(i)
        for k in given:
            held.remove(k)
            self.bins[a].append(k)
            self.fill[a] += sizes[k]
            self._offer(k, a)
        self.fill[b] += gained
        return True

    def _pair(self, size: int, room: int, gained: int, fill: int) -> list[int] | None:
        """Two pieces of one less full sequence that together are longer than a piece of ``size`` by more than
        ``gained`` and at most ``room``: for each length on offer the longest partner."""
        most, found = size + room, self.sizes & ((1 << (size + room)) - 1)
        best: list[int] | None = None
        while found and gained < room:
            one = found.bit_length() - 1
            found ^= 1 << one
            if 2 * one < size + gained:
                break
            for i in self.of_size[one]:
                a = self.where[i]
                others = [k for k in self.bins[a] if k != i and size + gained < one + self.lengths[k] <= most]
                if others:
                    k = max(others, key=self.lengths.__getitem__)
                    now = one + self.lengths[k] - size
                    if self.fill[a] < fill + now:
                        best, gained = [i, k], now
                break
        return best


def lay(lengths: list[int], given: list[list[int]], capacity: int) -> list[list[int]]:
    """Sequences of piece numbers after a search that starts from the ``given`` ones, or else from best fit in dealt
    order and, where that leaves more sequences than the sum of lengths asks for, also from best fit by falling length."""
    least = math.ceil(sum(lengths) / capacity)
    found: list[list[list[int]]] = []
    for order in [None] if given else [range(len(lengths)), sorted(range(len(lengths)), key=lambda i: -lengths[i])]:
        cell = Bins(lengths, capacity)
        if order is None:
            cell.bins = [list(b) for b in given]
            cell.fill = [sum(lengths[i] for i in b) for b in given]
        else:
            cell.best_fit(order)
        cell.search()
        found.append(cell.bins)
        if len(cell.bins) <= least:
            break
    return min(found, key=len)


def _searched(rows: DataFrame, cells: int, capacity: int, number: int) -> DataFrame:
    """One search in every cell; ``sequence_id`` and ``offset`` are set anew."""

    def work(batches: Batches) -> Batches:
        for table, bounds in whole_groups(batches, ["cell"]):
            size, unit, cell = (table.column(c).to_numpy() for c in ("length", "unit", "cell"))
            row, sequence, offset = (np.empty(table.num_rows, np.int64) for _ in range(3))
            done = 0
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                cuts = np.flatnonzero(np.diff(unit[lo:hi])) + 1
                units = np.split(np.arange(hi - lo), cuts)
                lengths = size[lo:hi].tolist()
                given = [u.tolist() for u in units] if number else []
                for k, held in enumerate(lay(lengths, given, capacity)):
                    at = 0
                    for i in held:
                        row[done], sequence[done], offset[done] = lo + i, (int(cell[lo]) << 24) + k, at
                        at += lengths[i]
                        done += 1
            order = pa.array(row)
            columns = [table.column(c).combine_chunks().take(order) for c in COLUMNS]
            out = pa.Table.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=[*COLUMNS, "sequence_id", "offset"])
            yield from out.to_batches()

    dealt = rows.withColumn("cell", F.pmod(F.xxhash64("unit", F.lit(number)), F.lit(cells)))
    placed = dealt.repartition("cell").sortWithinPartitions("cell", "unit", "offset")
    schema = ", ".join(f"{c} long" for c in [*COLUMNS, "sequence_id", "offset"])
    return placed.mapInArrow(work, schema)


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, cell: int = CELL, rounds: int = ROUNDS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and the gapless offset there."""
    cut = pieces(docs, vocabulary, capacity).withColumn("piece", F.expr(f"start div {capacity}")).select(*COLUMNS)
    now = stored(cut.withColumn("unit", F.monotonically_increasing_id()), "swap-pieces").withColumn("offset", F.lit(0).cast("long"))
    whole = now.filter(F.col("length") == capacity)
    done = [whole.select(*COLUMNS, F.col("unit").alias("sequence_id"), "offset", F.lit(-1).alias("round"))]
    now = now.filter(F.col("length") < capacity)
    count, before = now.count(), None
    for number in range(rounds):
        if not count:
            break
        cells = max(1, math.ceil(count / cell))
        laid = stored(_searched(now, cells, capacity, number), f"swap-round{number}")
        fills = laid.groupBy("sequence_id").agg(F.sum("length").alias("fill"), F.count(F.lit(1)).alias("pieces"))
        is_loose = F.col("fill") < capacity
        after, loose, count = fills.agg(
            F.count(F.lit(1)), F.count_if(is_loose), F.coalesce(F.sum(F.when(is_loose, F.col("pieces"))), F.lit(0))
        ).first()
        if cells == 1 or number == rounds - 1 or not loose or after == before:
            done.append(laid.withColumn("round", F.lit(number)))
            break
        open_ones = fills.filter(is_loose).select(F.col("sequence_id").alias("unit"))
        met = laid.sequence_id == open_ones.unit
        done.append(laid.join(open_ones, met, "left_anti").withColumn("round", F.lit(number)))
        now, before = laid.join(open_ones, met).select(*COLUMNS, "unit", "offset"), loose
    # Numbers of different rounds do not meet: the lowest bits name the round.
    every = reduce(DataFrame.union, done)
    return every.select(*COLUMNS, (F.col("sequence_id") * 8 + F.col("round") + 1).alias("sequence_id"), "offset")
