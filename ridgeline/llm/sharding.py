"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows get gapless numbers, a keyed permutation of 0..n-1 sends each number to its place, and the place
gives shard (place mod shards) and slot (place div shards).  The permutation is a formula: given the
key and n, anyone computes where row r went, and the inverse tells which row sits in a slot, without a
table.  Shard sizes differ by at most one row.

The permutation works on pairs (a, b) with a below ``side`` and b below ``height``, where
side * height is n or a little more; a place outside 0..n-1 is permuted again until it falls inside
(cycle walking), which keeps it a bijection of 0..n-1.

Defined results: null ids and null texts are numbered like others (a null text has no bytes and the
checksum of the empty text); rows equal in id and text are interchangeable; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import ranked, stored

SHARDS = 40
KEY = 20_240_613
ROUNDS = 8
OVERHEAD = 16


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply), keyed."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(key & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _round_key(key: int, i: int) -> int:
    return (key * 0x9E3779B97F4A7C15 + (i + 1) * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF


def _sides(n: int) -> tuple[int, int]:
    side = max(1, int(np.ceil(np.sqrt(n))))
    return side, -(-n // side)


def _step(x: np.ndarray, n: int, key: int, back: bool) -> np.ndarray:
    """One pass of the Feistel network over the pairs; odd rounds change one half, even ones the other."""
    side, height = _sides(n)
    a, b = x % side, x // side
    for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
        k = _round_key(key, i)
        if i % 2:
            f = (_mixed(b.astype(np.uint64), k) % np.uint64(side)).astype(np.int64)
            a = (a - f) % side if back else (a + f) % side
        else:
            f = (_mixed(a.astype(np.uint64), k) % np.uint64(height)).astype(np.int64)
            b = (b - f) % height if back else (b + f) % height
    return b * side + a


def permute(rows: np.ndarray, n: int, key: int = KEY, back: bool = False) -> np.ndarray:
    """The place of each row number below n; ``back`` gives the row number at each place."""
    place = _step(np.asarray(rows, np.int64), n, key, back)
    while (outside := place >= n).any():
        place[outside] = _step(place[outside], n, key, back)
    return place


def numbered(rows: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """Global row numbers that depend on the rows alone.  Pass a stored table."""
    return ranked(rows, [], order, name)


def shard(docs: DataFrame, shards: int = SHARDS, key: int = KEY) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, and the row number and place behind them."""
    text = F.col("text").cast("string")
    sizes = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD).alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    rows = stored(sizes, "sizes")
    n = rows.count()

    @F.pandas_udf("long")
    def place(number: pd.Series) -> pd.Series:
        return pd.Series(permute(number.to_numpy(np.int64), n, key))

    placed = numbered(rows, ["doc_id", "text_crc32", "size"]).withColumn("place", place("number"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("place") % shards).cast("int").alias("shard"),
        F.floor(F.col("place") / F.lit(shards)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "number",
        "place",
    )
