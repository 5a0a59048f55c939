"""Target-distribution importance resampling over hashed word n-grams.

The frequent words of the corpus, each between two delimiters, form an Aho-Corasick dictionary whose
entries carry the word's CRC-32 and byte length.  A scan of a text emits these payloads word by word, and
a CRC of words joined by spaces follows from the payloads of its words alone: appending n bytes to a string
shifts its CRC by a linear map that depends on n only.  So all runs of one to three words get their bucket
without being built.  A first pass counts the buckets of the corpus and of the target texts, a second one
adds each document's gains; exponential-race noise turns the sums into a draw without replacement.

The dictionary is bounded (``DICTIONARY`` words of at most ``WORD_BYTES`` bytes); words outside it get the same
payload by ``zlib.crc32``, so it decides the speed and never the result.  Texts are scanned whole, in windows of
about ``WINDOW`` bytes cut between words, with the last two payloads carried over.

Defined results: a null or empty text has no words, no features and weight 0; repeated rows are scored and
drawn one by one, ties going to the smaller id, null ids last; an empty table gives no rows; an empty
target or corpus gives the gains of empty counts.  Extra columns, whatever their names, are passed over.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from fractions import Fraction
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.numeric import quoted
from ridgeline.llm.common import Batches, stored
from ridgeline.operators.segments import number_rows
from ridgeline.panel import Panel

BUCKETS = 10_000
LONGEST = 3
LEAST_WORDS = 20
DICTIONARY = 65_536
WORD_BYTES = 64
WINDOW = 1 << 20
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 200_000
SEGMENT_ROWS = 65_536

#: Bytes of words stay, A-Z in lower case; all other ASCII is a delimiter.
PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, as four tables of a byte each; ``table`` may hold one map per element."""
    t = table if table.ndim == 3 else table[None]
    at = np.arange(len(crc)) if len(t) == len(crc) and len(t) > 1 else 0
    return t[at, 0, crc & 255] ^ t[at, 1, (crc >> 8) & 255] ^ t[at, 2, (crc >> 16) & 255] ^ t[at, 3, crc >> 24]


class Shift:
    """The CRC of a string after n more zero bytes, for arrays of CRCs and lengths."""

    def __init__(self) -> None:
        one = _crc_table()
        now = np.arange(256, dtype=np.uint32)[None, :] << np.array([0, 8, 16, 24], np.uint32)[:, None]
        short = [now]
        for _ in range(256):
            now = (now >> 8) ^ one[now & 255]
            short.append(now)
        self.short = np.stack(short[:256])
        self.doubled = [short[256]]  # 256, 512, ... bytes

    def __call__(self, crc: np.ndarray, n: np.ndarray) -> np.ndarray:
        low = n & 255
        out = self.short[low, 0, crc & 255] ^ self.short[low, 1, (crc >> 8) & 255]
        out ^= self.short[low, 2, (crc >> 16) & 255] ^ self.short[low, 3, crc >> 24]
        for k in range(int(n.max(initial=0) >> 8).bit_length()):
            if k == len(self.doubled):
                half = self.doubled[-1]
                self.doubled.append(np.stack([_apply(half, row) for row in half]))
            rows = np.flatnonzero((n >> (8 + k)) & 1)
            out[rows] = _apply(self.doubled[k], out[rows])
        return out


class Scanner:
    """Emits the payloads of a normalised text and composes those of neighbouring words into features."""

    def __init__(self, words: list[bytes]):
        import ahocorasick

        self.shift = Shift()
        self.blank = np.uint32(zlib.crc32(b" "))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)  # its own integers have 32 bits
        for w in words:  # Latin-1 gives the automaton one character per byte
            self.automaton.add_word(f" {w.decode('latin-1')} ", zlib.crc32(w) << 8 | len(w))
        if words:
            self.automaton.make_automaton()
        self.empty = not words

    def payloads(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(CRC, length, end) of every word of a text that starts and ends with a delimiter."""
        inside = np.frombuffer(text, np.uint8) != 32
        starts = np.flatnonzero(~inside[:-1] & inside[1:]) + 1
        ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
        crc, length, known = np.zeros(len(ends), np.uint32), ends - starts, np.zeros(len(ends), bool)
        if not self.empty and len(ends):
            hits = np.fromiter(chain.from_iterable(self.automaton.iter(text.decode("latin-1"))), np.int64).reshape(-1, 2)
            at = np.searchsorted(ends, hits[:, 0])
            crc[at], length[at], known[at] = (hits[:, 1] >> 8).astype(np.uint32), hits[:, 1] & 255, True
        for i in np.flatnonzero(~known):
            crc[i] = zlib.crc32(text[starts[i] : ends[i]])
        return crc, length, ends

    def features(self, crc: np.ndarray, length: np.ndarray, doc: np.ndarray, skip: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, CRC) of the runs of one to LONGEST words that end after the first ``skip`` words."""
        spaced = self.shift(np.full(len(crc), self.blank), length) ^ crc
        docs, runs, now = [doc[skip:]], [crc[skip:]], crc
        for k in range(1, LONGEST):
            longer = np.zeros(len(crc), np.uint32)
            longer[k:] = self.shift(now[k - 1 : -1], length[k:] + 1) ^ spaced[k:] if len(crc) > k else 0
            whole = np.zeros(len(crc), bool)
            whole[k:] = doc[k:] == doc[: len(doc) - k]
            whole[:skip] = False
            docs.append(doc[whole])
            runs.append(longer[whole])
            now = longer
        return np.concatenate(docs), np.concatenate(runs)

    def batch(self, texts: Iterable[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per window of the texts: the document of each new word, and (document, bucket) of each feature."""
        crc, length, doc = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for numbers, parts in windows(texts):
            text = b" " + b" ".join(parts) + b" "
            at = np.cumsum([1, *(len(p) + 1 for p in parts[:-1])])
            new_crc, new_length, ends = self.payloads(text)
            new_doc = np.array(numbers)[np.searchsorted(at, ends, "left") - 1]
            skip = len(crc)
            crc, length, doc = np.append(crc, new_crc), np.append(length, new_length), np.append(doc, new_doc)
            owner, runs = self.features(crc, length, doc, skip)
            yield new_doc, owner, (runs % np.uint32(BUCKETS)).astype(np.int64)
            crc, length, doc = crc[1 - LONGEST :], length[1 - LONGEST :], doc[1 - LONGEST :]


def windows(texts: Iterable[bytes | None]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Normalised texts in windows of about WINDOW bytes: (numbers of the texts, their parts), cut between words."""
    numbers: list[int] = []
    parts: list[bytes] = []
    room = WINDOW
    for i, raw in enumerate(texts):
        text = (raw or b"").translate(PLAIN)
        at = 0
        while len(text) - at > room:
            cut = text.rfind(b" ", at + 1, at + room)
            if cut < 0 and not parts:
                cut = text.find(b" ", at + room)
                if cut < 0:
                    break
            if cut >= 0:
                numbers.append(i)
                parts.append(text[at:cut])
                at = cut
            yield numbers, parts
            numbers, parts, room = [], [], WINDOW
        numbers.append(i)
        parts.append(text[at:])
        room = max(0, room - (len(text) - at) - 1)
    if parts:
        yield numbers, parts


_SCANNERS: dict[str, Scanner] = {}


def scanner(words: list[bytes]) -> Scanner:
    key = hashlib.sha256(b" ".join(words)).hexdigest()
    if key not in _SCANNERS:
        _SCANNERS.clear()
        _SCANNERS[key] = Scanner(words)
    return _SCANNERS[key]


def _texts(batch: pa.RecordBatch) -> Iterator[bytes | None]:
    return (value.as_py() for value in batch.column(batch.num_columns - 1))


def dictionary(docs: DataFrame, target: DataFrame, size: int = DICTIONARY) -> list[bytes]:
    """The most frequent distinct words of all texts, at most ``size`` of at most WORD_BYTES bytes each: those above the
    lowest level of frequency that leaves no more.  Only they and the sizes of the levels reach the driver."""

    def count(batches: Batches) -> Batches:
        held: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for _, parts in windows(_texts(batch)):
                for word, n in Counter(b" ".join(parts).split()).items():
                    if len(word) <= WORD_BYTES:
                        held[word] += n
                if len(held) > HELD_WORDS:
                    yield rows()
        if held:
            yield rows()

    texts = docs.select(F.col("text").cast("binary")).union(target.select(F.col("text").cast("binary")))
    counted = stored(texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    level = F.floor(F.log2("n") * 8)
    at_least, total = math.inf, 0
    for step, words in sorted(counted.groupBy(level).count().collect(), reverse=True):  # a few hundred levels at most
        total += words
        if total > size:
            break
        at_least = step
    if math.isinf(at_least):
        return []
    return sorted(bytes(r.word) for r in counted.filter(level >= at_least).select("word").collect())


def bucket_counts(texts: DataFrame, words: list[bytes]) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def count(batches: Batches) -> Batches:
        scan, total = scanner(words), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, buckets in scan.batch(_texts(batch)):
                total += np.bincount(buckets, minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    counted = texts.select(F.col("text").cast("binary")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for bucket, n in counted.collect():  # at most BUCKETS rows
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket floor(1000 ln(smoothed target share / smoothed source share))."""
    every, wanted = int(source.sum()), int(target.sum())
    return np.array(
        [math.floor(1000 * math.log((t + 1) * (every + BUCKETS) / ((s + 1) * (wanted + BUCKETS)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)],
        np.int64,
    )


def weighed(docs: DataFrame, words: list[bytes], gain: np.ndarray, keep: list[str]) -> DataFrame:
    """(kept struct, n_words, n_features, weight) of every document."""

    def weigh(batches: Batches) -> Batches:
        scan = scanner(words)
        for batch in batches:
            n = batch.num_rows
            n_words, n_features, weight = (np.zeros(n, np.int64) for _ in range(3))
            for word_doc, doc, buckets in scan.batch(_texts(batch)):
                n_words += np.bincount(word_doc, minlength=n)
                n_features += np.bincount(doc, minlength=n)
                weight += np.bincount(doc, gain[buckets], minlength=n).astype(np.int64)  # a window's sum is far below 2**53
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c) for c in (n_words, n_features, weight))], names=["kept", "n_words", "n_features", "weight"]
            )

    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in keep]).alias("kept"), F.col("text").cast("binary").alias("text"))
    schema = rows.select("kept").schema.add("n_words", "long").add("n_features", "long").add("weight", "long")
    return rows.mapInArrow(weigh, schema)


def noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 x a Gumbel variate) that depends on the seed and the id only."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def score(docs: DataFrame, target: DataFrame, share: float = 0.05, seed: int = 42, least_words: int = LEAST_WORDS, keep: Iterable[str] = ()) -> DataFrame:
    """Every document's kept columns (as the struct ``kept``), n_features, weight, score and rank in the draw of
    the ``share`` of the documents of at least ``least_words`` words; undrawn documents have no rank.

    Only the documents about the cut are sorted: a sketch gives a score that surely many reach, which
    is counted, and the rest is passed through without rank.
    """
    words = dictionary(docs, target)
    gain = gains(bucket_counts(docs, words), bucket_counts(target, words))
    rows = weighed(docs, words, gain, ["doc_id", *(c for c in keep if c != "doc_id")])
    scored = rows.withColumn("score", F.col("weight") + noise(F.col("kept.doc_id"), seed)).withColumn("_turn", F.monotonically_increasing_id())
    scored = stored(scored, "scored")
    able = F.col("n_words") >= least_words
    eligible = scored.filter(able)
    n = eligible.count()
    drawn = math.floor(Fraction(str(share)) * n)
    cut = eligible.agg(F.percentile_approx("score", max(0.0, 1 - share - 0.002), 10_000)).first()[0]
    if cut is not None and eligible.filter(F.col("score") >= cut).count() < drawn:
        cut = None
    near = able if cut is None else able & (F.col("score") >= cut)
    placed = scored.filter(near).select("*", (-F.col("score")).alias("_down"), F.col("kept.doc_id").isNull().alias("_no_id"), F.col("kept.doc_id").alias("_id"))
    numbered = number_rows(placed, Panel("_down", (), ("_no_id", "_id", "_turn"), SEGMENT_ROWS), "_at")
    names = ["kept", "n_features", "weight", "score"]
    first = numbered.select(*names, F.when(F.col("_at") < drawn, F.col("_at") + 1).cast("long").alias("rank"))
    return first.union(scored.filter(~near).select(*names, F.lit(None).cast("long").alias("rank")))


def digest(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document."""
    return score(docs, target).select(F.col("kept.doc_id").cast("long").alias("doc_id"), "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, share: float = 0.05, seed: int = 42) -> DataFrame:
    """The drawn documents, with all their columns."""
    return score(docs, target, share, seed, keep=docs.columns).filter("rank is not null").select(*[F.col(f"kept.{quoted(c)}") for c in docs.columns])
