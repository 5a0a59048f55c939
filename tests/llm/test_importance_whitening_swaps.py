"""Importance resampling, whitening and swap packing against brute force, with awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import importance, swap_packing, whitening
from ridgeline.llm.queries import vocabulary

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    words = ["alpha", "Beta,", "gamma's", "ÄRGER", "x9y", "日本", "a\x00b", "foo_bar", "½²", " ", "--", "y" * 300, "Z" * 70]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 120))), f"s{i % 3}", 1, "x", 0.5) for i in range(80)]
    rows += [(100, None, None, None, None, None), (101, "", "s0", 0, "", 0.0), (102, "long tail of words\n" * 70_000, "s1", 0, "", 0.0)]
    rows += [(103, "q" * 1_500_000 + " end of it " + "r" * 1_200_000, "s1", 0, "", 0.0)]
    rows += [(7, "the same row " * 9, "s2", 0, "", 0.0)] * 5 + [(None, "no id here " * 10, None, 0, "", 0.0), (None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, rank int, kept string, `a.b` double")


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame([(1, "Alpha beta gamma s 日本 ärger"), (2, None), (3, "long tail. The same ROW")], "item_id long, text string")


def runs(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def by_force(rows, texts):
    cut = [(r["doc_id"], *runs(r["text"])) for r in rows]
    source = Counter(b for _, _, f in cut for b in map(bucket, f))
    wanted = Counter(b for t in texts for b in map(bucket, runs(t)[1]))
    s, t = sum(source.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s + 10_000) / ((source[b] + 1) * (t + 10_000)))) for b in range(10_000)]
    out, able = [], []
    for i, n, f in cut:
        weight = sum(gain[bucket(x)] for x in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        row = [i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        out.append(row)
        if n >= 20:
            able.append(row)
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0]))
    return out, able


@pytest.mark.parametrize("share", [0.05, 0.5])
def test_importance_equals_brute_force(spark, docs, target, share, monkeypatch):
    got = importance.score(docs, target, share)
    rows, able = by_force(docs.select("doc_id", "text").collect(), [r["text"] for r in target.collect()])
    for place, row in enumerate(able[: math.floor(share * len(able))]):
        row[4] = place + 1
    assert Counter(tuple(r) for r in got.select("kept.doc_id", "n_features", "weight", "score", "rank").collect()) == Counter(map(tuple, rows))


def test_the_dictionary_does_not_decide_the_result(spark, docs, target):
    full = importance.bucket_counts(docs, importance.dictionary(docs, target))
    assert (full == importance.bucket_counts(docs, [])).all() and full.sum()
    assert (full == importance.bucket_counts(docs.repartition(7), importance.dictionary(docs, target, 3))).all()


def test_shifted_crcs():
    shift = importance.Shift()
    for n in (0, 1, 255, 256, 300, 70_000):
        head, tail = b"head of it", bytes(range(256)) * (n // 256 + 1)
        got = shift(np.array([zlib.crc32(head)], np.uint32), np.array([n]))[0] ^ np.uint32(zlib.crc32(tail[:n]))
        assert got == zlib.crc32(head + tail[:n])


def test_windows_hold_every_word_once():
    texts = [b"a b", None, b"", b"c " * 40, b"d" * 50, b" ", b"E,f"]
    for room in (4, 7, 1000):
        importance.WINDOW, before = room, importance.WINDOW
        try:
            seen = defaultdict(list)
            for numbers, parts in importance.windows(texts):
                for i, part in zip(numbers, parts, strict=True):
                    seen[i] += part.split()
        finally:
            importance.WINDOW = before
        assert [seen[i] for i in range(7)] == [[b"a", b"b"], [], [], [b"c"] * 40, [b"d" * 50], [], [b"e", b"f"]]


def test_resampled_documents_keep_their_columns(spark, docs, target):
    drawn = importance.resample(docs, target, 0.2)
    assert drawn.columns == docs.columns
    assert drawn.count() == math.floor(0.2 * sum(runs(r["text"])[0] >= 20 for r in docs.collect()))
    assert not drawn.subtract(docs).count()


def test_importance_of_empty_tables(spark, docs, target):
    assert importance.digest(docs.limit(0), target).count() == 0
    assert importance.digest(docs.limit(0), target.limit(0)).count() == 0
    some = importance.digest(docs.filter("doc_id < 30"), target.limit(0)).collect()
    assert len(some) == 31 - 1 + 5 and all(r["n_features"] >= 0 for r in some)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, component string")


def checked(rows, x):
    """Rows of whiten() of one vector length against a singular value decomposition of the centred rows, which
    keeps small components that an eigendecomposition of the covariance loses."""
    n, d = x.shape
    c = (n * x - x.sum(axis=0)) / n
    _, sigma, basis = np.linalg.svd(c)
    u, e = basis.T, np.append(sigma, np.zeros(d))[:d] ** 2 / n
    k = min(32, d)
    got = np.array([[r["whitened"] for r in rows if r["component"] == j + 1] for j in range(k)], float).T
    for j in range(k):
        if e[j] > 1e-24 * e[0]:
            want = c @ u[:, j] / math.sqrt(e[j])
            assert min(np.abs(got[:, j] - want).max(), np.abs(got[:, j] + want).max()) < 1e-6
        else:
            assert np.isnan(got[:, j]).all()
    share = [next(r["explained"] for r in rows if r["component"] == j + 1) for j in range(k)]
    assert np.allclose(share, np.clip(e[:k], 0, None) / e.sum() if e.sum() else 0, rtol=1e-6, atol=1e-12)
    assert all(r["n"] == n and r["identity_error"] <= 1e-4 for r in rows)
    away = ((n * x.astype(object) - x.astype(object).sum(axis=0)) ** 2).sum(axis=1)
    assert [r["deviation"] for r in rows if r["component"] == 1] == [v if v < 2**63 else None for v in away]


def grid(v):
    return np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in row] for row in v])


def test_whitening_equals_an_eigendecomposition(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 40)) * np.geomspace(1, 1000, 40) @ rng.normal(size=(40, 40))
    df = vectors(spark, [(i, row.tolist()) for i, row in enumerate(v)]).repartition(5)
    rows = whitening.whiten(df).orderBy("vec_id").collect()
    assert len(rows) == 300 * 32
    checked(rows, grid(v))
    passes = whitening.fit(whitening.grid(df))[40].passes
    assert 2 <= passes <= 4


def test_whitening_of_ill_conditioned_and_singular_rows(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(200, 6)) * [1e6, 1e6, 1e4, 10, 1, 1]
    v[:, 4] = 0.5  # constant
    v[:, 5] = v[:, 3]  # dependent
    rows = whitening.whiten(vectors(spark, [(i, row.tolist()) for i, row in enumerate(v)])).orderBy("vec_id").collect()
    checked(rows, grid(v))
    few = rng.normal(size=(4, 9))
    checked(whitening.whiten(vectors(spark, [(i, row.tolist()) for i, row in enumerate(few)])).orderBy("vec_id").collect(), grid(few))


def test_whitening_of_awkward_rows(spark):
    rng = np.random.default_rng(4)
    even, odd = rng.normal(size=(30, 4)), rng.normal(size=(20, 3))
    rows = [(i, v.tolist()) for i, v in enumerate(even)] + [(100 + i, v.tolist()) for i, v in enumerate(odd)]
    rows += [(200, None), (201, []), (202, [1.0, None, 2.0, 3.0]), (203, [1.0, math.nan, 0.0, 0.0]), (204, [math.inf] * 4), (205, [3e38] * 4)]
    got = whitening.whiten(vectors(spark, rows)).orderBy("vec_id").collect()
    assert {r["vec_id"] for r in got} == {*range(30), *range(100, 120)}
    checked([r for r in got if r["vec_id"] < 100], grid(even))
    checked([r for r in got if r["vec_id"] >= 100], grid(odd))
    twice = whitening.whiten(vectors(spark, rows[:30] * 2 + [(None, [0.0] * 4)])).collect()
    assert len(twice) == 61 * 4 and {r["n"] for r in twice} == {61}
    assert whitening.whiten(vectors(spark, rows).limit(0)).count() == 0
    one = whitening.whiten(vectors(spark, rows[:1])).collect()
    assert [(r["whitened"], r["explained"], r["deviation"]) for r in one] == [(None, 0.0, 0)] * 4


def test_deviations_beyond_a_long_are_null(spark):
    got = whitening.whiten(vectors(spark, [(0, [4e14]), (1, [-4e14]), (2, [0.0])])).orderBy("vec_id").collect()
    assert [r["deviation"] is None for r in got] == [True, True, False]
    assert abs(got[0]["whitened"]) == pytest.approx(math.sqrt(1.5))


def first_fit_falling(lengths, capacity):
    fill = []
    for size in sorted(lengths, reverse=True):
        for b, f in enumerate(fill):
            if f + size <= capacity:
                fill[b] += size
                break
        else:
            fill.append(size)
    return len(fill)


@pytest.mark.parametrize("low, high", [(1, 100), (40, 99), (24, 49), (30, 42), (20, 60)])
def test_the_search_lays_every_piece_and_beats_plain_heuristics(low, high):
    rng = random.Random(low)
    lengths = [rng.randrange(low, high) for _ in range(400)]
    laid = swap_packing.lay(lengths, [], 100)
    assert sorted(i for b in laid for i in b) == list(range(400))
    assert all(sum(lengths[i] for i in b) <= 100 for b in laid)
    assert len(laid) <= first_fit_falling(lengths, 100)


def test_exchanges_raise_the_sum_of_squared_fills():
    rng = random.Random(9)
    cell = swap_packing.Bins([rng.randrange(1, 60) for _ in range(200)], 100)
    cell.best_fit(range(200))
    start, improve = len(cell.bins), cell._improve

    def watched(b):
        before = sum(f * f for f in cell.fill)
        done = improve(b)
        assert (sum(f * f for f in cell.fill) > before) == done
        assert cell.fill == [sum(cell.lengths[i] for i in held) for held in cell.bins]
        return done

    cell._improve = watched
    cell.search()
    assert len(cell.bins) < start and len(cell.bins) == math.ceil(sum(cell.lengths) / 100)


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(["alpha", "beta,", "日本", "it's", "½²"], k=rng.randrange(0, 3000))), "x", 3) for i in range(150)]
    rows += [(200, None, None, None), (201, "", "", 0), (202, "long " * 9000, "", 0), (203, "one " * 4095, "", 0)]
    rows += [(7, "same row", "", 0)] * 40 + [(None, "no id", None, 0), (None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, sequence_id string, offset int")


@pytest.mark.parametrize("cell", [8192, 16])
def test_swap_packed_pieces_hold_every_id_once(spark, texts, cell):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    expected = Counter()
    for d in texts.select("doc_id", "text").collect():
        ids = np.array(tokenizer.encode(d["text"] or "", add_special_tokens=False).ids + [1], "<u4")
        for piece, at in enumerate(range(0, len(ids), 4096)):
            expected[(d["doc_id"], piece, at, min(4096, len(ids) - at), zlib.crc32(ids[at : at + 4096].tobytes()))] += 1
    rows = swap_packing.pack(texts, vocabulary(), cell=cell).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in by_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 4096
    plain = first_fit_falling([r["length"] for r in rows], 4096)
    assert len(by_sequence) <= (plain if cell > 1000 else 1.05 * plain)


def test_swap_packing_of_an_empty_table(spark, texts):
    assert swap_packing.pack(texts.limit(0), vocabulary()).count() == 0
    assert swap_packing.pack(texts.filter(F.col("doc_id") == 203), vocabulary()).count() == 1
