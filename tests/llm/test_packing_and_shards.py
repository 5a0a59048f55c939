"""Packing, sharding and mixing: exact round trips and brute-force versions on small tables."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import mixing, packing, sharding
from ridgeline.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, source string, size string, rank int, _bucket int"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    words = ["alpha", "beta,", "Gamma's", "ÄRGER", "x9y", "日本", "it's", "foo<|endoftext|>bar", "a\x1cb", "½²", "…"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 900))), f"s{i % 3}", "clash", 1, 2) for i in range(60)]
    rows += [(100, None, None, None, None, None), (101, "", "s0", "", 0, 0), (102, "long " * 9000, "s1", "", 0, 0)]
    rows += [(7, "same row", "s2", "", 0, 0)] * 3 + [(None, "no id", None, "", 0, 0), (None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def test_pieces_hold_every_id_once_without_gaps(docs, tokenizer):
    rows = packing.pack(docs, vocabulary()).collect()
    by_sequence = defaultdict(list)
    by_doc = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[(r["doc_id"], r["doc_tokens"])].append(r)
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    expected = Counter()
    for d in docs.select("doc_id", "text").collect():
        ids = np.array(tokenizer.encode(d["text"] or "", add_special_tokens=False).ids + [1], "<u4")
        for at in range(0, len(ids), 2048):
            expected[(d["doc_id"], at, min(2048, len(ids) - at), zlib.crc32(ids[at : at + 2048].tobytes()), len(ids))] += 1
    assert expected == Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows)


def test_word_ids_equal_the_tokenizer(tokenizer):
    words = packing.word_ids(vocabulary())
    rng = random.Random(1)
    pool = "abcXYZ0129 \t\n\x1c\x85\xa0''sdtm!?.<|²½ªµÀÿßÉ×÷_\xad\x7f\x80Σς日"
    for text in ["".join(rng.choices(pool, k=40)) for _ in range(2000)] + ["<|startoftext|> x", "l'été C'EST"]:
        assert np.frombuffer(words.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_cutting_stock_meets_demand_and_is_near_the_bound():
    rng = np.random.default_rng(5)
    sizes, demand = np.unique(rng.integers(1, 257, 40_000), return_counts=True)
    laid = np.zeros(len(sizes), np.int64)
    sequences = 0
    for pattern, times in packing.plan(sizes, demand, 256):
        assert (pattern * sizes).sum() <= 256
        laid += pattern * times
        sequences += times
    assert (laid == demand).all()
    assert sequences <= 1.01 * (sizes * demand).sum() / 256 + 1


def test_knapsack_is_optimal_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(30):
        sizes, duals = np.array([3, 5, 7, 11]), rng.random(4)
        worth, counts = packing.price(duals, sizes, 23)
        best = max(
            duals @ (a, b, c, d) for a in range(8) for b in range(5) for c in range(4) for d in range(3) if 3 * a + 5 * b + 7 * c + 11 * d <= 23
        )
        assert abs(worth - best) < 1e-9
        assert (sizes @ counts) <= 23


def test_empty_table_packs_and_shards_to_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert packing.pack(none, vocabulary()).count() == 0
    assert sharding.shard(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert mixing.taken_copies(none, mixing.mix(none)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 40, 41, 997, 4096, 10_001])
def test_permutation_is_a_bijection_with_an_inverse(n):
    rows = np.arange(n)
    places = sharding.permute(rows, n)
    assert sorted(places.tolist()) == rows.tolist()
    assert (sharding.permute(places, n, back=True) == rows).all()
    if n > 900:
        assert abs(np.corrcoef(rows, places)[0, 1]) < 0.1


def test_shards_are_even_gapless_and_reproducible(docs):
    rows = sharding.shard(docs).collect()
    again = sharding.shard(docs.repartition(7)).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"], r["shard"], r["slot"])
    assert sorted(map(key, rows)) == sorted(map(key, again))
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r["shard"]].append(r["slot"])
    sizes = [len(by_shard.get(s, [])) for s in range(40)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    expected = Counter((d["doc_id"], len((d["text"] or "").encode()) + 16, zlib.crc32((d["text"] or "").encode())) for d in docs.collect())
    assert expected == Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows)


def filled(sizes, weights, budget):
    """Targets by repeated sharing of the excess."""
    names, capped = sorted(sizes, key=lambda s: (s is None, s or "")), {}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    while True:
        left, free = budget - sum(capped.values()), [s for s in names if s not in capped]
        level = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if level[s] > 2 * sizes[s]]
        if not over:
            return {**capped, **level}
        capped.update({s: 2.0 * sizes[s] for s in over})


def test_mix_meets_the_targets(docs):
    rows = mixing.mix(docs, bucket_rows=8).collect()
    assert len(rows) == docs.count()
    sizes, taken = Counter(), Counter()
    for d in docs.collect():
        sizes[d["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or ""))
    goal = filled(sizes, (3, 1, 2), 1.5 * sum(sizes.values()))
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - goal[r["source"]]) < 1e-6
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= 1
    order = lambda r: (r["turn"], r["taken"])
    assert sorted(map(order, rows)) == sorted(map(order, mixing.mix(docs.repartition(5), bucket_rows=1000).collect()))


def test_taken_copies_are_whole_and_rows_that_differ_stay_apart(docs):
    plain = docs.drop("size", "rank", "_bucket").withColumn("n_chars", F.length("text").cast("long"))
    plain = plain.withColumn("lang", F.when(F.col("doc_id") == 7, F.lit("de")).otherwise("en"))
    plain = plain.union(plain.filter("doc_id = 7").withColumn("lang", F.lit("fr")))
    mix = mixing.mix(plain)
    out = mixing.taken_copies(plain, mix)
    assert out.columns == plain.columns
    given = Counter(tuple(r) for r in plain.collect())
    got = Counter(tuple(r) for r in out.collect())
    assert set(got) <= set(given) and all(got[r] <= 2 * given[r] for r in got)
    size = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    wanted = defaultdict(int)
    for r in mix.collect():
        wanted[(r["doc_id"], r["source"], r["size"])] += r["taken"]
    copies = Counter()
    for r, n in got.items():
        copies[(r[0], r[2], size(r[1]))] += n
    for key, words in wanted.items():
        assert key[2] == 0 or abs(copies[key] * key[2] - words) <= key[2] / 2
    assert abs(got[(7, "same row", "s2", 8, "de")] - got[(7, "same row", "s2", 8, "fr")]) <= 3
