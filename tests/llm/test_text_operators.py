"""Secrets, line quality, the Jaccard join and the pipeline against brute force on small tables."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import chosen_path, line_quality, secret_ledger

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, blob string, row int, key int"


def rows_of(texts):
    return [(i, t, "en", "s", None if t is None else len(t), "clash", "clash", 1, 2) for i, t in texts]


# --- secrets -------------------------------------------------------------------------------------

BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]


def spans_of(text):
    found = []
    for order, (kind, pattern, group, least) in enumerate(BASE):
        for m in pattern.finditer(text or ""):
            if len(m.group(group)) >= least:
                found.append((m.start(), order, m.end(), kind))
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in sorted(found))


SECRETS = [
    (1, "my Password = 'hunter2hunter2' and ſecret=longlonglong"),
    (2, "token:token:abcdef123456"),
    (3, "é😀 AKIA" + "A" * 16 + " AKIASHORT AKIAAKIA" + "B" * 14),
    (4, "0123456789abcdef01234567 x deadbeef"),
    (5, "api_key=\"abcdefgh\" APIKEY: abc secret=" + "0123456789abcdef" * 2),
    (6, None),
    (7, ""),
    (8, "clean text"),
    (8, "clean text"),
    (None, "passwd=abcdefg"),
    (9, "x" * 200_000 + " secret=abcdef"),
]


@pytest.fixture(scope="module")
def secrets(spark):
    return spark.createDataFrame(rows_of(SECRETS), SCHEMA)


def test_digest_equals_brute_force(secrets):
    got = sorted(secret_ledger.digest(secrets, secret_ledger.update(secrets)).collect(), key=str)
    want = []
    for doc_id, text in SECRETS:
        spans = spans_of(text)
        n = [spans.count(k + ":") for k in ("assign", "access", "hex")]
        want.append((doc_id, *n, hashlib.sha256(spans.encode()).hexdigest(), spans))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_only_unseen_pairs_are_scanned(spark, secrets):
    ledger = secret_ledger.update(secrets)
    assert ledger.count() == len({t or "" for _, t in SECRETS})
    assert secret_ledger.unseen(secrets, ledger, "text", secret_ledger.VERSION).count() == 0
    more = spark.createDataFrame(rows_of([*SECRETS, (20, "new one secret=abcdef")]), SCHEMA)
    assert [r["text"] for r in secret_ledger.unseen(more, ledger, "text", secret_ledger.VERSION).collect()] == ["new one secret=abcdef"]
    assert secret_ledger.update(more, ledger).count() == ledger.count() + 1
    # Another rule version scans everything again.
    assert secret_ledger.unseen(secrets, ledger, "text", "base-2").count() == ledger.count()


def test_redaction_keeps_rows_and_columns(secrets):
    out = secret_ledger.redact(secrets, secret_ledger.update(secrets))
    assert out.columns == secrets.columns
    rows = {(r["doc_id"], r["text"]) for r in out.collect()}
    assert out.count() == len(SECRETS)
    assert (8, "clean text") in rows
    assert (4, "[secret] x deadbeef") in rows
    assert (6, None) in rows
    assert not any(spans_of(t) for _, t in rows)
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect() if r["text"] is not None)


# --- line quality --------------------------------------------------------------------------------


def chain_by_enumeration(unary, stay):
    """P(good) of each line by summing over all label sequences."""
    n = len(unary)
    total, good = 0.0, np.zeros(n)
    for code in range(2**n):
        y = [(code >> i) & 1 for i in range(n)]
        p = np.exp(sum(unary[i] * y[i] for i in range(n)) + sum(stay[y[i - 1], y[i]] for i in range(1, n)))
        total += p
        good += p * np.array(y)
    return good / total


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(4)
    first = np.array([0, 1, 6, 6 + 3])
    unary, stay = rng.normal(size=9), rng.normal(size=(2, 2))
    p, _ = line_quality.forward_backward(unary, first, stay)
    for a, b in zip(first[:-1], first[1:], strict=True):
        assert np.allclose(p[a:b], chain_by_enumeration(unary[a:b], stay))


def prose(rng, junk):
    words = ["the", "and", "river", "stone", "light", "green", "walked", "over"]
    lines = []
    for _ in range(rng.randrange(1, 6)):
        line = rng.choices(words, k=rng.randrange(4, 30))
        lines.append(" ".join(w.upper() + "!!" for w in line) if junk else " ".join(line).capitalize() + ".")
    return "\n".join(lines)


@pytest.fixture(scope="module")
def rated(spark):
    rng = random.Random(9)
    texts = [(i, prose(rng, i % 4 == 0)) for i in range(400)]
    extra = [(1000, None), (1001, ""), (1002, "\n\n"), (1003, "word " * 30_000), (None, "No id here.")]
    docs = spark.createDataFrame(rows_of(texts + extra), SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(400)] + [(3, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_quality_separates_held_out_documents(rated):
    docs, labels = rated
    out = {r["doc_id"]: r for r in line_quality.score(docs, line_quality.train(docs, labels)).collect()}
    assert len(out) == 405
    held = [i for i in range(400) if out[i]["held_out"]]
    assert 60 < len(held) < 140
    assert sum(out[i]["predicted"] == int(i % 4 != 0) for i in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out.values())


def test_held_out_labels_teach_nothing(rated):
    docs, labels = rated
    flipped = labels.withColumn("quality", F.when(line_quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = line_quality.score(docs, line_quality.train(docs, labels)).orderBy("doc_id").collect()
    assert a == line_quality.score(docs, line_quality.train(docs, flipped)).orderBy("doc_id").collect()


def test_quality_without_labels_or_rows(spark, rated):
    docs, labels = rated
    model = line_quality.train(docs, labels.filter("quality = 1"))
    assert {r["score"] for r in line_quality.score(docs, model).collect()} == {0.5}
    none = spark.createDataFrame([], SCHEMA)
    assert line_quality.score(none, line_quality.train(none, labels)).count() == 0


def test_filter_keeps_all_columns(rated):
    docs, labels = rated
    kept = line_quality.keep_good(docs, line_quality.train(docs, labels))
    assert kept.columns == docs.columns
    assert kept.filter("doc_id < 400 AND doc_id % 4 != 0").count() >= 295


# --- Jaccard join --------------------------------------------------------------------------------


def shingle_set(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_links(texts):
    sets = [shingle_set(t) for _, t in texts]
    parent = list(range(len(sets)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    links = [0] * len(sets)
    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or (a and b and len(a & b) / len(a | b) >= 0.8):
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    low = {}
    for i, (doc_id, _) in enumerate(texts):
        if doc_id is not None:
            low[find(i)] = min(low.get(find(i), doc_id), doc_id)
    return sorted(((d, low.get(find(i)), links[i]) for i, (d, _) in enumerate(texts)), key=str)


def near_copies(seed=6):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = []
    for i in range(80):
        base = rng.choices(vocabulary, k=rng.choice([3, 8, 30, 120, 400]))
        texts.append(" ".join(base))
        for _ in range(rng.randrange(0, 4)):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 40)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    hot = rng.choices(vocabulary, k=200)
    for i in range(150):
        texts.append(" ".join([*hot, f"end{i}"]))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return [*rows, (900, None), (901, ""), (902, " \n "), (None, "nobody owns this text at all"), (None, "nobody owns this text at all"), (0, texts[0]), (0, texts[0])]


def test_join_equals_brute_force(spark):
    texts = near_copies()
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    got = chosen_path.join(docs).select("doc_id", "class_id", "n_links").collect()
    assert sorted(map(tuple, got), key=str) == brute_links(texts)


def test_join_in_small_blocks_and_deep_paths(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "BLOCK_ROWS", 16)
    monkeypatch.setattr(chosen_path, "BLOCK_LOAD", 3000)
    monkeypatch.setattr(chosen_path.buckets, "__defaults__", (8, 3))
    texts = near_copies(8)
    got = chosen_path.join(spark.createDataFrame(rows_of(texts), SCHEMA)).select("doc_id", "class_id", "n_links").collect()
    assert sorted(map(tuple, got), key=str) == brute_links(texts)


def test_one_of_each_class_stays(spark):
    texts = near_copies()
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    kept = chosen_path.one_of_each(docs, chosen_path.join(docs))
    assert kept.columns == docs.columns
    classes = brute_links(texts)
    with_id = {c for _, c, _ in classes if c is not None}
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(with_id)
    assert kept.filter("doc_id IS NULL").count() == 1


def test_join_of_an_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert chosen_path.join(none).count() == 0
    assert chosen_path.one_of_each(none, chosen_path.join(none)).count() == 0


def test_repeated_rows_of_an_id_teach_once(spark, rated):
    docs, labels = rated
    again = docs.filter("doc_id = 8").crossJoin(spark.range(50)).drop("id")
    want = line_quality.train(docs, labels)
    got = line_quality.train(docs.union(again).repartition(7), labels)
    assert (want.weights == got.weights).all() and want.slope == got.slope
    few = line_quality.training_sample(docs, labels, 50, 60)
    assert few is None or few[2][-1] <= 60


def test_a_long_document_first_in_hash_order_does_not_end_the_sample(spark, rated):
    docs, labels = rated
    free = spark.range(10_000, 20_000).filter(~line_quality.held_out(F.col("id")))
    long = free.orderBy(F.xxhash64("id")).first()["id"]
    assert spark.createDataFrame([(i,) for i in [long, *range(400)]], "id long").orderBy(F.xxhash64("id")).first()["id"] == long
    more = docs.union(spark.createDataFrame(rows_of([(long, "one line here\n" * 60_500)]), SCHEMA))
    told = labels.union(spark.createDataFrame([(long, 1, 0)], labels.schema))
    want = line_quality.training_sample(docs, labels, 6000, 60_000)
    got = line_quality.training_sample(more, told, 6000, 60_000)
    assert got is not None and len(got[3]) == len(want[3]) + 1
    assert got[2][1] == 600 and got[2][-1] == want[2][-1] + 600
    assert line_quality.train(more, told).usable
