"""Vectors, urls and fixity against brute force on small tables, and the registered queries' twins."""

import random
import sys

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import fixity, posting_lists, tree_forest, url_templates
from ridgeline.llm.queries import ORACLES, QUERIES

VECTORS = "vec_id long, embedding array<float>, label int, u string, list int, docs string"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(12)
    rows = []
    for i in range(900):
        if i % 3 == 0 or not rows:
            v = rng.normal(size=16)
        else:
            v = np.array(rows[-1][1]) + rng.normal(size=16) * 0.03 * (i % 5)
        rows.append((i, [float(x) for x in v], i // 300, "clash", 1, "clash"))
    rows += [(1000 + i, rows[4][1], 0, "", 1, "") for i in range(60)]  # a hot vector
    odd = [None, [], [0.0] * 16, [None] * 16, [float("nan")] * 16, [float("inf")] * 16, [1.0, 2.0]]
    rows += [(2000 + i * 100, v, 0, "", 1, "") for i, v in enumerate(odd)]
    rows += [(3000, rows[4][1], None, "", 1, ""), (None, rows[4][1], 0, "", 1, ""), (4, rows[4][1], 0, "", 1, "")]
    return spark.createDataFrame(rows, VECTORS)


def clean(rows):
    out = []
    for r in rows:
        v = r["embedding"]
        if r["vec_id"] is None or not v or len(v) != 16 or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        out.append((r["vec_id"], np.array(v, np.float64), r["label"]))
    return out


def test_near_duplicates_equal_brute_force(vectors):
    rows = vectors.collect()
    ok = [r for r in clean(rows) if r[2] is not None]
    u = np.array([v / np.linalg.norm(v) for _, v, _ in ok])
    label = np.array([x for _, _, x in ok])
    near = (u @ u.T >= 0.98) & (label[:, None] == label[None])
    component = np.arange(len(ok))
    while True:
        new = np.array([component[near[i]].min() for i in range(len(ok))])
        if (new == component).all():
            break
        component = new
    ids = np.array([i for i, _, _ in ok])
    want = [(int(ids[i]), int(near[i].sum() - 1), int(min(ids[component == component[i]]))) for i in range(len(ok))]
    left = len(rows) - len(ok)
    got = [tuple(r)[:3] for r in tree_forest.near_duplicates(vectors).collect()]
    assert len(got) == len(rows)
    assert len(set(got) - set(want)) <= left
    assert sorted(g for g in got if g in set(want)) == sorted(want)
    flags = {r["vec_id"]: r["kept"] for r in tree_forest.near_duplicates(vectors).collect()}
    assert flags[2000] and flags[3000] and flags[None]


def test_search_recall_and_scores(vectors):
    queries = vectors.filter(F.col("vec_id") % 20 == 0)
    rows = clean(vectors.collect())
    ids, x = np.array([i for i, _, _ in rows]), np.array([v for _, v, _ in rows])
    got = {}
    for r in posting_lists.search(vectors, queries).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    asked = {i for i in ids.tolist() if i % 20 == 0}
    assert set(got) == asked
    hits = 0
    for q in asked:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        best = sorted({(s, i) for s, i in zip(d.tolist(), ids.tolist(), strict=True) if i != q})[:10]
        found = sorted(got[q])
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert found == sorted(found, key=lambda f: (f[2], f[1]))
        for _, i, s in found:
            assert i != q
            assert abs(s - d[ids == i].min()) < 1e-12
        hits += len({i for _, i, _ in found} & {i for _, i in best})
    assert hits >= 0.95 * 10 * len(asked)


def test_search_is_exact_where_lists_do_not_prune(spark, monkeypatch):
    """Unit vectors without clusters and far more lists than the walk is wide: no list may be left out."""
    monkeypatch.setattr(posting_lists, "LIST_ROWS", 8)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    flat = spark.createDataFrame([(i, v.tolist(), 0, "", 1, "") for i, v in enumerate(x)], VECTORS)
    x = x.astype(np.float32).astype(np.float64)
    got = {}
    for r in posting_lists.search(flat, flat.filter("vec_id % 100 = 0")).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    for q in range(0, 4000, 100):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        assert [got[q][k] for k in range(1, 11)] == np.argsort(d)[:10].tolist()


def test_boundary_vectors_have_replicas_where_lists_do_not_prune():
    x = np.random.default_rng(6).normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(x))), pa.array(x.tolist())], names=["vec_id", "v"])
    out = pa.Table.from_batches(posting_lists._poster(posting_lists.build(x, len(x)))([batch]))
    assert sum(out["home"].to_pylist()) == len(x) < out.num_rows


def test_search_with_few_or_no_candidates(spark):
    few = spark.createDataFrame([(i, [float(i), 1.0], 0, "", 1, "") for i in range(3)], VECTORS)
    assert posting_lists.search(few, few).count() == 6
    none = spark.createDataFrame([], VECTORS)
    assert posting_lists.search(none, none).count() == 0
    assert tree_forest.near_duplicates(none).count() == 0


# --- urls ----------------------------------------------------------------------------------------

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = min([tail.index(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[:end]


def by_rule(host, path):
    fits = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return max(fits, key=lambda r: len(r[1] + r[2]), default=None)


PAGES = "page_id long, url string, html string, host string, template string, n int"


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(2)
    urls = [f"https://{h}/{s}/{rng.randrange(9999)}" for h in ("a.example.com", "b.example.org") for s in ("de", "fr", "en") for _ in range(30)]
    urls += [None, "", "no scheme", "x://", "http://NET", "http://net/", "http://ÄB.Net/x?y/", "ftp://u@example.net/en/#/de/", "http://example.net?/en/"]
    urls += ["http://org/fr/a", "http://borg/fr/a", "http://sub.example.com/de/", "http://sub.example.com/de", "a://b://c/d", "http://h/" + "x/" * 3000]
    rows = [(i, u, f"<p>{i}</p>", "clash", "clash", 1) for i, u in enumerate(urls)]
    rows += [rows[0], rows[0], (None, "http://net/none", None, None, None, None), (None, None, None, None, None, None)]
    return spark.createDataFrame(rows, PAGES)


def test_hosts_paths_and_rules(pages):
    rows = url_templates.judge(pages).collect()
    assert len(rows) == pages.count()
    urls = {r["page_id"]: r["url"] for r in pages.collect() if r["page_id"] is not None}
    for r in rows:
        if r["page_id"] is None:
            continue
        host, path = split_url(urls[r["page_id"]])
        assert (r["host"], r["path"]) == (host, path)
        rule = by_rule(host, path)
        assert r["rule"] == (rule[1] + rule[2] if rule else None)
        assert r["verdict"] == (rule[0] if rule else r["verdict"])
        if host == "":
            assert r["verdict"] == "allow"


def test_templates_split_where_labels_differ(spark):
    rows = [(i, f"https://shop.example.com/{('de', 'en', 'es')[i % 3]}/{i}", "", "", "", 1) for i in range(300)]
    judged = url_templates.judge(spark.createDataFrame(rows, PAGES))
    names = {r["template"] for r in judged.collect()}
    assert "=de/*number" in names  # its labels set it apart
    assert judged.filter("verdict = 'block' AND rule IS NULL").count() == 0
    # Branches that look alike merge into the wildcard, and one rejects the unlabelled rest of its template.
    rules = (url_templates.Rule("block", "spam.example", "/x/"), url_templates.Rule("allow", "fine.example", "/"))
    rows = [(i, f"http://spam.example/{'x' if i % 2 else 'xx'}/{i}.html", "", "", "", 1) for i in range(20)]
    rows += [(100 + i, f"http://fine.example/a/{i}", "", "", "", 1) for i in range(5)]
    plain = url_templates.judge(spark.createDataFrame(rows, PAGES), rules)
    assert plain.filter("host = 'fine.example' AND verdict = 'block'").count() == 0


def test_empty_pages(spark):
    none = spark.createDataFrame([], PAGES)
    assert url_templates.judge(none).count() == 0
    records = fixity.index(none)
    assert fixity.compare(records, fixity.decayed(none, records)).count() == 0


# --- fixity --------------------------------------------------------------------------------------


def test_audit_finds_exactly_the_decayed_records(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>", "", "", 1) for i in range(2500)] + [(None, None, None, "", "", 1), (None, "http://n/", "x", "", "", 1)]
    pages = spark.createDataFrame(rows, PAGES)
    records = fixity.index(pages)
    found = fixity.compare(records, fixity.decayed(pages, records)).collect()
    want = {(i, "missing") for i in range(2500) if i % 89 == 7} | {(i, "changed") for i in range(2500) if i % 97 == 13 and i % 89 != 7}
    assert {(r["page_id"], r["state"]) for r in found} == want
    assert len(found) == len(want)


def test_audit_of_equal_replicas_and_extra_records(spark):
    pages = spark.createDataFrame([(i, "u", "x" * (i % 7), "", "", 1) for i in range(700)] * 2, PAGES)
    records = fixity.index(pages)
    assert fixity.compare(records, records).count() == 0
    found = fixity.compare(records.filter("ordinal % 100 <> 3"), records).collect()
    assert {r["state"] for r in found} == {"extra"}
    assert len(found) == records.filter("ordinal % 100 = 3").count()


# --- registered queries --------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = ", ".join(f'"{c}"' for c in df.columns)
    cur = con.execute(f"SELECT {cols} FROM ({ORACLES[name]})")
    assert sorted(map(tuple, df.collect()), key=str) == sorted(cur.fetchall(), key=str)


def test_pipeline_stages_keep_their_contract(spark):
    sys.modules.pop("corpus_pipeline", None)
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).cache()
        assert after.columns == docs.columns, name
        assert 0 < after.count()
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert pieces.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()
    none = spark.createDataFrame([], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_vectors_of_every_length_take_part(spark):
    """Three lengths side by side: links and neighbours inside each, never across."""
    rng = np.random.default_rng(21)
    rows = []
    for base, d in ((0, 8), (1000, 3), (2000, 1)):
        seeds = rng.normal(size=(6, d))
        for i in range(30):
            rows.append((base + i, (seeds[i % 6] * (1 + i) + (1e-3 * rng.normal(size=d) if d > 1 else 0)).tolist(), i % 2))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in tree_forest.near_duplicates(df).collect()}
    for i, v, label in rows:
        near = [j for j, w, other in rows if j != i and other == label and len(w) == len(v) and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98]
        assert got[i]["n_links"] == len(near)
    found = posting_lists.search(df, df.filter("vec_id % 1000 < 3")).collect()
    for q in (0, 1, 2, 1000, 1001, 1002, 2000, 2001, 2002):
        v = next(np.array(w) for i, w, _ in rows if i == q)
        want = sorted((float(np.sqrt(((v - np.array(w)) ** 2).sum())), i) for i, w, _ in rows if i != q and len(w) == len(v))[:10]
        mine = sorted((r["rank"], r["vec_id"]) for r in found if r["query_id"] == q)
        assert [i for _, i in mine] == [i for _, i in want]
