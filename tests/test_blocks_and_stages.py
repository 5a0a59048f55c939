"""Blocks of sums, election of peaks, ranked normality, content-addressed stages and file manifests."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline import Panel
from ridgeline.operators import ensemble, evaluate, explore
from ridgeline.panel import NATIONAL
from ridgeline.sources import stages

COLS = ["a", "b", "c", "flat"]


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(3)
    rows = []
    for s in ("x", None):
        for i in range(120):
            a, b = 1e8 + rng.normal(), rng.normal()
            rows.append((s, dt.date(2020, 1, 1) + dt.timedelta(days=i), a, a + b if rng.random() > 0.2 else None, float("nan") if i % 17 == 0 else b, 5.0, float(a - 1e8 + 2 * b)))
    return spark.createDataFrame(rows, "state string, date date, a double, b double, c double, flat double, y double").repartition(5)


def pairwise(x, y):
    known = ~(np.isnan(x) | np.isnan(y))
    x, y = x[known], y[known]
    return None if len(x) < 2 or np.ptp(x) == 0 or np.ptp(y) == 0 else np.corrcoef(x, y)[0, 1]


def numbers(df, col):
    return np.array([np.nan if r[0] is None else r[0] for r in df.select(col).collect()], float)


def test_correlation_blocks_equal_numpy_and_explode_nothing(spark, wide):
    out = explore.corr_matrix(wide, COLS)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and plan.index("Generate") < plan.index("Aggregate")  # mirrors the pairs, not the rows
    local = wide.toPandas()
    got = {(r["row"], r["column"]): r["r"] for r in out.collect()}
    assert len(got) == 16
    for i in COLS:
        for j in COLS:
            want = pairwise(local[i].to_numpy(float), local[j].to_numpy(float))
            assert got[i, j] == (None if want is None else pytest.approx(want, abs=1e-7))


@pytest.mark.parametrize("panel", [Panel("date", "state"), Panel("date", "state", segment_rows=16)])
def test_lagged_blocks_equal_numpy_in_both_layouts(wide, panel):
    out = explore.lag_corr(wide, COLS, "y", panel, max_lag=5)
    got = {(r["column"], r["lag"]): r["r"] for r in out.collect()}
    assert len(got) == 4 * 6
    local = wide.toPandas().sort_values("date")
    for c in COLS:
        for k in range(6):
            pairs = [(g[c].shift(k).to_numpy(float), g["y"].to_numpy(float)) for _, g in local.groupby("state", dropna=False)]
            want = pairwise(np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]))
            assert got[c, k] == (None if want is None else pytest.approx(want, abs=1e-7))
    assert {r["column"] for r in explore.best_lag(out).collect()} == {"a", "b", "c"}


def greedy(values, height, distance):
    """Highest first, the later of equals, over strict local maxima."""
    tops = [i for i in range(1, len(values) - 1) if values[i - 1] < values[i] > values[i + 1] and values[i] >= height]
    kept = []
    for i in sorted(tops, key=lambda i: (-values[i], -i)):
        if all(abs(i - k) >= distance for k in kept):
            kept.append(i)
    return sorted(kept)


@pytest.mark.parametrize("distance", [2, 7, 40])
@pytest.mark.parametrize("segment_rows", [None, 64])
def test_elected_peaks_equal_the_greedy_choice(spark, distance, segment_rows):
    rng = np.random.default_rng(distance)
    chain = [float(v) for i in range(150) for v in (i, 0.5)]  # one long chain of rising tops
    series = {"noise": (rng.integers(0, 50, 400) + 0.25 * (np.arange(400) % 2)).tolist(), "chain": chain, None: chain[::-1], "flat": [1.0] * 30}
    rows = [(s, dt.date(2020, 1, 1) + dt.timedelta(days=i), v) for s, vs in series.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "state string, date date, v double")
    found = explore.peaks(df, "v", Panel("date", "state", segment_rows=segment_rows), height=3.0, distance=distance).collect()
    for s, vs in series.items():
        mine = sorted(r.pos for r in found if r.state == s)
        assert mine == greedy(vs, 3.0, distance)
        assert all(r.date == dt.date(2020, 1, 1) + dt.timedelta(days=r.pos) for r in found if r.state == s)


def test_anderson_darling_of_normal_and_skewed_residuals(spark):
    rng = np.random.default_rng(0)
    samples = {"normal": rng.normal(3, 2, 500), "skewed": rng.exponential(1, 500), "flat": np.zeros(10)}
    rows = [(m, float(e), 0.0) for m, es in samples.items() for e in es] + [("normal", None, 1.0)]
    df = spark.createDataFrame(rows, "model string, y_true double, y_pred double")
    got = {r.model: r for r in evaluate.anderson_darling(df, segment_rows=100).collect()}
    for m in ("normal", "skewed"):
        e = np.sort(samples[m])
        n = len(e)
        phi = np.array([0.5 * math.erfc(-z / math.sqrt(2)) for z in (e - e.mean()) / e.std(ddof=1)])
        i = np.arange(1, n + 1)
        want = -n - ((2 * i - 1) * np.log(phi) + (2 * (n - i) + 1) * np.log(1 - phi)).sum() / n
        assert got[m].anderson_darling == pytest.approx(want, rel=1e-5) and got[m].n == n
    assert got["normal"].p_value > 0.05 and got["skewed"].p_value < 1e-6
    assert got["flat"].anderson_darling is None and got["flat"].p_value is None


def test_weights_of_collinear_models_are_shared_evenly(spark):
    rows = [(dt.date(2020, 1, d), m, float(d), p) for d in range(1, 9) for m, p in (("one", d + 1.0), ("twin", d + 1.0), ("off", d - 40.0))]
    df = spark.createDataFrame(rows, "date date, model string, y_true double, y_pred double")
    got = {r.model: r.weight for r in ensemble.weights_optimal(df, ["one", "twin", "off"]).collect()}
    assert got["one"] == pytest.approx(got["twin"]) and sum(got.values()) == pytest.approx(1)
    assert ensemble.simplex_weights(np.zeros((3, 3)), np.zeros(3)) == pytest.approx([1 / 3] * 3)


def test_simplex_weights_meet_the_conditions_of_their_minimum():
    rng = np.random.default_rng(5)
    for k in range(1, 9):
        for n in (1, 3, 30):
            x, y = 10 * rng.normal(size=(n, k)), 10 * rng.normal(size=n)
            gram, cross = x.T @ x, x.T @ y
            w = ensemble.simplex_weights(gram, cross)
            scale = np.trace(gram) / k
            slope = (gram / scale + ensemble.NUDGE * np.eye(k)) @ w - cross / scale
            assert (w >= 0).all() and w.sum() == pytest.approx(1)
            assert slope[w > 1e-9].max() - slope.min() < 1e-9


def test_a_stage_is_built_once_per_content(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.range(5).write.parquet(str(tmp_path / "in/t"))
    built = []

    def build(least):
        built.append(least)
        return spark.read.parquet(str(tmp_path / "in/t")).filter(F.col("id") >= least)

    def ask(least):
        return stages.stage(spark, str(tmp_path / "out"), "s", build, [str(tmp_path / "in/t")], {"least": least}).count()

    assert [ask(2), ask(2), ask(3), ask(2)] == [3, 3, 2, 3] and built == [2, 3]
    spark.range(5, 7).write.mode("append").parquet(str(tmp_path / "in/t"))
    assert ask(2) == 5 and built == [2, 3, 2]


def test_a_stage_left_half_written_is_built_anew(spark, tmp_path):
    def build():
        return spark.range(3)

    path = tmp_path / f"s-{stages.stage_digest(spark, build)[:24]}"
    path.mkdir()
    (path / "part-0.parquet").write_text("torn")
    assert stages.stage(spark, str(tmp_path), "s", build).count() == 3


SCHEMA = "state string, date date, cases long"


def test_files_are_taken_in_once_and_columns_are_reconciled(spark, tmp_path):
    folder, store = tmp_path / "d", str(tmp_path / "s")
    folder.mkdir()
    (folder / "goa.csv").write_text("cases,state,date,junk\n3,Goa,2020-01-01,z\n4,Goa,2020-01-02,\n")
    (folder / "copy.csv").write_text("cases,state,date,junk\n3,Goa,2020-01-01,z\n4,Goa,2020-01-02,\n")
    (folder / "none.csv").write_text("other\n1\n")
    (folder / "empty.csv").write_text("")
    assert stages.take_in(spark, str(folder), store, SCHEMA).count() == 2
    (folder / "kerala.csv").write_text('"date","state"\n2020-01-03,Kerala\n')
    got = {tuple(r) for r in stages.take_in(spark, str(folder), store, SCHEMA).select("state", "date", "cases").collect()}
    assert got == {("Goa", dt.date(2020, 1, 1), 3), ("Goa", dt.date(2020, 1, 2), 4), ("Kerala", dt.date(2020, 1, 3), None)}
    before = spark.read.parquet(f"{store}/manifest").count()
    assert stages.take_in(spark, str(folder), store, SCHEMA).count() == 3
    assert spark.read.parquet(f"{store}/manifest").count() == before == 3  # Spark lists no empty files


def test_rows_of_a_lost_delivery_are_not_read(spark, tmp_path):
    folder, store = tmp_path / "d", str(tmp_path / "s")
    folder.mkdir()
    assert stages.take_in(spark, str(folder), store, SCHEMA).columns == ["state", "date", "cases", "source_file"]
    (folder / "a.csv").write_text("state,cases\nGoa,1\n")
    stages.take_in(spark, str(folder), store, SCHEMA)
    spark.createDataFrame([("Goa", None, 9, "lost")], f"{SCHEMA}, source_file string").write.parquet(f"{store}/rows/delivery=1")
    assert [r.cases for r in stages.take_in(spark, str(folder), store, SCHEMA).collect()] == [1]
    (folder / "b.csv").write_text("state,cases\nGoa,2\n")
    assert sorted(r.cases for r in stages.take_in(spark, str(folder), store, SCHEMA).collect()) == [1, 2]
