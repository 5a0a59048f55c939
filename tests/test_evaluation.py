import datetime as dt
import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline import Panel
from ridgeline.operators import baselines as base
from ridgeline.operators import ensemble as en
from ridgeline.operators import evaluate as ev
from ridgeline.operators import explore
from ridgeline.panel import NATIONAL


@pytest.fixture(scope="module")
def preds(spark):
    def build(y, **models):
        rows = [
            (dt.date(2020, 1, 1) + dt.timedelta(days=i), m, float(y[i]), float(p[i])) for m, p in models.items() for i in range(len(y))
        ]
        return spark.createDataFrame(rows, "date date, model string, y_true double, y_pred double")

    return build


def by_model(df, col):
    return {r.model: r[col] for r in df.collect()}


def test_mape(preds):
    got = by_model(ev.metrics_all(preds([100, 200, 300], m=[110, 190, 310])), "mape")
    assert got["m"] == pytest.approx(np.mean([10, 5, 10 / 3]))


def test_mda(preds):
    got = by_model(ev.metrics_all(preds([100, 110, 105, 120, 115], m=[100, 115, 100, 125, 110])), "mda")
    assert got["m"] == 100.0


def test_metrics_match_numpy(preds):
    rng = np.random.default_rng(0)
    y, p = rng.integers(0, 30, 80), rng.normal(15, 9, 80)
    row = ev.metrics_all(preds(y, m=p)).first()
    nz = y != 0
    assert row.mae == pytest.approx(np.mean(np.abs(y - p)))
    assert row.rmse == pytest.approx(np.sqrt(np.mean((y - p) ** 2)))
    assert row.mape == pytest.approx(np.mean(np.abs((y[nz] - p[nz]) / y[nz])) * 100)
    assert row.mda == pytest.approx(np.mean(np.sign(np.diff(y)) == np.sign(np.diff(p))) * 100)
    assert row.r2 == pytest.approx(1 - np.sum((y - p) ** 2) / np.sum((y - y.mean()) ** 2))


def test_edge_truths(preds):
    row = ev.metrics_all(preds([0, 0, 0], m=[1, 2, 3])).first()
    assert row.mape == math.inf and row.r2 == 0.0
    assert ev.metrics_all(preds([2, 2], m=[2, 2])).first().r2 == 1.0


def test_horizons(preds):
    y, p = np.arange(1.0, 11.0), np.arange(2.0, 12.0)
    got = {r.horizon: r for r in ev.metrics_by_horizon(preds(y, m=p)).collect()}
    assert got[1].mae == 0.0 and got[3].mae == pytest.approx(2.0) and got[7].mae == pytest.approx(6.0)
    assert got[14].mae is None and got[14].mape is None and got[14].r2 is None


def test_baselines(daily, ordered):
    df = daily(new_cases=[float(i) for i in range(1, 11)])
    assert ordered(base.naive(df), "naive") == [1, 1, 2, 3, 4, 5, 6, 7, 8, 9]
    assert ordered(base.seasonal(df), "seasonal") == [1] * 8 + [2, 3]
    assert ordered(base.moving_average(df), "ma7")[:3] == [1, 1.5, 2]
    lagged = ordered(base.moving_average_lagged(df), "ma7_lagged")
    assert lagged[:7] == [5.5] * 7 and lagged[7:] == [4, 5, 6]
    assert base.baselines(df).count() == 30


def test_inverse_rmse_weights_and_fallback(preds):
    y = [10.0] * 20
    df = preds(y, good=[11.0] * 20, bad=[13.0] * 20)
    assert by_model(en.weights_inverse_rmse(df), "weight") == pytest.approx({"good": 0.75, "bad": 0.25})
    short = preds(y[:5], good=[11.0] * 5, bad=[13.0] * 5)
    assert by_model(en.weights_inverse_rmse(short, fallback={"good": 3, "bad": 1}), "weight") == {"good": 0.75, "bad": 0.25}
    exact = preds(y, good=y, bad=[13.0] * 20)
    assert by_model(en.weights_inverse_rmse(exact), "weight")["good"] == pytest.approx(1, abs=1e-6)


def test_ensemble_is_aligned_by_date(spark, preds):
    df = preds([1.0, 2.0, 3.0], a=[1.0, 2.0, 3.0], b=[3.0, 4.0, 5.0]).filter("not (model = 'b' and date = '2020-01-01')")
    out = en.ensemble_predict(df, en.weights_static(spark, {"a": 1, "b": 3})).orderBy("date").collect()
    assert [r.y_pred for r in out] == [3.5, 4.5] and str(out[0].date) == "2020-01-02"


def test_interval(preds):
    row = en.ensemble_interval(preds([1.0], a=[1.0], b=[9.0])).first()
    assert (row.mean, row.std, row.lower) == (5.0, 4.0, 0.0) and row.upper == pytest.approx(12.84)
    assert en.ensemble_interval(preds([1.0], a=[1.0], b=[9.0]), confidence=0.9).first().upper == 9.0


def test_optimal_weights_against_a_grid(preds):
    rng = np.random.default_rng(7)
    for trial in range(4):
        y = rng.normal(10, 3, 60)
        xs = {m: y + rng.normal(b, s, 60) for m, b, s in (("a", 0, 1 + trial), ("b", 1, 2), ("c", -2, 3))}
        got = by_model(en.weights_optimal(preds(y, **xs), list(xs)), "weight")
        assert sum(got.values()) == pytest.approx(1) and min(got.values()) >= 0
        mat = np.column_stack([xs[m] for m in xs])
        best = min(
            np.mean((y - mat @ np.array([i, j, 100 - i - j]) / 100) ** 2) for i in range(101) for j in range(101 - i)
        )
        mine = np.mean((y - mat @ np.array([got[m] for m in xs])) ** 2)
        assert mine <= best + 1e-9


def test_stacking_is_ridge(preds):
    rng = np.random.default_rng(2)
    y = rng.normal(10, 3, 50)
    xs = {"a": y + rng.normal(0, 1, 50), "b": y * 0.5 + rng.normal(0, 2, 50)}
    df = preds(y, **xs)
    coef = en.stacking_fit(df, ["a", "b"], alpha=1.0)
    x = np.column_stack([xs["a"], xs["b"]])
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + np.eye(2), xc.T @ yc)
    got = by_model(coef, "coefficient")
    assert [got["a"], got["b"]] == pytest.approx(list(want))
    assert got[en.INTERCEPT] == pytest.approx(y.mean() - x.mean(0) @ want)
    out = [r.y_pred for r in en.stacking_predict(df, coef).orderBy("date").collect()]
    assert out == pytest.approx(list(x @ want + y.mean() - x.mean(0) @ want))


def test_any_meta_learner(preds):
    from pyspark.ml.regression import LinearRegression

    y = np.arange(30.0)
    df = preds(y, a=y * 2, b=y + 1)
    model = en.stacking_with(df, ["a", "b"], LinearRegression(regParam=0.01))
    wide = en.align_predictions(df, ["a", "b"])
    assert model.transform(wide).filter(F.abs(F.col("prediction") - F.col("y_true")) > 1).count() == 0


def test_diebold_mariano(preds):
    rng = np.random.default_rng(4)
    y = rng.normal(0, 1, 40)
    a, b = y + rng.normal(0, 1, 40), y + rng.normal(0, 2, 40)
    for loss, cost in (("mse", np.square), ("mae", np.abs)):
        d = cost(y - a) - cost(y - b)
        stat = d.mean() / (d.std(ddof=1) / np.sqrt(40))
        row = ev.diebold_mariano(preds(y, a=a, b=b), "a", "b", loss).first()
        assert row.dm_stat == pytest.approx(stat)
        assert row.p_value == pytest.approx(2 * (1 - NormalDist().cdf(abs(stat))))
    with pytest.raises(ValueError):
        ev.diebold_mariano(preds(y, a=a, b=b), "a", "b", "mape")


def test_regimes_and_comparison(preds):
    y = [1.0] * 8 + [50.0]
    df = preds(y, a=y, b=[0.0] * 9)
    shares = {r.regime: r.rows for r in ev.regime_share(df.filter("model = 'a'")).collect()}
    assert shares == {"Endemic": 8, "Surge": 1}
    table = ev.model_comparison(ev.metrics_all(df), "b")
    assert by_model(table, "vs_baseline") == {"a": "Better", "b": "N/A"}
    assert ev.best_model(table).first().model == "a"


def greedy_peaks(v, height, distance):
    found, i, n = [], 1, len(v)
    while i < n - 1:
        if v[i - 1] < v[i]:
            j = i
            while j < n - 1 and v[j + 1] == v[i]:
                j += 1
            if j < n - 1 and v[j + 1] < v[i] and v[i] >= height:
                found.append((i + j) // 2)
            i = j
        i += 1
    keep = []
    for p in sorted(found, key=lambda k: (-v[k], -k)):
        if all(abs(p - q) >= distance for q in keep):
            keep.append(p)
    return sorted(keep)


@pytest.mark.parametrize("seed", range(4))
def test_peaks_against_brute_force(daily, seed):
    rng = np.random.default_rng(seed)
    v = np.repeat(rng.integers(0, 12, 120), rng.integers(1, 4, 120)).astype(float).tolist()
    got = sorted(r.pos for r in explore.peaks(daily(new_cases=v), "new_cases", NATIONAL, 5.0, 11).collect())
    assert got == greedy_peaks(v, 5.0, 11)


def test_correlations(daily):
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=50), rng.normal(size=50)
    df = daily("x double, c double, new_cases double", x=x.tolist(), c=[1.0] * 50, y=y.tolist())
    r = {row.column: row.r for row in explore.corr_target(df, ["x", "c"], "new_cases").collect()}
    assert r["x"] == pytest.approx(np.corrcoef(x, y)[0, 1]) and r["c"] is None
    lagged = {(row.column, row.lag): row.r for row in explore.lag_corr(df, ["x"], "new_cases", max_lag=5).collect()}
    assert lagged[("x", 3)] == pytest.approx(np.corrcoef(x[:-3], y[3:])[0, 1])
    assert explore.best_lag(explore.lag_corr(df, ["x"], "new_cases", max_lag=5)).count() == 1


def test_histogram_matches_numpy(daily):
    v = np.random.default_rng(1).normal(size=200)
    rows = explore.histogram_density(daily(new_cases=v.tolist()), "new_cases", 30).orderBy("bin").collect()
    counts, _ = np.histogram(v, bins=30)
    density, _ = np.histogram(v, bins=30, density=True)
    got = dict((r.bin, (r.rows, r.density)) for r in rows)
    assert [got.get(i, (0, 0))[0] for i in range(30)] == counts.tolist()
    assert [got.get(i, (0, 0))[1] for i in range(30)] == pytest.approx(density.tolist())


def test_ties_take_the_first_date(spark):
    rows = [("a", dt.date(2020, 1, i), v) for i, v in ((1, 5), (2, 9), (3, 9), (4, 1))]
    df = spark.createDataFrame(rows, "state string, date date, new_cases int")
    assert [str(r.date) for r in explore.nlargest(df, "new_cases", 2).collect()] == ["2020-01-02", "2020-01-03"]
    row = explore.peak_row(df, by=["state"]).first()
    assert (str(row.peak_date), row.latest) == ("2020-01-02", 1)
    assert explore.recent_rows(df, Panel("date", "state"), 2).count() == 2
