"""The long layout must equal the daily one, row for row, whatever the segment size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline import Panel
from ridgeline.operators import clean, explore, features, splits
from ridgeline.operators.segments import number_rows, over_rows, running_sum

PLAIN = Panel("date", "k", "tie")


@pytest.fixture(scope="module")
def raw(spark):
    """One series holds most rows; values have long gaps and a series is empty of values."""
    rng = np.random.default_rng(3)
    rows = []
    for k, n in {"hot": 900, "mid": 130, "tiny": 1, "void": 40}.items():
        for i in range(n):
            gap = k == "void" or (200 < i < 420) or rng.random() < 0.3
            rows.append((k, int(i // 7), i, None if gap else float(rng.integers(0, 50))))
    df = spark.createDataFrame(rows, "k string, d int, tie int, v double")
    df = df.withColumn("date", F.date_add(F.lit("2020-01-01"), F.col("d"))).drop("d").repartition(5)
    return df.persist()


def same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)

    def read(df):
        rows = sorted(map(tuple, df.select(*cols).collect()), key=str)
        return [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows]

    assert read(a) == read(b)


@pytest.mark.parametrize("size", [20, 100, 5000])
def test_every_ordered_operator(raw, size):
    long = Panel("date", "k", "tie", segment_rows=size)
    same(number_rows(raw, PLAIN), number_rows(raw, long))
    same(features.lag_features(raw, PLAIN, "v"), features.lag_features(raw, long, "v"))
    same(features.rolling_features(raw, PLAIN, "v"), features.rolling_features(raw, long, "v"))
    same(running_sum(raw, PLAIN, {"s": "v"}), running_sum(raw, long, {"s": "v"}))
    for how in ("ffill", "bfill", "ffill_bfill"):
        same(clean.fill(raw, PLAIN, ["v"], how), clean.fill(raw, long, ["v"], how))
    same(clean.interpolate_linear(raw, PLAIN, ["v"]), clean.interpolate_linear(raw, long, ["v"]))


def test_growth_lead_and_splits(raw):
    long = Panel("date", "k", "tie", segment_rows=50)
    filled = clean.fill(raw, PLAIN, ["v"]).na.fill(0.0)
    same(features.growth_features(filled, PLAIN, "v"), features.growth_features(filled, long, "v"))
    lead = lambda w: {"ahead": F.lead("v", 9).over(w)}
    same(over_rows(raw, PLAIN, lead, ahead=9), over_rows(raw, long, lead, ahead=9))
    same(splits.split_by_date(raw, PLAIN), splits.split_by_date(raw, long))
    same(splits.expanding_folds(raw, PLAIN, 3, 1), splits.expanding_folds(raw, long, 3, 1))
    same(explore.peak_candidates(filled, "v", PLAIN, 5.0), explore.peak_candidates(filled, "v", long, 5.0))
    same(features.sequences(filled, ["v"], "v", PLAIN), features.sequences(filled, ["v"], "v", long))


def test_one_long_series_without_keys(raw):
    hot = raw.filter("k = 'hot'").drop("k")
    same(number_rows(hot, Panel("date", (), "tie")), number_rows(hot, Panel("date", (), "tie", 64)))
    same(splits.split_by_date(hot, Panel("date", (), "tie")), splits.split_by_date(hot, Panel("date", (), "tie", 64)))


def test_no_task_holds_more_than_a_segment(raw):
    size, back = 100, 14
    long = Panel("date", "k", "tie", segment_rows=size)
    out = over_rows(raw, long, lambda w: {"rows": F.count(F.lit(1)).over(w.rowsBetween(-10**6, 10**6))}, back=back)
    assert out.agg(F.max("rows")).first()[0] <= size + back


def test_reach_longer_than_a_segment_is_refused(raw):
    with pytest.raises(ValueError):
        features.lag_features(raw, Panel("date", "k", "tie", segment_rows=10), "v", lags=(14,))


def test_panel_equals_single_series(raw):
    mid = raw.filter("k = 'mid'")
    both = features.rolling_features(raw, PLAIN, "v").filter("k = 'mid'")
    same(both, features.rolling_features(mid, Panel("date", (), "tie"), "v"))
