"""Exploratory summaries: profiles, correlations, trends, histograms and peaks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ridgeline.functions.keys import attach
from ridgeline.functions.numeric import INF, pearson, quoted
from ridgeline.functions.sizing import written
from ridgeline.operators.quantiles import exact_quantiles
from ridgeline.operators.segments import POS, SEGMENT, number_rows, over_rows, with_halo
from ridgeline.panel import NATIONAL, Panel


def _long(row: DataFrame, cols: list[str], label: str, fields: list[str]) -> DataFrame:
    """Turn a one-row frame of per-column structs into one row per column."""
    items = [F.struct(F.lit(c).alias(label), *[F.col(c)[f].alias(f) for f in fields]) for c in cols]
    return row.select(F.inline(F.array(*items)))


def describe(df: DataFrame, cols: list[str], bounded: bool = False) -> DataFrame:
    """(column, count, mean, std, min, q25, q50, q75, max) with exact quartiles."""
    moments = df.agg(
        *[
            F.struct(
                F.count(c).alias("count"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(c).cast("double").alias("min"),
                F.max(c).cast("double").alias("max"),
            ).alias(c)
            for c in cols
        ]
    )
    long = _long(moments, cols, "column", ["count", "mean", "std", "min", "max"])
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75], bounded=bounded).select(F.struct(*cols)).scalar()
    pick = F.array(*[F.struct(F.lit(c).alias("column"), F.col("_q")[c].alias("q")) for c in cols])
    quart = long.withColumn("_q", q).withColumn("_q", F.filter(pick, lambda x: x["column"] == F.col("column"))[0]["q"])
    return quart.select(
        "column", "count", "mean", "std", "min",
        F.col("_q")[0].alias("q25"), F.col("_q")[1].alias("q50"), F.col("_q")[2].alias("q75"), "max",
    )


def _count_each(df: DataFrame, conds: dict[str, Column], name: str) -> DataFrame:
    row = df.agg(*[F.struct(F.count_if(p).alias(name)).alias(c) for c, p in conds.items()])
    return _long(row, list(conds), "column", [name])


def null_counts(df: DataFrame, cols: list[str] | None = None, keep_zero: bool = False) -> DataFrame:
    out = _count_each(df, {c: F.col(c).isNull() for c in cols or df.columns}, "nulls")
    return out if keep_zero else out.filter("nulls > 0")


def inf_counts(df: DataFrame, cols: list[str], keep_zero: bool = False) -> DataFrame:
    out = _count_each(df, {c: F.abs(F.col(c)) == F.lit(INF) for c in cols}, "infinities")
    return out if keep_zero else out.filter("infinities > 0")


def count_where(df: DataFrame, conds: dict[str, Column]) -> DataFrame:
    return _count_each(df, conds, "rows")


def date_range_stats(df: DataFrame, col: str = "new_cases", by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.count(F.lit(1)).alias("days"),
        F.max(col).alias("peak"),
        F.avg(col).alias("mean"),
        F.stddev_samp(col).alias("std"),
    )


def peak_row(df: DataFrame, col: str = "new_cases", by: list[str] | None = None) -> DataFrame:
    """Date of the largest value (the first such date) and the latest value, per group."""
    best = F.max(F.struct(F.col(col).alias("v"), (-F.unix_date("date")).alias("d")))
    return df.groupBy(*(by or [])).agg(
        F.max(col).alias("peak"),
        F.date_from_unix_date(-best["d"]).alias("peak_date"),
        F.max_by(col, "date").alias("latest"),
    )


def recent_rows(df: DataFrame, panel: Panel, rows: int) -> DataFrame:
    """Last ``rows`` rows of each series."""
    if not panel.series:
        return df.orderBy(*[F.col(c).desc() for c in panel.keys]).limit(rows)
    return df.withColumn("_rank", F.row_number().over(panel.latest_first())).filter(F.col("_rank") <= rows).drop("_rank")


def tail_mean(df: DataFrame, cols: list[str], panel: Panel = NATIONAL, rows: int = 30) -> DataFrame:
    tail = recent_rows(df, panel, rows)
    return tail.groupBy(*panel.series).agg(*[F.avg(c).alias(f"{c}_last_{rows}_mean") for c in cols])


def share_of_rows(df: DataFrame, col: str) -> DataFrame:
    """Row count and share of each value of a column."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.sum("rows").alias("n")).scalar()  # over the counts, not the rows again
    return counts.withColumn("share", F.col("rows") / total)


def corr_target(df: DataFrame, cols: list[str], target: str, by: list[str] | None = None) -> DataFrame:
    """Correlation of each column with the target: one aggregation, one row per column."""
    by = by or []
    row = df.groupBy(*by).agg(*[pearson(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in cols])
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("r")) for c in cols])
    return row.select(*by, F.inline(items))


def corr_ranked(df: DataFrame, cols: list[str], target: str, top: int = 15) -> DataFrame:
    """Columns by descending |r| with the target; ties by name."""
    ranked = corr_target(df, cols, target).withColumn("r_abs", F.abs("r")).select("column", "r_abs")
    return ranked.orderBy(F.col("r_abs").desc_nulls_last(), "column").limit(top)


def topk_abs(corrs: DataFrame, k: int = 4) -> DataFrame:
    return corrs.orderBy(F.abs("r").desc_nulls_last(), "column").limit(k)


#: Of one pair of columns in a block, over the rows where both are known: rows, means, sums of squared and mixed deviations, ends.
PAIR = ["n", "mx", "my", "vx", "vy", "vxy", "x_lo", "x_hi", "y_lo", "y_hi"]


def _pair_schema(keys: str) -> str:
    return ", ".join([keys, "n long", *[f"{c} double" for c in PAIR[1:]]])


def _pair_correlation(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Merge the blocks of every pair: deviations from a block's means are carried over to the means of all rows, so
    no digits are lost to large values.  NULL for fewer than two rows or a side without variation."""
    w = Window.partitionBy(*keys)
    rows = F.sum("n").over(w)
    dx, dy = (F.col(m) - F.try_divide(F.sum(F.col("n") * F.col(m)).over(w), rows) for m in ("mx", "my"))
    moved = blocks.withColumns({"_dx": dx, "_dy": dy})
    total = moved.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum(F.expr("vx + n * _dx * _dx")).alias("vx"), F.sum(F.expr("vy + n * _dy * _dy")).alias("vy"),
        F.sum(F.expr("vxy + n * _dx * _dy")).alias("vxy"), (F.min("x_lo") < F.max("x_hi")).alias("_x"), (F.min("y_lo") < F.max("y_hi")).alias("_y"),
    )
    r = F.try_divide(F.col("vxy"), F.sqrt("vx") * F.sqrt("vy"))
    return total.select(*keys, F.when((F.col("n") > 1) & F.col("_x") & F.col("_y"), r).alias("r"))


def _pair_block(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """PAIR of every column of x with the same column of y; NaN is missing."""
    both = ~(np.isnan(x) | np.isnan(y))
    n = both.sum(0)
    means = [np.divide(np.where(both, v, 0.0).sum(0), n, out=np.zeros(v.shape[1]), where=n > 0) for v in (x, y)]
    dx, dy = (np.where(both, v - m, 0.0) for v, m in zip((x, y), means))
    ends = [f(np.where(both, v, fill), axis=0, initial=fill) for v in (x, y) for f, fill in ((np.min, np.inf), (np.max, -np.inf))]
    return np.column_stack([n, *means, (dx * dx).sum(0), (dy * dy).sum(0), (dx * dy).sum(0), *ends])


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two blocks of the same pairs as one."""
    n = a[:, 0] + b[:, 0]
    share = np.divide(b[:, 0], n, out=np.zeros(len(n)), where=n > 0)
    dx, dy = b[:, 1] - a[:, 1], b[:, 2] - a[:, 2]
    cross = a[:, 0] * share
    means = [np.where(a[:, 0] > 0, a[:, 1 + k] + d * share, b[:, 1 + k]) for k, d in enumerate((dx, dy))]
    sums = [a[:, 3 + k] + b[:, 3 + k] + cross * d for k, d in enumerate((dx * dx, dy * dy, dx * dy))]
    ends = [f(a[:, 6 + k], b[:, 6 + k]) for k, f in enumerate((np.minimum, np.maximum, np.minimum, np.maximum))]
    return np.column_stack([n, *means, *sums, *ends])


def _numbers(batch: pa.RecordBatch | pa.Table, names: list[str]) -> np.ndarray:
    table = batch if isinstance(batch, pa.Table) else pa.Table.from_batches([batch])
    return np.column_stack([table.column(c).to_numpy() for c in names]).astype(float)


def _pair_rows(held: np.ndarray, keys: dict[str, np.ndarray]) -> pa.RecordBatch:
    columns = [*keys.values(), held[:, 0].astype(np.int64), *held[:, 1:].T]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(v)) for v in columns], names=[*keys, *PAIR])


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pairwise-complete correlations as (row, column, r); NaN counts as missing.

    A task keeps one block of moments of all pairs, whatever its rows; only blocks are shuffled.
    """
    names = [f"_{i}" for i in range(len(cols))]
    left, right = np.triu_indices(len(cols))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            x = _numbers(batch, names)
            block = _pair_block(x[:, left], x[:, right])
            held = block if held is None else _merged(held, block)
        if held is not None:
            yield _pair_rows(held, {"i": left, "j": right})

    rows = df.select(*[F.col(quoted(c)).cast("double").alias(n) for c, n in zip(cols, names)])
    half = _pair_correlation(rows.mapInArrow(add, _pair_schema("i long, j long")), ["i", "j"])
    name = F.array(*[F.lit(c) for c in cols])
    pair = half.select(name[F.col("i")].alias("a"), name[F.col("j")].alias("b"), "r")
    both = F.array(*[F.struct(F.col(x).alias("row"), F.col(y).alias("column"), F.col("r")) for x, y in ("ab", "ba")])
    return pair.select(F.inline(F.when(F.col("a") == F.col("b"), F.slice(both, 1, 1)).otherwise(both)))


def lag_corr(df: DataFrame, cols: list[str], target: str, panel: Panel = NATIONAL, max_lag: int = 20) -> DataFrame:
    """(column, lag, r): correlation of the target with each column shifted by 0..max_lag rows; NaN counts as missing.

    A segment of consecutive rows, with the few before it, is one task's block; it keeps the moments of all lags.
    """
    names = [f"_{i}" for i in range(len(cols))]
    near = with_halo(df.select(*panel.keys, *dict.fromkeys([target, *cols])), panel, back=max_lag)
    columns = [F.col(quoted(c)).cast("double").alias(n) for c, n in zip([*cols, target], [*names, "_y"])]
    rows = near.select(*[F.col(quoted(c)) for c in panel.series], SEGMENT, POS, "_home", *columns)
    lags = np.arange(max_lag + 1)

    def add(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table.column(POS).to_numpy())))
        x, y = _numbers(table, names), _numbers(table, ["_y"])
        home = table.column("_home").to_numpy()
        blocks = [_pair_block(x[: max(len(x) - k, 0)][home[k:]], np.repeat(y[k:][home[k:]], len(names), axis=1)) for k in lags]
        keys = {"c": np.tile(np.arange(len(names)), len(lags)), "lag": np.repeat(lags, len(names)).astype(np.int32)}
        return pa.Table.from_batches([_pair_rows(np.concatenate(blocks), keys)])

    blocks = rows.groupBy(*panel.series, SEGMENT).applyInArrow(add, _pair_schema("c long, lag int"))
    found = _pair_correlation(blocks, ["c", "lag"])
    every = df.sparkSession.range(len(cols) * (max_lag + 1)).select(
        F.floor(F.col("id") / (max_lag + 1)).alias("c"), (F.col("id") % (max_lag + 1)).cast("int").alias("lag")
    )
    name = F.array(*[F.lit(c) for c in cols])
    return every.join(found, ["c", "lag"], "left").select(name[F.col("c")].alias("column"), "lag", "r")


def best_lag(lagged: DataFrame) -> DataFrame:
    """Lag with the largest |r| per column; the smallest lag wins a tie."""
    best = F.max(F.struct(F.abs("r").alias("a"), (-F.col("lag")).alias("k"), F.col("r").alias("r")))
    return lagged.filter(F.col("r").isNotNull()).groupBy("column").agg(best.alias("b")).select(
        "column", (-F.col("b")["k"]).alias("lag"), F.col("b")["r"].alias("r")
    )


def linear_trend(df: DataFrame, cols: list[str], target: str, points: int = 100) -> DataFrame:
    """Least-squares line of the target on each column, evaluated on an even grid."""
    fits = df.agg(
        *[
            F.struct(
                F.regr_slope(target, c).alias("slope"),
                F.regr_intercept(target, c).alias("intercept"),
                F.min(c).cast("double").alias("lo"),
                F.max(c).cast("double").alias("hi"),
            ).alias(c)
            for c in cols
        ]
    )
    lines = _long(fits, cols, "column", ["slope", "intercept", "lo", "hi"])
    grid = lines.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("point") / (points - 1)
    return grid.select("column", "slope", "intercept", "point", x.alias("x"), (F.col("intercept") + F.col("slope") * x).alias("y"))


def top_trends(df: DataFrame, cols: list[str], target: str, top: int = 4, points: int = 100) -> DataFrame:
    """``linear_trend`` on the ``top`` columns by absolute correlation with the target: that many names reach the driver."""
    best = [r["column"] for r in topk_abs(corr_target(df, cols, target), top).collect()]
    return linear_trend(df, best, target, points)


def histogram_density(df: DataFrame, col: str, bins: int = 30, by: list[str] | None = None) -> DataFrame:
    """Equal-width bins with counts and density per group; the last bin includes its upper edge."""
    by = by or []
    known = df.filter(F.col(col).isNotNull()).select(*by, F.col(col).cast("double").alias("_v"))
    range_ = known.groupBy(*by).agg(
        F.struct(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count("_v").alias("n")).alias("_b")
    )
    # A few numbers per group: stored, so that the planner knows how small they are before it joins.
    framed = attach(known, written(range_, "bounds"), by) if by else known.withColumn("_b", range_.scalar())
    width = (F.col("_b.hi") - F.col("_b.lo")) / bins
    place = F.least(F.floor(F.try_divide(F.col("_v") - F.col("_b.lo"), width)), F.lit(bins - 1))
    counted = framed.select(*by, "_b", F.coalesce(place, F.lit(0)).cast("int").alias("bin")).groupBy(*by, "_b", "bin")
    return counted.agg(F.count(F.lit(1)).alias("rows")).select(
        *by,
        "bin",
        (F.col("_b.lo") + width * F.col("bin")).alias("left_edge"),
        "rows",
        F.try_divide(F.col("rows"), F.col("_b.n") * width).alias("density"),
    )


def nlargest(df: DataFrame, col: str, n: int = 5) -> DataFrame:
    """The n largest rows; the earlier date wins a tie."""
    return df.orderBy(F.col(col).desc_nulls_last(), "date").limit(n)


def pivot_mean(df: DataFrame, rows: str, columns: str, values: list[str], measure: str) -> DataFrame:
    """Mean of a measure per row key and column key, rounded to whole numbers (half to even)."""
    wide = df.groupBy(rows).pivot(columns, values).agg(F.avg(measure))
    return wide.select(rows, *[F.bround(v, 0).alias(v) for v in values])


def peak_candidates(df: DataFrame, col: str, panel: Panel, height: float) -> DataFrame:
    """(series, pos, value): strict local maxima at or above ``height``; a flat top counts once, at its middle row."""
    numbered = df if POS in df.columns else number_rows(df, panel, POS)

    def run_starts(w) -> dict[str, Column]:
        return {"_prev": F.lag(col, 1).over(w), "_rising": F.lag(col, 1).over(w) < F.col(col)}

    # Only rows where the value changes matter; consecutive changes bound each flat run.
    steps = over_rows(numbered, panel, run_starts, back=1).filter(F.col("_prev").isNull() | (F.col("_prev") != F.col(col)))
    # Positions of the kept rows have holes, so the lead over them is taken on a fresh numbering.
    bare = steps.withColumnRenamed(POS, "_at")
    bounded = over_rows(bare, panel, lambda w: {"_next": F.lead(col, 1).over(w), "_next_at": F.lead("_at", 1).over(w)}, ahead=1)
    top = F.col("_rising") & (F.col("_next") < F.col(col)) & (F.col(col) >= height)
    middle = F.floor((F.col("_at") + F.col("_next_at") - 1) / 2)
    return bounded.filter(top).select(*panel.series, middle.alias("pos"), F.col(col).cast("double").alias("value"))


def _around(df: DataFrame, panel: Panel, reach: int, build: Callable[[WindowSpec], dict[str, Column]]) -> DataFrame:
    """Columns over the rows whose ``pos`` is at most ``reach`` away.  Positions are cut into stretches that take in
    the rows near their ends from the neighbours, so a long series is spread over tasks."""
    stretch = max(4 * reach, 4096)
    home = F.floor(F.col("pos") / F.lit(stretch))
    places = F.sequence(F.greatest(F.floor((F.col("pos") - reach) / F.lit(stretch)), F.lit(0)), F.floor((F.col("pos") + reach) / F.lit(stretch)))
    spread = df.withColumn(SEGMENT, F.explode(places))
    w = Window.partitionBy(*panel.series, SEGMENT).orderBy("pos").rangeBetween(-reach, reach)
    return spread.withColumns(build(w)).filter(F.col(SEGMENT) == home).drop(SEGMENT)


def peaks(df: DataFrame, col: str, panel: Panel = NATIONAL, height: float = 50_000.0, distance: int = 60) -> DataFrame:
    """Local maxima at least ``distance`` rows apart, the higher one winning, the later one of equals.

    Taking the highest first is a matter of its neighbourhood alone: in a round every candidate that is the highest
    of the undecided ones around it is kept, and those close to a kept one go.  Rounds repeat until
    nothing is undecided; a round needs windows of ``distance`` rows only.
    """
    numbered = written(number_rows(df, panel, POS), "numbered")
    reach = distance - 1
    rest = written(peak_candidates(numbered, col, panel, height), "peaks")
    kept: list[DataFrame] = []
    while rest.limit(1).count():
        score = F.struct("value", "pos")
        elected = _around(rest, panel, reach, lambda w: {"_kept": F.max(score).over(w) == score})
        marked = written(_around(elected, panel, reach, lambda w: {"_near": F.max("_kept").over(w)}), "peaks")
        kept.append(marked.filter("_kept").drop("_kept", "_near"))
        rest = marked.filter("NOT _near").drop("_kept", "_near")
    survivors = reduce(DataFrame.union, kept, rest)
    dates = numbered.select(*panel.series, F.col(POS).alias("pos"), panel.order)
    return attach(survivors, dates, [*panel.series, "pos"])
