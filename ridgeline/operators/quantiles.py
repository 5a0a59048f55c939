"""Exact, linearly interpolated quantiles of groups of any size.

Spark's ``percentile`` keeps every distinct value of a group in one task, which is right
for groups bounded by the calendar and wrong for a whole table.  For those, ranks are found by
radix selection: a first pass counts the values by sign and STEPS-th of a power of two, each further pass cuts the
part that holds a rank into PARTS equal parts between its smallest and largest value and counts again.  A part with one
value, or with the rank at one of its ends, needs no further pass.  Counts are summed map-side, so
only a few thousand per task and group are shuffled, whatever the size of the groups, and a result always exists.

The expressions are SQL text because there is one group of them per column and quantile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ridgeline.functions.keys import attach
from ridgeline.functions.numeric import quoted
from ridgeline.functions.sizing import written

PARTS = 4096
STEPS = 256


def exact_quantiles(
    df: DataFrame,
    cols: list[str],
    probs: list[float],
    by: list[str] | tuple[str, ...] = (),
    bounded: bool = False,
    parts: int = PARTS,
) -> DataFrame:
    """One row per group with, for each column, the array of its quantiles; NULL and NaN are left out.

    ``bounded=True`` states that a group is small by construction (a daily series).
    The unbounded plan reads ``df`` at once and several times, two or three as a rule; pass a stored frame if it is costly.
    """
    by = list(by)
    if bounded:
        fractions = f"array({', '.join(f'{float(p)}D' for p in probs)})"
        return df.groupBy(*by).agg(
            *[F.expr(f"percentile(cast({quoted(c)} AS double), {fractions}) AS {quoted(c)}") for c in cols]
        )
    return _selected(df, cols, probs, by, parts)


def quantile_struct(df: DataFrame, cols: list[str], probs: list[float], bounded: bool = False) -> Column:
    """The same quantiles over the whole frame as one struct, usable as a scalar subquery."""
    return exact_quantiles(df, cols, probs, bounded=bounded).select(F.struct(*cols)).scalar()


def _ranges(rows: list[Row]) -> dict[int, tuple[str, str]]:
    return {r["_slot"]: (f"double('{r['_lo']!r}')", f"double('{r['_hi']!r}')") for r in rows}


def _selected(df: DataFrame, cols: list[str], probs: list[float], by: list[str], parts: int) -> DataFrame:
    keys = [quoted(b) for b in by]
    names = [f"_q{i}" for i in range(len(cols))]
    # A slot is one (column, quantile) pair.
    slots = [(s, i, float(p)) for s, (i, p) in enumerate((i, p) for i in range(len(cols)) for p in probs)]
    values = df.selectExpr(
        *keys, *[f"CASE WHEN isnan(double({quoted(c)})) THEN NULL ELSE double({quoted(c)}) END AS {n}" for c, n in zip(cols, names)]
    )

    def pinned(state: DataFrame) -> DataFrame:
        """The state, computed: a row per slot, of every group."""
        if by:
            return written(state, "quantiles")
        return df.sparkSession.createDataFrame(state.collect(), state.schema)

    def counted(long: DataFrame, unit: str) -> DataFrame:
        """Every part's size, ends and place among the parts of its unit."""
        sized = long.groupBy(*by, unit, "_part").agg(F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        w = f"(PARTITION BY {', '.join([*keys, unit])} ORDER BY _part)"
        return sized.filter("_n > 0").selectExpr("*", f"sum(_n) OVER {w} AS _upto", f"lead(_lo) OVER {w} AS _next")

    def decided(found: DataFrame) -> DataFrame:
        """From the part that holds each slot's lower rank: the values at its ranks, where they are known already."""
        first = "CASE WHEN _lo = _hi OR _r0 = _from THEN _lo WHEN _r0 = _to - 1 THEN _hi END"
        second = "CASE WHEN _r1 = _r0 THEN _v0 WHEN _r1 >= _to THEN _next WHEN _lo = _hi THEN _lo WHEN _r1 = _to - 1 THEN _hi END"
        return (
            found.filter("_from <= _r0 AND _r0 < _to")
            .selectExpr(*keys, "_slot", "_r0", "_r1", "_share", "_from AS _below", "_lo", "_hi", "_to", "_next", f"{first} AS _v0")
            .selectExpr(*keys, "_slot", "_r0", "_r1", "_share", "_below", "_lo", "_hi", "_v0", f"{second} AS _v1")
        )

    def digit(v: str) -> str:
        step, zero = f"floor(least(log2(abs({v})), 1100D) * {STEPS})", 2000 * STEPS
        return f"CASE WHEN {v} = 0 THEN 0 WHEN {v} > 0 THEN {zero} + {step} WHEN {v} < 0 THEN -{zero} - {step} END"

    items = ", ".join(f"struct({i} AS _col, {digit(n)} AS _part, {n} AS _v)" for i, n in enumerate(names))
    powers = written(values.selectExpr(*keys, f"inline(array({items}))").groupBy(*by, "_col", "_part").agg(
        F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    ), "quantile-powers")
    group = ", ".join([*keys, "_col"])
    wanted = ", ".join(f"struct({s} AS _slot, {i} AS _of, {p!r}D AS _p)" for s, i, p in slots)
    placed = powers.filter("_n > 0").selectExpr(
        *keys, "_col", "_lo", "_hi", f"sum(_n) OVER (PARTITION BY {group} ORDER BY _part) - _n AS _from", f"sum(_n) OVER (PARTITION BY {group} ORDER BY _part) AS _to",
        f"sum(_n) OVER (PARTITION BY {group}) AS _all", f"lead(_lo) OVER (PARTITION BY {group} ORDER BY _part) AS _next",
    )
    ranked = placed.selectExpr("*", f"inline(array({wanted}))").filter("_of = _col").selectExpr("*", "_p * (_all - 1) AS _at").selectExpr("*", "cast(floor(_at) AS bigint) AS _r0", "cast(ceil(_at) AS bigint) AS _r1", "_at - floor(_at) AS _share")
    state = pinned(decided(ranked))
    done = []
    is_open = F.col("_v0").isNull() | F.col("_v1").isNull()
    while True:
        done.append(state.filter(~is_open))
        rest = state.filter(is_open)
        left = rest.select("_slot", "_lo", "_hi").collect() if not by else rest.select("_slot").distinct().collect()
        if not left:
            break
        column = {s: names[i] for s, i, _ in slots}
        open_slots = sorted({r["_slot"] for r in left})
        if by:
            edges = [x for s in open_slots for x in (F.max(F.when(F.col("_slot") == s, F.col("_lo"))).alias(f"_lo{s}"), F.max(F.when(F.col("_slot") == s, F.col("_hi"))).alias(f"_hi{s}"))]
            near = attach(values, written(rest.groupBy(*by).agg(*edges), "quantile-edges"), by)
            ends = {s: (f"_lo{s}", f"_hi{s}") for s in open_slots}
        else:
            # Two numbers per slot, whatever the size of the frame: literals, which the scan can filter on.
            ends = _ranges(left)
            near = values.filter(" OR ".join(f"{column[s]} BETWEEN {lo} AND {hi}" for s, (lo, hi) in ends.items()))
        cells = ", ".join(
            f"CASE WHEN {column[s]} BETWEEN {lo} AND {hi} THEN struct({s} AS _slot, least(floor(({column[s]} - {lo}) / ({hi} - {lo}) * {parts}), {parts - 1}) AS _part, {column[s]} AS _v) END"
            for s, (lo, hi) in ends.items()
        )
        parted = counted(near.selectExpr(*keys, f"inline(array_compact(array({cells})))"), "_slot")
        known = rest.select(*by, "_slot", "_r0", "_r1", "_share", "_below")
        met = attach(parted, known, [*by, "_slot"]).withColumns({"_from": F.col("_below") + F.col("_upto") - F.col("_n"), "_to": F.col("_below") + F.col("_upto")})
        state = pinned(decided(met))
    every = done[0].select(*by, "_slot", "_share", "_v0", "_v1")
    for more in done[1:]:
        every = every.union(more.select(*by, "_slot", "_share", "_v0", "_v1"))
    nothing = [F.lit(None).cast("double").alias(c) for c in ("_share", "_v0", "_v1")]
    every = every.union(powers.select(*by, F.lit(-1).alias("_slot"), *nothing).distinct())

    def of(i: int) -> Column:
        mine = ", ".join(f"max(CASE WHEN _slot = {s} THEN CASE WHEN _v0 = _v1 THEN _v0 ELSE _v0 + (_v1 - _v0) * _share END END)" for s, k, _ in slots if k == i)
        return F.expr(f"array({mine}) AS {quoted(cols[i])}")

    return every.groupBy(*by).agg(*[of(i) for i in range(len(cols))])
