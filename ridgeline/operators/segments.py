"""Ordered operators for series of any length.

Each helper has two plans behind one signature.  A daily panel uses ordinary windows
over its series.  A long panel is numbered by a range-partitioned sort and cut into
segments of ``segment_rows`` rows:

* bounded reach (lag, lead, rolling): each segment borrows the few rows it needs from
  its neighbours, so the window runs inside ``(series, segment)``;
* unbounded reach (running sum, fills): one row per segment is summarised, the small
  segment table is prefixed, and the carry is joined back on ``(series, segment)``.

Either way one task holds at most a segment, even when one series has most of the rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ridgeline.functions.keys import attach
from ridgeline.functions.sizing import durable
from ridgeline.panel import Panel, so_far

# Names of the columns that live inside an operator; no column of a caller's is read or replaced by them.
POS = "_ridgeline_pos"
SEGMENT = "_ridgeline_segment"
_ROW = "_ridgeline_row"
_PART = "_ridgeline_part"


def number_rows(df: DataFrame, panel: Panel, name: str = "pos") -> DataFrame:
    """Add the 0-based position of each row inside its series."""
    if not panel.long:
        return df.withColumn(name, (F.row_number().over(panel.window()) - 1).cast("long"))
    # The range sort is balanced on the whole key, so a hot series or a hot day is
    # spread over many partitions.  The row ids depend on that layout, hence durable().
    keys = [F.col(c) for c in panel.keys]
    placed = durable(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn(_ROW, F.monotonically_increasing_id())
    ).withColumn(_PART, F.shiftright(F.col(_ROW), 33))
    group = [*panel.series, _PART]
    parts = placed.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.min(_ROW).alias("_first"))
    earlier = Window.partitionBy(*panel.series).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(*group, "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    return (
        attach(placed, starts, group, "left")
        .withColumn(name, F.col(_ROW) - F.col("_first") + F.col("_start"))
        .drop(_ROW, _PART, "_first", "_start")
    )


def series_length(df: DataFrame, panel: Panel, name: str = "n") -> DataFrame:
    """Add the number of rows of each row's series."""
    if not panel.long:
        return df.withColumn(name, F.count(F.lit(1)).over(Window.partitionBy(*panel.series)))
    if not panel.series:
        total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
        return df.withColumn(name, total)
    sizes = df.groupBy(*panel.series).agg(F.count(F.lit(1)).alias(name))
    return attach(df, sizes, list(panel.series), "left")


def _segment_of(panel: Panel) -> Column:
    return F.floor(F.col(POS) / F.lit(panel.segment_rows))


def with_halo(df: DataFrame, panel: Panel, back: int = 0, ahead: int = 0) -> DataFrame:
    """The rows of every segment and, again, those up to ``back`` before and ``ahead`` after it: a column for the segment,
    one for the position, and ``_home`` for a segment's own rows.  A daily series is one segment."""
    placed = df if POS in df.columns else number_rows(df, panel, POS)
    if not panel.long:
        return placed.withColumns({SEGMENT: F.lit(0).cast("long"), "_home": F.lit(True)})
    size = panel.segment_rows
    if back > size or ahead > size:
        raise ValueError(f"segment_rows={size} is shorter than the reach ({back} back, {ahead} ahead)")
    home, offset = _segment_of(panel), F.col(POS) % F.lit(size)
    copies = [home]
    if back:
        copies.append(F.when(offset >= size - back, home + 1))
    if ahead:
        copies.append(F.when((offset < ahead) & (home > 0), home - 1))
    spread = placed.withColumn(SEGMENT, F.explode(F.array_compact(F.array(*copies))))
    return spread.withColumn("_home", F.col(SEGMENT) == home)


def over_rows(
    df: DataFrame,
    panel: Panel,
    build: Callable[[WindowSpec], dict[str, Column]],
    back: int = 0,
    ahead: int = 0,
) -> DataFrame:
    """Add columns computed over at most ``back`` earlier and ``ahead`` later rows."""
    if not panel.long:
        return df.withColumns(build(panel.window()))
    given_pos = POS in df.columns
    spread = with_halo(df, panel, back, ahead)
    w = Window.partitionBy(*panel.series, SEGMENT).orderBy(POS)
    out = spread.withColumns(build(w)).filter("_home").drop(SEGMENT, "_home")
    return out if given_pos else out.drop(POS)


def running_sum(df: DataFrame, panel: Panel, sums: dict[str, str]) -> DataFrame:
    """Add ``{new: source}`` running totals; a NULL source stays NULL and adds nothing."""
    if not panel.long:
        w = so_far(panel.window())
        return df.withColumns({n: F.when(F.col(c).isNotNull(), F.sum(c).over(w)) for n, c in sums.items()})
    given_pos = POS in df.columns
    placed = (df if given_pos else number_rows(df, panel, POS)).withColumn(SEGMENT, _segment_of(panel))
    group = [*panel.series, SEGMENT]
    totals = placed.groupBy(*group).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    earlier = Window.partitionBy(*panel.series).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*group, *[F.sum(f"_t_{n}").over(earlier).alias(f"_c_{n}") for n in sums])
    joined = attach(placed, carried, group, "left")
    w = so_far(Window.partitionBy(*group).orderBy(POS))
    out = joined.withColumns(
        {
            n: F.when(F.col(c).isNotNull(), F.sum(c).over(w) + F.coalesce(F.col(f"_c_{n}"), F.lit(0)))
            for n, c in sums.items()
        }
    ).drop(SEGMENT, *[f"_c_{n}" for n in sums])
    return out if given_pos else out.drop(POS)


BOTH = ("prev", "next")


def with_neighbours(df: DataFrame, panel: Panel, cols: list[str], sides: tuple[str, ...] = BOTH) -> DataFrame:
    """Add ``_prev_c`` / ``_next_c``: the nearest known value at or before / at or after
    each row as ``struct(pos, v)``, and the row's own position.

    Looking forward is a running frame over the reversed order: a frame that ends at
    unbounded following would be re-read for every row.
    """
    placed = df if POS in df.columns else number_rows(df, panel, POS)
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(POS).alias("pos"), F.col(c).alias("v"))) for c in cols}
    if not panel.long:
        order = {"prev": panel.window(), "next": panel.latest_first()}
        return placed.withColumns(
            {f"_{s}_{c}": F.last(k, True).over(so_far(order[s])) for s in sides for c, k in known.items()}
        )
    placed = placed.withColumn(SEGMENT, _segment_of(panel))
    group = [*panel.series, SEGMENT]
    ends = placed.groupBy(*group).agg(
        *[F.max(k).alias(f"_prev_{c}") for c, k in known.items()],
        *[F.min(k).alias(f"_next_{c}") for c, k in known.items()],
    )
    across = Window.partitionBy(*panel.series)
    outer = {"prev": across.orderBy(SEGMENT), "next": across.orderBy(F.col(SEGMENT).desc())}
    carried = ends.select(
        *group,
        *[
            F.last(f"_{s}_{c}", True).over(outer[s].rowsBetween(Window.unboundedPreceding, -1)).alias(f"_carry_{s}_{c}")
            for s in sides
            for c in cols
        ],
    )
    joined = attach(placed, carried, group, "left")
    inside = Window.partitionBy(*group)
    inner = {"prev": inside.orderBy(POS), "next": inside.orderBy(F.col(POS).desc())}
    near = {
        f"_{s}_{c}": F.coalesce(F.last(k, True).over(so_far(inner[s])), F.col(f"_carry_{s}_{c}"))
        for s in sides
        for c, k in known.items()
    }
    return joined.withColumns(near).drop(SEGMENT, *[f"_carry_{s}_{c}" for s in sides for c in cols])


def drop_neighbours(df: DataFrame, cols: list[str], keep_pos: bool = False) -> DataFrame:
    helpers = [f"_prev_{c}" for c in cols] + [f"_next_{c}" for c in cols]
    return df.drop(*helpers) if keep_pos else df.drop(POS, *helpers)
