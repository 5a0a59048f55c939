"""The keys that give a frame its order.

A reference user relies on row order; a DataFrame has none, so every operator is
told which column orders the rows, which columns split them into series and which
columns break ties.

Two layouts exist:

* daily (default) - at most one row per ``(series, order)``.  A series is then no
  longer than the calendar (a century is 36 525 rows), whatever the volume of the
  raw data, and a window over it is bounded by construction.
* long (``segment_rows`` set) - raw rows, any number per series.  No window ever
  spans a whole series: rows are numbered by a range-partitioned sort and cut into
  segments of ``segment_rows``; see ``ridgeline.operators.segments``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def _names(value: str | tuple[str, ...] | list[str] | None) -> tuple[str, ...]:
    if value is None:
        return ()
    return (value,) if isinstance(value, str) else tuple(value)


@dataclass(frozen=True)
class Panel:
    order: str = "date"
    series: tuple[str, ...] = ()
    ties: tuple[str, ...] = ()
    segment_rows: int | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "series", _names(self.series))
        object.__setattr__(self, "ties", _names(self.ties))

    @property
    def long(self) -> bool:
        return self.segment_rows is not None

    @property
    def keys(self) -> tuple[str, ...]:
        return (*self.series, self.order, *self.ties)

    def with_series(self, *extra: str) -> "Panel":
        return Panel(self.order, (*self.series, *extra), self.ties, self.segment_rows)

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.series).orderBy(self.order, *self.ties)

    def latest_first(self) -> WindowSpec:
        keys = [F.col(c).desc() for c in (self.order, *self.ties)]
        return Window.partitionBy(*self.series).orderBy(*keys)


NATIONAL = Panel("date")
BY_STATE = Panel("date", ("state",))


def trailing(w: WindowSpec, rows: int, closed: str = "right") -> WindowSpec:
    """Frame of ``rows`` rows ending at the current row, or just before it (``closed='left'``)."""
    if closed == "right":
        return w.rowsBetween(-(rows - 1), 0)
    if closed == "left":
        return w.rowsBetween(-rows, -1)
    raise ValueError(f"closed must be 'right' or 'left', not {closed!r}")


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def same_keys(left: str, right: str, keys: tuple[str, ...]) -> Column:
    """Null-safe equality of ``keys`` between two aliased frames."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return cond
