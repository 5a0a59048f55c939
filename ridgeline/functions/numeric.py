"""Column expressions for arithmetic that must survive ANSI mode, NULL, NaN and infinities.

Missing values are NULL everywhere; NaN and infinities only live inside an expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType

INF = float("inf")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)]


def float_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))]


def quoted(name: str) -> str:
    """A column name as SQL text."""
    return "`" + name.replace("`", "``") + "`"


def existing(df: DataFrame, wanted: list[str] | tuple[str, ...]) -> list[str]:
    """Those of ``wanted`` that the frame has, in the wanted order."""
    have = set(df.columns)
    return [c for c in wanted if c in have]


def columns_containing(df: DataFrame, part: str) -> list[str]:
    return [c for c in df.columns if part in c]


def plain_name(name: str) -> str:
    """SQL text of a key as people write it: underscores and repeated white space become one blank, words are capitalised."""
    return f"initcap(trim(regexp_replace(replace({quoted(name)}, '_', ' '), '\\\\s+', ' ')))"


def require(df: DataFrame, *cols: str) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"required column(s) missing: {', '.join(missing)}")


def finite_sql(name: str) -> str:
    """SQL text of a double column with NaN and infinities read as NULL."""
    c = quoted(name)
    return f"CASE WHEN isnan({c}) OR abs({c}) = double('Infinity') THEN NULL ELSE {c} END"


def finite(c: Column) -> Column:
    """NULL for NaN and for both infinities."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(INF)), None).otherwise(c)


def not_nan(c: Column) -> Column:
    return F.when(F.isnan(c), None).otherwise(c)


def clip(c: Column, lo=None, hi=None) -> Column:
    """Bound a value; NULL stays NULL (``greatest``/``least`` would drop it)."""
    out = None
    for bound, outside in ((lo, lambda b: c < b), (hi, lambda b: c > b)):
        if bound is None:
            continue
        b = bound if isinstance(bound, Column) else F.lit(bound)
        out = F.when(outside(b), b) if out is None else out.when(outside(b), b)
    return c if out is None else out.otherwise(c)


def pct_change(cur: Column, prev: Column) -> Column:
    """cur/prev - 1 with a signed infinity over a zero base and NULL for 0/0."""
    over_zero = F.when(cur > 0, F.lit(INF)).when(cur < 0, F.lit(-INF))
    return F.when(prev == 0, over_zero).otherwise(F.try_divide(cur, prev) - 1)


def flag(cond: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is unknown."""
    return F.coalesce(cond.cast("int"), F.lit(0))


def pearson(x: Column, y: Column) -> Column:
    """Pairwise-complete correlation aggregate; NULL when either side is constant."""
    xx = F.when(y.isNotNull(), x)
    yy = F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(xx) * F.stddev_samp(yy))


def min_max_scaled(c: Column, lo: Column, hi: Column) -> Column:
    width = F.when(hi - lo == 0, F.lit(1.0)).otherwise(hi - lo)
    return (c - lo) / width
