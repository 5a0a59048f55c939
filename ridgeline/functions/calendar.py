"""Calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# National holidays as (month, day), and the autumn festival days.
FIXED_HOLIDAYS = ((1, 26), (8, 15), (10, 2))
FESTIVAL_MONTHS = (10, 11)
FESTIVAL_FIRST_DAY = 20
FESTIVAL_LAST_DAY = 30


def is_major_holiday(date: Column) -> Column:
    month, day = F.month(date), F.dayofmonth(date)
    hit = month.isin(*FESTIVAL_MONTHS) & day.between(FESTIVAL_FIRST_DAY, FESTIVAL_LAST_DAY)
    for m, d in FIXED_HOLIDAYS:
        hit = hit | ((month == m) & (day == d))
    return hit.cast("int")


def cyclic(value: Column, period: int) -> tuple[Column, Column]:
    angle = 2 * F.pi() * value / period
    return F.sin(angle), F.cos(angle)


def temporal_columns(date: Column) -> dict[str, Column]:
    """The eleven calendar features of a date, Monday being day 0."""
    dow, month = F.weekday(date), F.month(date)
    dow_sin, dow_cos = cyclic(dow, 7)
    month_sin, month_cos = cyclic(month, 12)
    return {
        "day_of_week": dow,
        "day_of_month": F.dayofmonth(date),
        "month": month,
        "year": F.year(date),
        "week_of_year": F.weekofyear(date),
        "is_weekend": (dow >= 5).cast("int"),
        "day_of_week_sin": dow_sin,
        "day_of_week_cos": dow_cos,
        "month_sin": month_sin,
        "month_cos": month_cos,
        "is_major_holiday": is_major_holiday(date),
    }
