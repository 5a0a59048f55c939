"""Joining cases, mobility, weather and population at national or state level."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.numeric import existing, numeric_columns, require
from ridgeline.operators.clean import MOBILITY, WEATHER, daily_mean, fill
from ridgeline.panel import BY_STATE, NATIONAL, Panel

# Slices of the population table per shuffle partition when every state meets every day.
SLICES_PER_PARTITION = 4


def fill_numeric(df: DataFrame, panel: Panel) -> DataFrame:
    """Forward then backward fill of every numeric column, within each series."""
    return fill(df, panel, [c for c in numeric_columns(df) if c not in panel.keys])


def merge_national(cases: DataFrame, mobility: DataFrame | None = None, weather: DataFrame | None = None) -> DataFrame:
    """Cases left-joined with the daily means of the other sources; absent sources are skipped."""
    out = cases
    for source, cols in ((mobility, MOBILITY), (weather, WEATHER)):
        if source is not None and existing(source, cols):
            out = out.join(daily_mean(source, cols), "date", "left")
    return fill_numeric(out, NATIONAL)


def merge_on_date(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    return left.join(right, "date", how)


def merge_outer(cases: DataFrame, mobility: DataFrame) -> DataFrame:
    """Full outer join on date, then every column filled forward and backward."""
    return fill(merge_on_date(cases, mobility, "full_outer"), NATIONAL)


def population_share(demographics: DataFrame, col: str = "population_millions") -> DataFrame:
    total = demographics.agg(F.sum(col).alias("t")).scalar()
    return demographics.withColumn("pop_proportion", F.try_divide(F.col(col), total))


def density_proxy(demographics: DataFrame) -> DataFrame:
    return demographics.withColumn("population_density_estimate", F.col("population_millions") * 0.5)


def allocate_by_population(
    cases: DataFrame, demographics: DataFrame, slices: int | None = None
) -> DataFrame:
    """Give every state its population share of each national day, rounded half to even.

    The result has a row per state and day by definition.  States are hashed into slices and
    each (calendar-bounded) day is sent once to every slice, so the pairing is an ordinary
    equi-join: it is spread over the slices and needs no broadcast of the growing side.
    """
    if slices is None:
        slices = SLICES_PER_PARTITION * int(cases.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    require(cases, "date")
    require(demographics, "state", "population_millions")
    share = population_share(demographics).select(
        "state", "population_millions", "pop_proportion", F.pmod(F.xxhash64("state"), F.lit(slices)).alias("_slice")
    )
    days = cases.drop("state", "population_millions").withColumn(
        "_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long")))
    )
    scaled = {
        c: F.bround(F.col(c) * F.col("pop_proportion"), 0)
        for c in existing(cases, ("confirmed", "deaths", "new_cases"))
    }
    return (
        days.join(share, "_slice")
        .withColumns(scaled)
        .withColumn("estimated_population", F.col("population_millions"))
        .drop("_slice", "pop_proportion")
    )


def merge_panel(
    cases: DataFrame, mobility: DataFrame | None, weather: DataFrame | None, panel: Panel = BY_STATE
) -> DataFrame:
    """State panel left-joined with mobility and weather on (state, date), filled per state."""
    out = cases
    for source in (mobility, weather):
        if source is not None:
            out = out.join(source, ["state", "date"], "left")
    return fill_numeric(out, panel)


def master_dataset(datasets: dict[str, DataFrame], level: str = "national") -> DataFrame:
    """National or state master table from whichever of the four sources are present."""
    cases = datasets.get("cases")
    if cases is None:
        raise ValueError("cases are required")
    if level == "national":
        return merge_national(cases, datasets.get("mobility"), datasets.get("weather"))
    if level != "state":
        raise ValueError(f"unknown level {level!r}")
    demographics = datasets.get("demographics")
    if demographics is None:
        raise ValueError("demographics are required at state level")
    states = allocate_by_population(cases, demographics)
    return merge_panel(states, datasets.get("mobility"), datasets.get("weather"))


def union_states(frames: list[DataFrame]) -> DataFrame:
    """Stack frames by column name; columns a frame lacks become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def rename_map(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def holiday_windows(calendar: DataFrame) -> DataFrame:
    """Explode each holiday over its window so that matching dates is an equi-join."""
    first = F.date_add("ds", F.col("lower_window"))
    last = F.date_add("ds", F.col("upper_window"))
    return calendar.select("holiday", F.explode(F.sequence(first, last)).alias("date"))


def holiday_features(df: DataFrame, calendar: DataFrame, names: list[str]) -> DataFrame:
    """One 0/1 column per holiday name for each row's date."""
    days = holiday_windows(calendar).groupBy("date").agg(
        *[F.max((F.col("holiday") == n).cast("int")).alias(holiday_column(n)) for n in names]
    )
    flags: dict[str, Column] = {holiday_column(n): F.coalesce(F.col(holiday_column(n)), F.lit(0)) for n in names}
    return df.join(days, "date", "left").withColumns(flags)


def holiday_column(name: str) -> str:
    return "holiday_" + name.lower().replace(" ", "_")


# The festival falls on a different day each year.
FESTIVAL_DATES = ("2020-11-14", "2021-11-04", "2022-10-24", "2023-11-12", "2024-11-01")
ANNUAL_HOLIDAYS = (("Republic Day", 1, 26), ("Independence Day", 8, 15), ("Gandhi Jayanti", 10, 2))
HOLIDAY_NAMES = ["Republic Day", "Independence Day", "Gandhi Jayanti", "Diwali"]
CALENDAR_SCHEMA = "holiday string, ds date, lower_window int, upper_window int"


def holiday_calendar(spark, first_year: int = 2020, last_year: int = 2024, window: int = 1) -> DataFrame:
    """Annual holidays for the years asked for, plus the listed festival days inside them."""
    return calendar_of_years(spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("y")), window)


def calendar_for(df: DataFrame, order: str = "date", window: int = 1, festivals: Iterable[str] = FESTIVAL_DATES) -> DataFrame:
    """The holidays of the frame's own years and of a year on either side, so that windows and forecasts
    that cross into one are covered.  ``festivals`` lists the moving days; a year of the data without one is an error, as its
    flag would silently be 0 throughout (pass no festivals at all to leave them out)."""
    festivals = list(festivals)
    listed = sorted({int(d[:4]) for d in festivals})
    named = F.col("y").isin(listed) if listed else F.lit(True)
    year = F.when(named, F.col("y")).otherwise(F.raise_error(F.concat(F.lit("no festival is listed for "), F.col("y").cast("string"))).cast("int"))
    seen = df.select(F.year(order).alias("y")).filter("y is not null").distinct().select(year.alias("y"))
    return calendar_of_years(seen.select(F.explode(F.sequence(F.col("y") - 1, F.col("y") + 1)).alias("y")).distinct(), window, festivals)


def calendar_of_years(years: DataFrame, window: int = 1, festivals: Iterable[str] = FESTIVAL_DATES) -> DataFrame:
    """Annual holidays of each year ``y``, plus the listed festival days inside these years."""
    annual = F.array(
        *[F.struct(F.lit(n).alias("holiday"), F.make_date("y", F.lit(m), F.lit(d)).alias("ds")) for n, m, d in ANNUAL_HOLIDAYS]
    )
    fixed = years.select(F.inline(annual))
    days = F.array(*[F.lit(d) for d in festivals]).cast("array<string>")
    moving = years.select("y", F.explode(days).alias("d")).select("y", F.lit("Diwali").alias("holiday"), F.to_date("d").alias("ds"))
    moving = moving.filter(F.year("ds") == F.col("y")).drop("y")
    return fixed.unionByName(moving).select(
        "holiday", "ds", F.lit(-window).alias("lower_window"), F.lit(window).alias("upper_window")
    )
