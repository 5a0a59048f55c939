"""Reading the four kinds of daily source."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ridgeline.functions.numeric import existing
from ridgeline.operators.clean import first_difference
from ridgeline.operators.merge import density_proxy, rename_map
from ridgeline.panel import NATIONAL

WIDE_DATE = "M/d/yy"
COUNTRY_COLUMN = "Country/Region"
PROVINCE_COLUMN = "Province/State"

# Long source names and the short names used everywhere else.
MOBILITY_NAMES = {
    "country_region": "country",
    "sub_region_1": "state",
    "sub_region_2": "district",
    "retail_and_recreation_percent_change_from_baseline": "retail_recreation",
    "grocery_and_pharmacy_percent_change_from_baseline": "grocery_pharmacy",
    "parks_percent_change_from_baseline": "parks",
    "transit_stations_percent_change_from_baseline": "transit",
    "workplaces_percent_change_from_baseline": "workplaces",
    "residential_percent_change_from_baseline": "residential",
}
MOBILITY_KEEP = ("date", "state", "retail_recreation", "grocery_pharmacy", "parks", "transit", "workplaces", "residential")
DAILY_JSON = (
    "struct<daily:struct<time:array<date>,temperature_2m_mean:array<double>,"
    "precipitation_sum:array<double>,relative_humidity_2m_mean:array<double>>>"
)


def read_wide_csv(spark: SparkSession, path: str, id_cols: int = 4) -> DataFrame:
    """Wide daily table: ``id_cols`` text columns, then one numeric column per day.

    The schema follows from the header line, so no pass over the data infers it.
    """
    header = spark.read.option("header", True).csv(path).schema
    fields = [f"`{f.name}` {'string' if i < id_cols else 'double'}" for i, f in enumerate(header)]
    return spark.read.schema(", ".join(fields)).option("header", True).csv(path)


def read_filtered_csv(spark: SparkSession, path: str, schema: str, condition: Column) -> DataFrame:
    """CSV scan with a declared schema and a filter the source can apply while reading."""
    return spark.read.schema(schema).option("header", True).csv(path).filter(condition)


def read_dates_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)


def read_population_csv(spark: SparkSession, path: str) -> DataFrame:
    return density_proxy(read_dates_csv(spark, path, "state string, population_millions double, population_density_estimate double"))


def scan_mobility(raw: DataFrame, country: str) -> DataFrame:
    """One country's rows under short names, keeping only the columns that exist."""
    named = rename_map(raw, MOBILITY_NAMES)
    return named.filter(F.col("country") == country).select(*existing(named, MOBILITY_KEEP))


def date_columns(df: DataFrame, fmt: str = WIDE_DATE) -> list[str]:
    """Columns whose name is a month/day/two-digit-year date."""
    import re

    return [c for c in df.columns if re.fullmatch(r"\d{1,2}/\d{1,2}/\d{2}", c)]


def wide_rows_to_days(wide: DataFrame, value: str, country: str | None = None, country_col: str = COUNTRY_COLUMN) -> DataFrame:
    """Date columns become rows, summed over provinces: (date, country, value)."""
    days = date_columns(wide)
    rows = wide if country is None else wide.filter(F.col(country_col) == country)
    melted = rows.select(country_col, *[F.col(f"`{d}`").cast("double").alias(d) for d in days]).unpivot(
        [country_col], [f"`{d}`" for d in days], "_day", "_value"
    )
    return (
        melted.select(F.col(country_col).alias("country"), F.to_date("_day", WIDE_DATE).alias("date"), "_value")
        .groupBy("date", "country")
        .agg(F.sum("_value").alias(value))
    )


def wide_to_long(
    confirmed: DataFrame, deaths: DataFrame | None, country: str, country_col: str = COUNTRY_COLUMN
) -> DataFrame:
    """(date, country, confirmed, deaths, new_cases, new_deaths) of one country.

    Days the deaths table lacks count zero deaths.
    """
    cases = wide_rows_to_days(confirmed, "confirmed", country, country_col)
    if deaths is None:
        joined = cases.withColumn("deaths", F.lit(0.0))
    else:
        dead = wide_rows_to_days(deaths, "deaths", country, country_col)
        joined = cases.join(dead, ["date", "country"], "left").withColumn("deaths", F.coalesce("deaths", F.lit(0.0)))
    return first_difference(joined, NATIONAL, {"new_cases": "confirmed", "new_deaths": "deaths"})


def json_arrays_to_rows(payload: Column, keep: Iterable[Column] = ()) -> list[Column]:
    """Select list turning a parsed ``daily`` payload of parallel arrays into one row per day."""
    daily = payload["daily"]
    zipped = F.arrays_zip(
        daily["time"].alias("date"),
        daily["temperature_2m_mean"].alias("temperature_mean"),
        daily["precipitation_sum"].alias("precipitation"),
        daily["relative_humidity_2m_mean"].alias("humidity_mean"),
    )
    named = F.transform(
        zipped,
        lambda z: F.struct(
            z["date"].alias("date"),
            z["temperature_mean"].alias("temperature_mean"),
            z["precipitation"].alias("precipitation"),
            z["humidity_mean"].alias("humidity_mean"),
        ),
    )
    return [*keep, F.inline(named)]


def weather_from_json(df: DataFrame, text_col: str, state_col: str = "state") -> DataFrame:
    """JSON text with parallel daily arrays -> (state, date, temperature, precipitation, humidity)."""
    parsed = df.select(F.col(state_col).alias("state"), F.from_json(text_col, DAILY_JSON).alias("p"))
    return parsed.select(*json_arrays_to_rows(F.col("p"), [F.col("state")]))


def read_weather_json(spark: SparkSession, path: str) -> DataFrame:
    """A folder of one JSON document per state; the state is the file name."""
    raw = spark.read.option("wholetext", True).text(path)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    return weather_from_json(raw.select(F.url_decode(name).alias("state"), F.col("value").alias("doc")), "doc")


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def read_available(spark: SparkSession, paths: dict[str, str], schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The sources whose path exists; later joins skip the others.  CSV sources need a declared schema."""
    out = {}
    for name, path in paths.items():
        if not path_exists(spark, path):
            continue
        if not path.endswith(".csv"):
            out[name] = spark.read.parquet(path)
        elif name in schemas:
            out[name] = read_dates_csv(spark, path, schemas[name])
        else:
            raise ValueError(f"no schema declared for the CSV source {name!r}")
    return out


def parse_dates(df: DataFrame, col: str = "date", fmt: str | None = None) -> DataFrame:
    if isinstance(df.schema[col].dataType, StringType):
        return df.withColumn(col, F.try_to_date(col, fmt) if fmt else F.try_to_date(col))
    return df.withColumn(col, F.col(col).cast("date"))


