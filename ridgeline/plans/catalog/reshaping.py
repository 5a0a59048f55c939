"""Scans, renames, wide/long reshapes and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgeline.functions.sizing import scratch_path, written
from ridgeline.operators import merge
from ridgeline.operators.ensemble import weights_inverse_rmse
from ridgeline.plans import views
from ridgeline.plans.catalog import query, rounded
from ridgeline.plans.catalog.exploring import predictions
from ridgeline.plans.oracle import MOB, WX, fill_sql, r, rs, sql
from ridgeline.sources import readers, stages, writers

# The day columns of the wide stand-in: the first of every month from the first to the last order.
# Two-digit years are read as 20xx, so the stand-in is dated 25 years after the orders.
SHIFT_YEARS = 25
COUNTRY = "NATION_7"


def months_of(orders):
    """The months from the first to the last order, as column names: two dates reach the driver."""
    month = F.add_months(F.trunc("o_orderdate", "month"), 12 * SHIFT_YEARS)
    first, last = orders.agg(F.min(month), F.max(month)).first()
    if first is None:
        return []
    return [f"{m % 12 + 1}/1/{m // 12 % 100:02d}" for m in range(first.year * 12 + first.month - 1, last.year * 12 + last.month)]


def wide_orders(spark, sf, only_status=None):
    """Orders by priority and nation, one column per month, as a wide daily table."""
    orders = views.table(spark, sf, "orders")
    if only_status:
        orders = orders.filter(F.col("o_orderstatus") == only_status)
    months = months_of(orders)
    labelled = orders.select(
        F.col("o_custkey").alias("c_custkey"),
        F.col("o_orderpriority").alias(readers.PROVINCE_COLUMN),
        F.date_format(F.add_months(F.trunc("o_orderdate", "month"), 12 * SHIFT_YEARS), readers.WIDE_DATE).alias("month"),
    ).groupBy("c_custkey", readers.PROVINCE_COLUMN, "month").agg(F.count(F.lit(1)).alias("n"))
    customer = views.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    named = labelled.join(customer, "c_custkey").join(views.nations(spark, sf, "c_nationkey"), "c_nationkey")
    keys = [F.col(f"`{readers.PROVINCE_COLUMN}`"), F.col("state").alias(readers.COUNTRY_COLUMN)]
    return named.groupBy(*keys).pivot("month", months).agg(F.sum("n")).na.fill(0)


_month_grid = (
    "SELECT c.country, m.date, {cols} FROM (SELECT n_name AS country FROM nation) c CROSS JOIN "
    "(SELECT unnest(generate_series((SELECT date_trunc('month', min(o_orderdate)) + INTERVAL 25 YEAR FROM orders), (SELECT date_trunc('month', max(o_orderdate)) + INTERVAL 25 YEAR FROM orders), INTERVAL 1 MONTH))::DATE AS date) m LEFT JOIN "
    "(SELECT n_name AS country, (date_trunc('month', o_orderdate) + INTERVAL 25 YEAR)::DATE AS date, count(*) AS c, count(*) FILTER (WHERE o_orderstatus = 'F') AS d "
    "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) x USING (country, date)"
)


@query("scan_wide_long", sql(_month_grid.format(cols="coalesce(c, 0)::DOUBLE AS confirmed")))
def scan_wide_long(spark, sf):
    return readers.wide_rows_to_days(wide_orders(spark, sf), "confirmed")


@query(
    "wide_to_long",
    sql(
        "SELECT country, date, confirmed, deaths, greatest(coalesce(confirmed - lag(confirmed) OVER (ORDER BY date), 0), 0)::DOUBLE AS new_cases, "
        "greatest(coalesce(deaths - lag(deaths) OVER (ORDER BY date), 0), 0)::DOUBLE AS new_deaths FROM g WHERE country = 'NATION_7'",
        extra={"g": _month_grid.format(cols="coalesce(c, 0)::DOUBLE AS confirmed, coalesce(d, 0)::DOUBLE AS deaths")},
    ),
)
def wide_to_long(spark, sf):
    confirmed = wide_orders(spark, sf)
    deaths = wide_orders(spark, sf, "F")
    return readers.wide_to_long(confirmed, deaths, COUNTRY)


def raw_report(spark, sf):
    """Line items under the long column names of a mobility report; parks is absent."""
    return views.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("country_region"),
        F.col("l_linestatus").alias("sub_region_1"),
        views.day("l_shipdate").alias("date"),
        F.col("l_quantity").alias("retail_and_recreation_percent_change_from_baseline"),
        F.col("l_discount").alias("workplaces_percent_change_from_baseline"),
        F.col("l_tax").alias("residential_percent_change_from_baseline"),
    )


@query(
    "scan_filtered",
    "SELECT CAST(l_shipdate AS DATE) AS date, l_linestatus AS state, l_quantity AS retail_recreation, "
    "l_discount AS workplaces, l_tax AS residential FROM lineitem WHERE l_returnflag = 'R'",
)
def scan_filtered(spark, sf):
    return readers.scan_mobility(raw_report(spark, sf), "R")


@query(
    "rename_map",
    "SELECT l_returnflag AS country, l_linestatus AS state, CAST(l_shipdate AS DATE) AS date, "
    "l_quantity AS retail_recreation, l_discount AS workplaces, l_tax AS residential FROM lineitem",
)
def rename_map(spark, sf):
    return merge.rename_map(raw_report(spark, sf), readers.MOBILITY_NAMES)


@query("json_arrays_to_rows", sql(f"SELECT state, date, {rs(WX, 9)} FROM weather", "weather"))
def json_arrays_to_rows(spark, sf):
    rows = views.weather(spark, sf)
    # One document per state and year: at most 366 elements per array.
    by_year = rows.groupBy("state", F.year("date").alias("year")).agg(
        F.array_sort(F.collect_list(F.struct("date", *WX))).alias("d")
    )
    doc = F.struct(
        F.struct(
            F.col("d.date").alias("time"),
            F.col("d.temperature_mean").alias("temperature_2m_mean"),
            F.col("d.precipitation").alias("precipitation_sum"),
            F.col("d.humidity_mean").alias("relative_humidity_2m_mean"),
        ).alias("daily")
    )
    return rounded(readers.weather_from_json(by_year.select("state", F.to_json(doc).alias("doc")), "doc"), 9)


@query(
    "dim_density",
    sql("SELECT state, population_millions, population_millions * 0.5::DOUBLE AS population_density_estimate FROM demo", "demo"),
)
def dim_density(spark, sf):
    return views.demographics(spark, sf)


@query(
    "union_states",
    sql(
        "SELECT state, date, new_cases, new_deaths, confirmed, deaths, "
        + ", ".join(f"NULL::DOUBLE AS {c}" for c in MOB)
        + " FROM state_cases UNION ALL SELECT state, date, NULL, NULL, NULL, NULL, "
        + ", ".join(r(c) for c in MOB)
        + " FROM mobility",
        "state_cases",
        "mobility",
    ),
)
def union_states(spark, sf):
    return merge.union_states([views.cases_by_state(spark, sf), rounded(views.mobility(spark, sf))])


@query("scan_wide_csv", sql(_month_grid.format(cols="coalesce(c, 0)::DOUBLE AS confirmed")))
def scan_wide_csv(spark, sf):
    """The wide table written as CSV and scanned back under a schema built from its header."""
    path = scratch_path(spark, "wide")
    writers.write_csv(wide_orders(spark, sf), path)
    return readers.wide_rows_to_days(readers.read_wide_csv(spark, path, id_cols=2), "confirmed")


@query("sink_csv", sql(f"SELECT state, date, {rs(WX)} FROM weather", "weather"))
def sink_csv(spark, sf):
    path = scratch_path(spark, "weather")
    writers.write_csv(views.weather(spark, sf).select("state", "date", *WX), path)
    return rounded(readers.read_dates_csv(spark, path, "state string, date date, " + ", ".join(f"{c} double" for c in WX)))


@query("sink_json", sql("SELECT model, round(weight, 9) + 0.0 AS weight FROM weights", "weights"))
def sink_json(spark, sf):
    """Weights written as JSON and restored."""
    path = scratch_path(spark, "weights")
    writers.write_json(weights_inverse_rmse(predictions(spark, sf)), path)
    return rounded(writers.read_weights(spark, path, {"naive": 0.3, "seasonal": 0.4, "ma7": 0.3}), 9)


@query("sink_panel", sql(f"SELECT state, date, {', '.join(f'{c}' for c in ('new_cases', 'new_deaths'))} FROM state_daily", "state_daily"))
def sink_panel(spark, sf):
    """The panel stored once in buckets of its series, then reused."""
    path = scratch_path(spark, "panel")
    writers.write_panel(views.daily_cases_by_state(spark, sf), path, "state", 8)
    stored = writers.reuse_or_build(spark, path, lambda: views.daily_cases_by_state(spark, sf))
    return stored.select("state", "date", "new_cases", "new_deaths")


def _stage_of(spark, sf, min_cases):
    """Daily national cases above a threshold, as a content-addressed stage; the marker tells which call built it."""

    def build(min_cases):
        return views.daily_cases(spark, sf).filter(F.col("new_cases") >= min_cases)

    return lambda root: stages.stage(spark, root, "daily", build, [f"{sf}/orders.parquet"], {"min_cases": min_cases})


_from = "SELECT date, new_cases, new_deaths FROM daily WHERE new_cases >= {}"


@query("stage_built", sql(_from.format(2), "daily"))
def stage_built(spark, sf):
    return _stage_of(spark, sf, 2)(scratch_path(spark, "stages"))


@query("stage_reused", sql(f"SELECT 2 AS folders, * FROM ({_from.format(1)} UNION ALL {_from.format(2)} UNION ALL {_from.format(1)})", "daily"))
def stage_reused(spark, sf):
    """Two settings of a stage, one of them asked for twice: the second time it is read, so two folders are there."""
    root = scratch_path(spark, "stages")
    asked = [_stage_of(spark, sf, n)(root) for n in (1, 2, 1)]
    folders = len({p.rsplit("/", 2)[1] for p, _, _ in stages.files_under(spark, root)})
    return merge.union_states(asked).select(F.lit(folders).alias("folders"), "date", "new_cases", "new_deaths")


@query("folder_of_files", sql("SELECT state, date, new_cases, CASE WHEN state < 'NATION_2' THEN new_deaths END AS new_deaths FROM state_daily", "state_daily"))
def folder_of_files(spark, sf):
    """One CSV file per state, delivered in two parts of different columns and taken in twice, each file once."""
    folder, store = scratch_path(spark, "delivered"), scratch_path(spark, "taken")
    cases = written(views.daily_cases_by_state(spark, sf), "cases")
    schema = "state string, date date, new_cases long, new_deaths long"
    early = F.col("state") < "NATION_2"
    parts = [cases.filter(early).select("new_deaths", "date", "state", "new_cases"), cases.filter(~early).select("state", "date", "new_cases")]
    for i, part in enumerate(parts):
        part.withColumn("file", F.col("state")).repartition("file").write.partitionBy("file").option("header", True).csv(f"{folder}/{i}")
        taken = stages.take_in(spark, folder, store, schema)
    return stages.take_in(spark, folder, store, schema).drop("source_file")


@query("optional_sources", sql(f"SELECT date, new_cases, new_deaths, confirmed, deaths, {rs(WX, 9)} FROM f", "cases", "wx_nat", extra={"m": "SELECT * FROM cases LEFT JOIN wx_nat USING (date)", "f": fill_sql("m", ["date"], ["new_cases", "new_deaths", "confirmed", "deaths", *WX])}))
def optional_sources(spark, sf):
    """Cases as CSV and weather as Parquet are there, mobility is not: what exists is read, merged and stored."""
    root = scratch_path(spark, "sources")
    writers.write_csv(views.cases(spark, sf), f"{root}/cases.csv")
    writers.write_table(views.weather(spark, sf), f"{root}/weather")
    paths = {"cases": f"{root}/cases.csv", "mobility": f"{root}/mobility.csv", "weather": f"{root}/weather"}
    schemas = {"cases": "date date, new_cases long, new_deaths long, confirmed long, deaths long", "mobility": "date date"}
    out = stages.load_and_merge(spark, paths, schemas, merge.master_dataset, f"{root}/master")
    return rounded(out.select("date", "new_cases", "new_deaths", "confirmed", "deaths", *WX), 9)
