"""The order-and-shipment tables seen as daily health-style panels.

``orders`` by customer nation are the cases, ``lineitem`` by supplier nation gives the six
mobility and three weather measures, customers per nation are the population.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions.sizing import fits_broadcast
from ridgeline.operators.clean import MOBILITY
from ridgeline.operators.merge import density_proxy
from ridgeline.operators.segments import running_sum
from ridgeline.panel import BY_STATE, NATIONAL

# Fixed values: (returnflag, linestatus) behind each mobility measure.
MOBILITY_FLAGS = (("A", "F"), ("A", "O"), ("N", "F"), ("N", "O"), ("R", "F"), ("R", "O"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(col: str) -> Column:
    return F.col(col).cast("date")


def _by_nation(
    facts: DataFrame, dim: DataFrame, key: str, nation_key: str, nations: DataFrame, partial: dict[str, Column]
) -> DataFrame:
    """Sum ``partial`` columns of the facts per (state, date).

    While the dimension passes the broadcast size check, the facts are joined in place and
    only per-day sums are shuffled.  Beyond it, the facts are first summed per (key, date),
    which also shrinks a key that holds a large part of the rows, and then joined.
    """
    sums = {n: F.sum(c).alias(n) for n, c in partial.items()}
    again = {n: F.sum(n).alias(n) for n in partial}
    if fits_broadcast(dim):
        placed = facts.join(F.broadcast(dim), key).groupBy(nation_key, "date").agg(*sums.values())
    else:
        shrunk = facts.groupBy(key, "date").agg(*sums.values())
        placed = shrunk.join(dim, key).groupBy(nation_key, "date").agg(*again.values())
    return placed.join(nations, nation_key).drop(nation_key)


def nations(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias(key), F.col("n_name").alias("state"))


def daily_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """National (date, new_cases, new_deaths)."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(day("o_orderdate").alias("date")).agg(
        F.count(F.lit(1)).alias("new_cases"), F.count_if(F.col("o_orderstatus") == "F").alias("new_deaths")
    )


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """National cases with running totals."""
    return running_sum(daily_cases(spark, sf_dir), NATIONAL, {"confirmed": "new_cases", "deaths": "new_deaths"})


def daily_cases_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", day("o_orderdate").alias("date"), "o_orderstatus")
    orders = orders.withColumnRenamed("o_custkey", "c_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    partial = {"new_cases": F.lit(1).cast("long"), "new_deaths": (F.col("o_orderstatus") == "F").cast("long")}
    return _by_nation(orders, customer, "c_custkey", "c_nationkey", nations(spark, sf_dir, "c_nationkey"), partial)


def cases_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return running_sum(
        daily_cases_by_state(spark, sf_dir), BY_STATE, {"confirmed": "new_cases", "deaths": "new_deaths"}
    )


def _shipments(spark: SparkSession, sf_dir: str, cols: list[str], partial: dict[str, Column]) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("s_suppkey"), day("l_shipdate").alias("date"), *cols
    )
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return _by_nation(lines, supplier, "s_suppkey", "s_nationkey", nations(spark, sf_dir, "s_nationkey"), partial)


def _mobility_sums() -> dict[str, Column]:
    partial = {}
    for name, (flag, status) in zip(MOBILITY, MOBILITY_FLAGS):
        hit = (F.col("l_returnflag") == flag) & (F.col("l_linestatus") == status)
        partial[f"_s_{name}"] = F.when(hit, F.col("l_quantity")).otherwise(0.0)
        partial[f"_n_{name}"] = hit.cast("long")
    return partial


def _mobility_means() -> list[Column]:
    return [F.try_divide(F.col(f"_s_{n}"), F.col(f"_n_{n}")).alias(n) for n in MOBILITY]


def _weather_sums() -> dict[str, Column]:
    """Rates are summed in whole hundredths, so thresholds never depend on the order of additions."""
    return {
        "_t": F.col("l_quantity"),
        "_p": F.round(F.col("l_discount") * 100).cast("long"),
        "_h": F.round(F.col("l_tax") * 100).cast("long"),
        "_n": F.lit(1).cast("long"),
    }


def _weather_means() -> list[Column]:
    return [
        (F.col("_t") / F.col("_n")).alias("temperature_mean"),
        (F.col("_p") / (F.col("_n") * 100)).alias("precipitation"),
        (F.col("_h") * 10 / F.col("_n")).alias("humidity_mean"),
    ]


def mobility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(state, date) with six conditional means, NULL where no line has those flags."""
    sums = _shipments(spark, sf_dir, ["l_quantity", "l_returnflag", "l_linestatus"], _mobility_sums())
    return sums.select("state", "date", *_mobility_means())


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(state, date) with temperature, precipitation and humidity stand-ins."""
    sums = _shipments(spark, sf_dir, ["l_quantity", "l_discount", "l_tax"], _weather_sums())
    return sums.select("state", "date", *_weather_means())


def mobility_and_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sets of measures from one scan of the line items."""
    cols = ["l_quantity", "l_returnflag", "l_linestatus", "l_discount", "l_tax"]
    sums = _shipments(spark, sf_dir, cols, _mobility_sums() | _weather_sums())
    return sums.select("state", "date", *_mobility_means(), *_weather_means())


def demographics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(state, population_millions, population_density_estimate) from customers per nation."""
    people = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    named = people.join(nations(spark, sf_dir, "c_nationkey"), "c_nationkey")
    return density_proxy(named.select("state", F.col("n").cast("double").alias("population_millions")))
