import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from ridgeline.operators import ensemble as en
from ridgeline.sources import readers, writers

WIDE = """Province/State,Country/Region,Lat,Long,1/22/20,1/23/20,1/24/20
,India,1,2,1,3,2
North,India,1,2,10,10,15
,Chad,1,2,5,5,5
"""
DEATHS = """Province/State,Country/Region,Lat,Long,1/22/20,1/23/20
,India,1,2,0,1
,Chad,1,2,5,5
"""


def test_wide_csv_to_daily_rows(spark, tmp_path):
    (tmp_path / "c.csv").write_text(WIDE)
    (tmp_path / "d.csv").write_text(DEATHS)
    confirmed = readers.read_wide_csv(spark, str(tmp_path / "c.csv"))
    assert dict(confirmed.dtypes)["1/22/20"] == "double" and dict(confirmed.dtypes)["Lat"] == "string"
    deaths = readers.read_wide_csv(spark, str(tmp_path / "d.csv"))
    out = readers.wide_to_long(confirmed, deaths, "India").orderBy("date").collect()
    assert [str(r.date) for r in out] == ["2020-01-22", "2020-01-23", "2020-01-24"]
    assert [r.confirmed for r in out] == [11, 13, 17] and [r.new_cases for r in out] == [0, 2, 4]
    assert [r.deaths for r in out] == [0, 1, 0] and [r.new_deaths for r in out] == [0, 1, 0]
    assert [r.deaths for r in readers.wide_to_long(confirmed, None, "India").collect()] == [0, 0, 0]


def test_filtered_csv_pushes_its_filter(spark, tmp_path):
    (tmp_path / "m.csv").write_text(
        "country_region,sub_region_1,sub_region_2,date,workplaces_percent_change_from_baseline\n"
        "India,Goa,North,2020-02-15,-3\nChad,,,2020-02-15,9\nIndia,,,2020-02-16,\n"
    )
    schema = "country_region string, sub_region_1 string, sub_region_2 string, date date, workplaces_percent_change_from_baseline double"
    raw = readers.read_filtered_csv(spark, str(tmp_path / "m.csv"), schema, F.col("country_region") == "India")
    out = readers.scan_mobility(raw, "India")
    assert out.columns == ["date", "state", "workplaces"]
    assert {tuple(r) for r in out.collect()} == {(dt.date(2020, 2, 15), "Goa", -3.0), (dt.date(2020, 2, 16), None, None)}
    assert "PushedFilters: [IsNotNull(country_region), EqualTo(country_region,India)]" in out._jdf.queryExecution().executedPlan().toString()


def test_weather_folder(spark, tmp_path):
    for state, t in (("Goa", [20.5, None]), ("Tamil Nadu", [30.0, 31.0])):
        doc = {"daily": {"time": ["2020-01-01", "2020-01-02"], "temperature_2m_mean": t, "precipitation_sum": [0.0, 1.5], "relative_humidity_2m_mean": [60, 75]}}
        (tmp_path / f"{state}.json").write_text(json.dumps(doc))
    out = {(r.state, str(r.date)): r.temperature_mean for r in readers.read_weather_json(spark, str(tmp_path)).collect()}
    assert out == {("Goa", "2020-01-01"): 20.5, ("Goa", "2020-01-02"): None, ("Tamil Nadu", "2020-01-01"): 30.0, ("Tamil Nadu", "2020-01-02"): 31.0}


def test_available_sources_and_population(spark, tmp_path):
    (tmp_path / "demo.csv").write_text("state,population_millions,population_density_estimate\nGoa,1.5,0\n")
    found = readers.read_available(spark, {"demographics": str(tmp_path / "demo.csv"), "weather": str(tmp_path / "no.csv")}, {"demographics": "state string, population_millions double"})
    assert list(found) == ["demographics"]
    assert readers.read_population_csv(spark, str(tmp_path / "demo.csv")).first().population_density_estimate == 0.75


def test_dates_that_do_not_parse_become_null(spark):
    df = spark.createDataFrame([("2020-01-02",), ("x",)], "date string")
    assert {r.date for r in readers.parse_dates(df).collect()} == {dt.date(2020, 1, 2), None}


@pytest.fixture()
def table(spark):
    return spark.createDataFrame([(dt.date(2020, 1, d), s, float(d)) for d in (1, 2) for s in "ab"], "date date, state string, v double")


def test_tables_round_trip(spark, tmp_path, table):
    writers.write_csv(table, str(tmp_path / "csv"))
    back = readers.read_dates_csv(spark, str(tmp_path / "csv"), "date date, state string, v double")
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in table.collect()}
    writers.write_panel(table, str(tmp_path / "panel"), "state", 4)
    assert spark.read.parquet(str(tmp_path / "panel")).count() == 4
    writers.write_feature_list(spark, ["x", "y"], str(tmp_path / "names"))
    assert [r.feature for r in spark.read.json(str(tmp_path / "names")).orderBy("position").collect()] == ["x", "y"]


def test_stage_is_built_once(spark, tmp_path, table):
    calls = []

    def build():
        calls.append(1)
        return table

    for _ in range(2):
        assert writers.reuse_or_build(spark, str(tmp_path / "stage"), build).count() == 4
    assert len(calls) == 1


def test_weights_round_trip_with_defaults(spark, tmp_path):
    writers.write_json(en.weights_static(spark, {"a": 1.0, "b": 1.0}), str(tmp_path / "w"))
    got = {r.model: r.weight for r in writers.read_weights(spark, str(tmp_path / "w"), {"a": 0.3, "b": 0.3, "c": 1.0}).collect()}
    assert got == {"a": 0.25, "b": 0.25, "c": 0.5}
