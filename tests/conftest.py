import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def daily(spark):
    """Build a national daily frame from columns of values, dated from 2020-01-01."""
    import datetime as dt

    def build(schema="new_cases double", start=dt.date(2020, 1, 1), **cols):
        n = len(next(iter(cols.values())))
        rows = [(start + dt.timedelta(days=i), *[c[i] for c in cols.values()]) for i in range(n)]
        return spark.createDataFrame(rows, f"date date, {schema}")

    return build


@pytest.fixture(scope="session")
def ordered():
    """Collect one column in date order."""

    def read(df, col, *keys):
        return [row[col] for row in df.orderBy(*(keys or ("date",))).collect()]

    return read
