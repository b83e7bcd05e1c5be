import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import SparkSession  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "America/New_York")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture
def grid(spark):
    """A long table from (time_idx, lat_idx, lon_idx, value) rows: days from 2001-01-01, degrees equal to positions."""

    def make(rows):
        return spark.createDataFrame(rows, "time_idx int, lat_idx int, lon_idx int, value double").selectExpr(
            "time_idx",
            "timestamp_ntz'2001-01-01' + make_dt_interval(time_idx) as time",
            "lat_idx", "cast(lat_idx as double) as lat", "lon_idx", "cast(lon_idx as double) as lon",
            "if(isnan(value), null, value) as value",
        )

    return make


@pytest.fixture
def series(spark):
    """A series from (date, value) pairs, in order; a date may be None."""

    def make(*rows, nan_to_null=True):
        numbered = [(i, day, value) for i, (day, value) in enumerate(rows)]
        value = "if(isnan(value), null, value) as value" if nan_to_null else "value"
        return spark.createDataFrame(numbered, "time_idx int, time string, value double").selectExpr(
            "time_idx", "cast(time as timestamp_ntz) as time", value
        )

    return make
