"""Grids that already are tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graticule.functions import calendar
from graticule.functions.missing import clean
from graticule.spec import DEFAULT, GridSpec, MissingRole

IDS = ("dataset_id", "variable")


def ingest_table(df: DataFrame, spec: GridSpec = DEFAULT, units: str | None = None, time_calendar: str = "standard") -> DataFrame:
    """Brings a long table to the engine's form: doubles with NULL for NaN, and a time without a zone.

    Instants are taken in UTC. A numeric time is decoded by ``units``, such as "days since 1850-01-01". A time that does
    not parse becomes NULL and keeps its text in the column ``time_raw``; it never fails the job.
    """
    if spec.value not in df.columns:
        raise MissingRole(f"no value column {spec.value!r} in {df.columns}")
    doubles = {c: F.col(c).cast("double") for c in (spec.lat, spec.lon, spec.value) if c in df.columns}
    df = clean(df.withColumns(doubles))
    if spec.time not in df.columns:
        return df
    kind, raw = df.schema[spec.time].dataType, F.col(spec.time)
    if isinstance(kind, T.TimestampType):
        return df.withColumn(spec.time, calendar.utc_time(raw))
    if isinstance(kind, T.StringType):
        parsed = calendar.parse_time(raw)
    elif isinstance(kind, T.NumericType):
        parsed = calendar.decode_time(raw, units, time_calendar) if units else F.lit(None).cast("timestamp_ntz")
    else:
        return df
    return df.withColumns({spec.time_raw: F.when(parsed.isNull(), raw.cast("string")), spec.time: parsed})


def read_grid(
    spark: SparkSession, path: str, spec: GridSpec = DEFAULT, fmt: str = "parquet", units: str | None = None,
    time_calendar: str = "standard", **options,
) -> DataFrame:
    """Reads a long table from Parquet, ORC, CSV or JSON. Datasets and variables are names, also where folders bear them:
    "001" and "1" are two datasets."""
    if fmt == "csv":
        options = {"header": True, "inferSchema": False, **options}
    df = spark.read.format(fmt).options(**options).load(path)
    named = T.StructType([T.StructField(f.name, T.StringType() if f.name in IDS else f.dataType) for f in df.schema])
    if named != T.StructType([T.StructField(f.name, f.dataType) for f in df.schema]):
        df = spark.read.schema(named).format(fmt).options(**options).load(path)
    return ingest_table(df, spec, units, time_calendar)


def write_grid(df: DataFrame, path: str, spec: GridSpec = DEFAULT, mode: str = "errorifexists", files: int | None = None) -> None:
    """Writes a long table by dataset and variable, each file sorted by time, so that slices skip most row groups.

    The rows are not shuffled, so every task adds a file to each variable that it holds: right for large files. With
    ``files``, about as many as the stored size over the wanted file size, rows are first dealt by ranges of dataset,
    variable and time, so that the number of files depends on the data and not on the tasks.
    """
    keys = list(IDS)
    if files:
        df = df.repartitionByRange(files, *keys, *spec.row_order(df)[:1])
    ordered = df.sortWithinPartitions(*keys, *spec.row_order(df))
    ordered.write.mode(mode).partitionBy(*keys).parquet(path)
