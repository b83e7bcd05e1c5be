"""Calendar aggregates of a spatial-mean series.

The input has one row per time step (and further dimension), as ``spatial_mean`` returns it: an annual mean is a mean
of spatial means, never a mean over all cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graticule.functions import calendar
from graticule.functions.missing import nan_to_null
from graticule.spec import DEFAULT, GridSpec, MissingRole, names


def with_calendar(series: DataFrame, spec: GridSpec = DEFAULT) -> DataFrame:
    """Adds year and month, of the model calendar where the time is one of its own. Rows whose time is unknown leave."""
    if spec.time not in series.columns:
        raise MissingRole(f"no time column {spec.time!r} in {series.columns}")
    time = F.col(spec.time)
    parts = {"year": F.year(time), "month": F.month(time)}
    if spec.time_fields in series.columns:
        fields = F.col(spec.time_fields)
        parts = {c: F.coalesce(part, fields[c]) for c, part in parts.items()}
        return series.where(time.isNotNull() | fields.isNotNull()).withColumns(parts)
    return series.where(time.isNotNull()).withColumns(parts)


def annual_mean_by_period(
    series: DataFrame,
    spec: GridSpec = DEFAULT,
    by: Sequence[str] = (),
    baseline_until: int = 2010,
    current_until: int = 2040,
) -> DataFrame:
    """Mean per year with its period. Years without any value leave."""
    by = names(by)
    return (
        with_calendar(series, spec)
        .groupBy(*by, "year")
        .agg(nan_to_null(F.avg(spec.v())).alias("mean"))
        .dropna(subset=["year", "mean"])
        .withColumn("period", calendar.period(F.col("year"), baseline_until, current_until))
        .orderBy(*by, "year")
    )


def annual_total(series: DataFrame, spec: GridSpec = DEFAULT, by: Sequence[str] = ()) -> DataFrame:
    """Sum per year; 0.0 for a year without any value."""
    by = names(by)
    total = F.coalesce(F.sum(spec.v()), F.lit(0.0)).alias("total")
    return with_calendar(series, spec).groupBy(*by, "year").agg(total).orderBy(*by, "year")


def monthly_cycle(series: DataFrame, spec: GridSpec = DEFAULT, by: Sequence[str] = ()) -> DataFrame:
    """Mean per calendar month over all years. A month without any value stays, with a NULL mean."""
    by = names(by)
    return (
        with_calendar(series, spec)
        .groupBy(*by, "month")
        .agg(nan_to_null(F.avg(spec.v())).alias("mean"))
        .withColumn("month_name", calendar.month_name(F.col("month")))
        .orderBy(*by, "month")
    )


def monthly_total(series: DataFrame, spec: GridSpec = DEFAULT, by: Sequence[str] = ()) -> DataFrame:
    """Sum per calendar month, pooled over all years; 0.0 for a month without any value."""
    by = names(by)
    total = F.coalesce(F.sum(spec.v()), F.lit(0.0)).alias("total")
    return with_calendar(series, spec).groupBy(*by, "month").agg(total).orderBy(*by, "month")
