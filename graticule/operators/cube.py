"""Slices and spatial reductions of a cube."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graticule.functions import sphere
from graticule.functions.missing import is_finite, nan_to_null
from graticule.operators.groups import BROADCAST_ROWS, attach, cut_lineage, fits
from graticule.spec import DEFAULT, GridSpec, names


def drop_missing(df: DataFrame, spec: GridSpec = DEFAULT) -> DataFrame:
    return df.where(spec.v().isNotNull())


def drop_non_finite(df: DataFrame, spec: GridSpec = DEFAULT) -> DataFrame:
    return df.where(is_finite(spec.v()))


def spatial_mean(df: DataFrame, spec: GridSpec = DEFAULT, by: Sequence[str] = ()) -> DataFrame:
    """Unweighted mean over latitude and longitude, missing cells skipped.

    A time step without any value stays, with a NULL mean. Other dimensions stay too. A table that lacks latitude or
    longitude is returned as it is.
    """
    if not spec.has_space(df):
        return df
    keys = [*names(by), *spec.time_columns(df), *spec.extra_columns(df)]
    return df.groupBy(*dict.fromkeys(keys)).agg(nan_to_null(F.avg(spec.v())).alias(spec.value))


def series_rows(df: DataFrame, spec: GridSpec = DEFAULT, total_order: bool = True) -> DataFrame:
    """Every cell against time, in row-major order. Nothing is averaged. Without ``total_order`` each partition is in
    order, which a stored grid is anyway, and no row is shuffled."""
    order = spec.row_order(df)
    rows = df.orderBy(*order) if total_order else df.sortWithinPartitions(*order)
    return rows.select(*spec.time_columns(df), spec.value)


def range_columns(spec: GridSpec = DEFAULT, fallback: float | None = None) -> list[Column]:
    v = spec.v()
    vmax: Column = F.max(F.abs(v))
    if fallback is not None:
        vmax = F.when(F.count_if(is_finite(v)) > 0, vmax).otherwise(F.lit(fallback))
    return [
        F.min(v).alias("vmin"),
        F.max(v).alias("vmax"),
        (-vmax).alias("symmetric_min"),
        vmax.alias("symmetric_max"),
    ]


def field_range(df: DataFrame, spec: GridSpec = DEFAULT, by: Sequence[str] = (), fallback: float | None = None) -> DataFrame:
    """Minimum, maximum and the symmetric colour range of a field: -vmax..vmax with vmax = max |v|.

    ``fallback`` replaces the symmetric bound where no cell is finite.
    """
    return df.groupBy(*names(by)).agg(*range_columns(spec, fallback))


def normalise(df: DataFrame, spec: GridSpec = DEFAULT, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``normalised``: the value scaled to 0..1 within its own field."""
    by = names(by)
    limits = df.groupBy(*by).agg(F.min(spec.v()).alias("__low"), F.max(spec.v()).alias("__high"))
    spread = spec.row_order(df) or [spec.value]
    ranged = attach(df, limits, by, spread)
    return ranged.select(
        *df.columns, nan_to_null(sphere.normalise(spec.v(), F.col("__low"), F.col("__high"))).alias("normalised")
    )


def with_sphere(df: DataFrame, spec: GridSpec = DEFAULT) -> DataFrame:
    """Adds x, y, z on the unit sphere."""
    return df.withColumns(sphere.unit_sphere(F.col(spec.lat), F.col(spec.lon)))


def globe_surface(df: DataFrame, spec: GridSpec = DEFAULT, by: Sequence[str] = ()) -> DataFrame:
    """Sphere coordinates and the scaled value of every cell of a slice."""
    spec.need_space(df)
    return with_sphere(normalise(df, spec, by), spec)


def hotspot_cell(df: DataFrame, spec: GridSpec = DEFAULT) -> Column:
    """Aggregate: the cell with the largest absolute value, the first in row-major order among equals."""
    spec.need_space(df)
    first = F.when(spec.v().isNotNull(), F.struct(-F.abs(spec.v()), *spec.space_order(df)))
    cell = F.struct(
        F.col(spec.lat).alias("hot_lat"), F.col(spec.lon).alias("hot_lon"), spec.v().alias("hot_value")
    )
    return F.min_by(cell, first).alias("hotspot")


def hotspot(df: DataFrame, spec: GridSpec = DEFAULT, by: Sequence[str] = (), broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Place and value of the hotspot of each field. No row for a field without values.

    Grouped fields are read twice: the largest absolute values first, which hash aggregation combines before the
    shuffle, then the first of the few cells that attain them. With more fields than may be broadcast it is one pass,
    which sorts within each task and shuffles one row per field and task.
    """
    by = names(by)
    size = F.abs(spec.v())
    largest = cut_lineage(drop_missing(df, spec).groupBy(*by).agg(F.max(size).alias("__largest"))) if by else None
    if by and fits(largest, broadcast_rows):
        needed = list(dict.fromkeys([*by, *spec.space_order(df), spec.lat, spec.lon, spec.value]))
        df = attach(df.select(*needed), largest, by, spec.space_order(df)).where(size == F.col("__largest"))
    peaks = df.groupBy(*by).agg(hotspot_cell(df, spec))
    return peaks.where(F.col("hotspot").isNotNull()).select(*by, "hotspot.*")


def attach_axis(df: DataFrame, axis: DataFrame, position: str) -> DataFrame:
    """Looks up the coordinate of a stored position in an axis table (columns ``position`` and the coordinate)."""
    return df.join(axis, position, "left")


def to_long(df: DataFrame, ids: Sequence[str], variables: Sequence[str], spec: GridSpec = DEFAULT) -> DataFrame:
    """One row per cell and variable."""
    return df.unpivot(list(ids), list(variables), "variable", spec.value)


def to_wide(df: DataFrame, ids: Sequence[str], variables: Sequence[str], spec: GridSpec = DEFAULT) -> DataFrame:
    """One column per variable. The variables are named, so no extra job looks for them."""
    return df.groupBy(*ids).pivot("variable", list(variables)).agg(F.first(spec.value, ignorenulls=True))
