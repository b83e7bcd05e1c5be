"""CSV exports. Spark writes them in parallel; each export is a folder of part files, in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graticule.operators import axis, cube, stats
from graticule.spec import DEFAULT, GridSpec, MissingRole

PREVIEW_ROWS = 50
FORMATS = {"header": True, "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss[.SSSSSS]", "dateFormat": "yyyy-MM-dd"}


def slice_table(df: DataFrame, variable: str, index: int = 0, spec: GridSpec = DEFAULT) -> DataFrame:
    """One map: latitude, longitude, further dimensions, time and the value under the variable's name, in row-major order."""
    spec.need_space(df)
    cells = axis.time_slice(df, index, spec, clip=False)
    times = [spec.time] if spec.time in df.columns else []
    columns = [*spec.extra_columns(df), spec.lat, spec.lon, *times]
    return cells.orderBy(*spec.row_order(df)).select(*columns, spec.v().alias(variable))


def series_table(df: DataFrame, variable: str, spec: GridSpec = DEFAULT) -> DataFrame:
    """The spatial-mean series, or the series itself when there is no map to average."""
    if not spec.has_time(df):
        raise MissingRole("a series needs a time column")
    series = cube.spatial_mean(df, spec)
    times = [spec.time] if spec.time in df.columns else [spec.time_idx]
    return series.orderBy(*spec.row_order(series)).select(*times, *spec.extra_columns(df), spec.v().alias(variable))


def stats_table(df: DataFrame, variable: str, spec: GridSpec = DEFAULT) -> DataFrame:
    """Global statistics in one row; no row when nothing is finite."""
    return stats.global_stats(df, spec).select(F.lit(variable).alias("variable"), "*")


def preview(table: DataFrame, rows: int = PREVIEW_ROWS) -> DataFrame:
    """First rows of an export. Over a sorted export this becomes a top-n, not a full sort."""
    return table.limit(rows)


def slice_name(df: DataFrame, variable: str, index: int, spec: GridSpec = DEFAULT) -> str:
    return f"{variable}_map_slice_t{index}.csv" if spec.has_time(df) else f"{variable}_map_slice.csv"


def write_csv(table: DataFrame, folder: str, name: str, mode: str = "errorifexists") -> str:
    path = f"{folder.rstrip('/')}/{name}"
    table.write.mode(mode).options(**FORMATS).csv(path)
    return path


def export_slice(df: DataFrame, folder: str, variable: str, index: int = 0, spec: GridSpec = DEFAULT, **how) -> str:
    return write_csv(slice_table(df, variable, index, spec), folder, slice_name(df, variable, index, spec), **how)


def export_series(df: DataFrame, folder: str, variable: str, spec: GridSpec = DEFAULT, **how) -> str:
    return write_csv(series_table(df, variable, spec), folder, f"{variable}_timeseries.csv", **how)


def export_stats(df: DataFrame, folder: str, variable: str, spec: GridSpec = DEFAULT, **how) -> str:
    return write_csv(stats_table(df, variable, spec), folder, f"{variable}_global_stats.csv", **how)
