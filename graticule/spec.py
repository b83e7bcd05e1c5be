"""Which column of a table plays which grid role."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


NO_DIMENSIONS = ("variable", "dataset")  # columns with positions that number tables, not cells


class MissingRole(ValueError):
    """A table lacks a column that the operator needs."""


@dataclass(frozen=True)
class GridSpec:
    """Column names of the grid roles.

    ``time_idx``, ``lat_idx`` and ``lon_idx`` are positions along the axes. They are optional: a table without
    them is ordered by the coordinate itself. ``extra`` names further dimensions, such as a pressure level; a column
    ``x`` with positions ``x_idx`` is one without being named. ``time_raw`` holds the axis value of a time that could
    not be read. ``time_fields`` holds year, month, day and microseconds of a time in a model calendar, which no timestamp
    can hold.
    """

    time: str = "time"
    lat: str = "lat"
    lon: str = "lon"
    value: str = "value"
    time_idx: str = "time_idx"
    lat_idx: str = "lat_idx"
    lon_idx: str = "lon_idx"
    extra: tuple[str, ...] = ()
    time_raw: str = "time_raw"
    time_fields: str = "time_fields"

    @classmethod
    def infer(cls, df: DataFrame, **roles) -> GridSpec:
        """Takes the time column under either of its accepted spellings, ``time`` or ``TIME``."""
        if "time" not in roles and "time" not in df.columns and "TIME" in df.columns:
            roles["time"] = "TIME"
        return cls(**roles)

    def with_value(self, value: str) -> GridSpec:
        return replace(self, value=value)

    def has_space(self, df: DataFrame) -> bool:
        return self.lat in df.columns and self.lon in df.columns

    def has_index(self, df: DataFrame) -> bool:
        return self.time_idx in df.columns

    def has_time(self, df: DataFrame) -> bool:
        return self.time in df.columns or self.has_index(df)

    def time_key(self, df: DataFrame) -> str:
        """The column that identifies and orders time steps."""
        if self.has_index(df):
            return self.time_idx
        if self.time in df.columns:
            return self.time
        raise MissingRole(f"no time column: neither {self.time_idx!r} nor {self.time!r} in {df.columns}")

    def time_columns(self, df: DataFrame) -> list[str]:
        return [c for c in (self.time_idx, self.time, self.time_fields) if c in df.columns]

    def extra_names(self, df: DataFrame) -> list[str]:
        """Further dimensions: those named, then those that the table shows by a column of positions."""
        roles = {self.time, self.lat, self.lon, self.value, *NO_DIMENSIONS, *self.extra}
        shown = [c for c in df.columns if f"{c}_idx" in df.columns and c not in roles]
        return [*self.extra, *shown]

    def extra_columns(self, df: DataFrame) -> list[str]:
        """Further dimensions, with their positions where the table has them."""
        names = [n for e in self.extra_names(df) for n in (f"{e}_idx", e)]
        return [n for n in names if n in df.columns]

    def space_order(self, df: DataFrame) -> list[str]:
        """Row-major order of the cells of one time step."""
        pairs = ((self.lat_idx, self.lat), (self.lon_idx, self.lon))
        return [idx if idx in df.columns else name for idx, name in pairs if idx in df.columns or name in df.columns]

    def row_order(self, df: DataFrame) -> list[str]:
        """Row-major order of a whole table: time, further dimensions, latitude, longitude."""
        extra = [f"{e}_idx" if f"{e}_idx" in df.columns else e for e in self.extra_names(df)]
        time = [self.time_key(df)] if self.has_time(df) else []
        return time + extra + self.space_order(df)

    def need_space(self, df: DataFrame) -> None:
        if not self.has_space(df):
            raise MissingRole(f"no {self.lat!r} and {self.lon!r} in {df.columns}")

    def v(self) -> Column:
        return F.col(self.value)


DEFAULT = GridSpec()


def names(by: str | Sequence[str]) -> list[str]:
    return [by] if isinstance(by, str) else list(by)
