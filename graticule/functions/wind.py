"""Wind vector functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The eight compass points, clockwise from north.
COMPASS = ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]


def speed(u: Column, v: Column) -> Column:
    """Length of the wind vector; NULL when either component is missing."""
    return F.sqrt(u * u + v * v)


def direction(u: Column, v: Column) -> Column:
    """Direction the wind blows toward, in degrees clockwise from north, 0 <= d < 360."""
    return F.pmod(F.degrees(F.atan2(u, v)), F.lit(360.0))


def compass(degrees: Column) -> Column:
    """Nearest of the eight compass points."""
    sector = F.floor((degrees + 22.5) / 45).cast("int") % len(COMPASS)
    return F.element_at(F.array(*[F.lit(p) for p in COMPASS]), sector + 1)
