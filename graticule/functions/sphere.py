"""Projection to the unit sphere and min-max scaling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit_sphere(lat: Column, lon: Column) -> dict[str, Column]:
    """Cartesian x, y, z of a point given in degrees."""
    phi, lam = F.radians(lat), F.radians(lon)
    return {"x": F.cos(phi) * F.cos(lam), "y": F.cos(phi) * F.sin(lam), "z": F.sin(phi)}


def normalise(value: Column, low: Column, high: Column) -> Column:
    """Scales to 0..1. A constant field is 0 everywhere, missing cells included."""
    return F.when(low == high, F.lit(0.0)).otherwise((value - low) / F.when(low != high, high - low))
