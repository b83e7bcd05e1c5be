"""Country outlines as vertices on the sphere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graticule.functions.sphere import unit_sphere


def outline_vertices(boundaries: DataFrame) -> DataFrame:
    """One row per vertex of every exterior ring, in drawing order. Boundaries without rings give no row."""
    rings = boundaries.select("name", F.posexplode("rings").alias("part", "ring"))
    points = rings.select("name", "part", F.posexplode("ring").alias("vertex", "point"))
    lon, lat = F.col("point.lon"), F.col("point.lat")
    xyz = unit_sphere(lat, lon)
    return points.select("name", "part", "vertex", lon.alias("lon"), lat.alias("lat"), *[c.alias(n) for n, c in xyz.items()])
