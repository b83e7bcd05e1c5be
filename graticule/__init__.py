"""Gridded climate analytics on Spark: long-form latitude/longitude/time tables and the operators over them."""

from graticule.spec import GridSpec, MissingRole

__all__ = ["GridSpec", "MissingRole"]
