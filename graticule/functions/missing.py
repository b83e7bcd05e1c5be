"""Missing and infinite values.

Spark orders NaN above every number and counts it; the engine therefore turns NaN into NULL once, on the way in,
and every operator relies on that. Infinities are ordinary values until an operator says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INFINITY = float("inf")


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def is_finite(value: Column) -> Column:
    """False, never NULL, for a missing value."""
    return F.coalesce(F.abs(value) < F.lit(INFINITY), F.lit(False)) & ~F.isnan(value)


def clean(df: DataFrame) -> DataFrame:
    """Turns NaN into NULL in every floating-point column."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: nan_to_null(F.col(c)).cast("double") for c in floats}) if floats else df
