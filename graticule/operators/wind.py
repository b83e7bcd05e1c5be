"""Wind components, wind statistics and storm counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graticule.functions import wind
from graticule.spec import DEFAULT, GridSpec, names


def pair_components(u: DataFrame, v: DataFrame, keys: Sequence[str], spec: GridSpec = DEFAULT) -> DataFrame:
    """Two component tables as columns ``u`` and ``v``. A cell that only one of them has is kept."""
    left = u.select(*keys, spec.v().alias("u"))
    right = v.select(*keys, spec.v().alias("v"))
    return left.join(right, list(keys), "full")


def pair_from_long(df: DataFrame, u_name: str, v_name: str, keys: Sequence[str], spec: GridSpec = DEFAULT) -> DataFrame:
    """The same from one long table, of which only the two variables are read.

    The sort-merge join measured faster than grouping the long rows by cell, which has nothing to combine early. A grid
    that keeps both components as columns of one row needs neither.
    """
    variable = F.col("variable")
    return pair_components(df.where(variable == u_name), df.where(variable == v_name), keys, spec)


def with_speed(uv: DataFrame) -> DataFrame:
    return uv.withColumn("speed", wind.speed(F.col("u"), F.col("v")))


STORM_ABOVE, SEVERE_ABOVE = 20.0, 32.0


def _speed_columns() -> list[Column]:
    return [
        F.count("speed").alias("n_speed"),
        F.avg("speed").alias("mean_speed"),
        F.max("speed").alias("max_speed"),
        F.avg("u").alias("mean_u"),
        F.avg("v").alias("mean_v"),
    ]


def _storm_columns(storm_above: float, severe_above: float) -> list[Column]:
    speed = F.col("speed")
    return [
        F.count_if(speed > storm_above).alias("storm_samples"),
        F.count_if(speed > severe_above).alias("severe_samples"),
        F.max(speed).alias("peak_speed"),
    ]


def _with_direction(stats: DataFrame) -> DataFrame:
    toward = stats.withColumn("direction", wind.direction(F.col("mean_u"), F.col("mean_v")))
    return toward.withColumn("compass", wind.compass(F.col("direction")))


def wind_stats(uv: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean and maximum speed, and the prevailing direction.

    The mean components skip missing cells each on its own; the speed needs both.
    """
    return _with_direction(with_speed(uv).groupBy(*names(by)).agg(*_speed_columns()))


def storm_counts(
    uv: DataFrame, by: Sequence[str] = (), storm_above: float = STORM_ABOVE, severe_above: float = SEVERE_ABOVE
) -> DataFrame:
    """Samples, that is cells at a time step, above two speeds, and the peak speed."""
    return with_speed(uv).groupBy(*names(by)).agg(*_storm_columns(storm_above, severe_above))


def wind_summary(
    uv: DataFrame, by: Sequence[str] = (), storm_above: float = STORM_ABOVE, severe_above: float = SEVERE_ABOVE
) -> DataFrame:
    """Wind statistics and storm counts in one pass."""
    columns = [*_speed_columns(), *_storm_columns(storm_above, severe_above)]
    return _with_direction(with_speed(uv).groupBy(*names(by)).agg(*columns))
