"""Time axis and positional slices."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graticule.operators.groups import attach, broadcast_if_small, cut_lineage
from graticule.spec import DEFAULT, GridSpec, names

STORY_MIN, STORY_MAX = 4, 6


def month_bucket(time: Column) -> Column:
    """Months since year 0: at most 120,000 values, whatever the table holds."""
    return F.year(time) * 12 + F.month(time)


def time_axis(df: DataFrame, spec: GridSpec = DEFAULT, by: Sequence[str] = ()) -> DataFrame:
    """One row per time step: its position and its time.

    A table without stored positions gets the rank of its distinct times. Ranking runs per month, plus the number of
    steps in earlier months, so no task sorts the whole axis.
    """
    by = names(by)
    if spec.has_index(df):
        steps = df.where(F.col(spec.time_idx).isNotNull())
        known = [c for c in (spec.time, spec.time_raw) if c in df.columns]
        if not known:
            return steps.select(*by, spec.time_idx).distinct()
        return steps.groupBy(*by, spec.time_idx).agg(*[F.max(c).alias(c) for c in known])

    time = spec.time_key(df)
    steps = df.where(F.col(time).isNotNull()).select(*by, time).distinct().withColumn("__month", month_bucket(F.col(time)))
    earlier = Window.partitionBy(*by).orderBy("__month").rowsBetween(Window.unboundedPreceding, -1)
    months = (
        steps.groupBy(*by, "__month")
        .agg(F.count("*").alias("__n"))
        .select(*by, "__month", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    )
    inside = Window.partitionBy(*by, "__month").orderBy(time)
    position = (F.row_number().over(inside) - 1 + F.col("__before")).cast("int")
    return steps.join(months, [*by, "__month"]).select(*by, position.alias(spec.time_idx), time)


def with_time_index(df: DataFrame, spec: GridSpec = DEFAULT, by: Sequence[str] = ()) -> DataFrame:
    """Stores positions on a table that lacks them. Rows without a time keep a NULL position."""
    if spec.has_index(df):
        return df
    keys = [*names(by), spec.time]
    return attach(df, time_axis(df, spec, by), keys, spec.row_order(df), how="left")


def clip_index(index: int, nt: Column) -> Column:
    return F.least(F.lit(max(index, 0)), nt - 1)


def story_positions(nt: Column) -> Column:
    """Four to six evenly spaced positions, first and last included. Short axes repeat positions."""
    n = F.least(F.lit(STORY_MAX), F.greatest(F.lit(STORY_MIN), nt))
    spaced = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda k: F.floor((k * (nt - 1)) / (n - 1)).cast("int"),
    )
    return F.when(nt >= 1, spaced)


def steps_at(df: DataFrame, positions: Column, spec: GridSpec = DEFAULT, by: Sequence[str] = ()) -> DataFrame:
    """The wanted time steps: ``by``, ``step`` (0, 1, ...), ``time_idx`` and the time.

    ``positions`` is an array over ``nt``, the number of time steps. Stored positions are dense, so their maximum tells
    ``nt`` without a distinct count; another table is ranked once. The result has a handful of rows per group and is
    needed several times, so its lineage is cut.
    """
    by = names(by)
    indexed = spec.has_index(df)
    axis = df if indexed else cut_lineage(time_axis(df, spec, by))
    lengths = axis.groupBy(*by).agg((F.max(spec.time_idx) + 1).alias("nt"))
    wanted = lengths.select(*by, F.posexplode(positions).alias("step", spec.time_idx))
    if indexed:
        wanted = cut_lineage(wanted)
        if spec.time not in df.columns:
            return wanted
        axis = time_axis(restrict(df, wanted, spec.time_idx, by), spec, by)
    if not by:
        wanted = F.broadcast(wanted)  # one row per position that the caller lists
    return cut_lineage(axis.join(wanted, [*by, spec.time_idx]))


def restrict(df: DataFrame, steps: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Keeps the rows at the picked time steps, so that the scan reads only those.

    ``steps`` has its lineage cut. Without groups its values, as many as positions that the caller lists, are scalar
    subqueries and reach the file scan as filters. With groups the smallest and largest value do, and a semi-join is
    exact.
    """
    by = names(by)
    if not by:
        last = steps.agg(F.max("step")).first()[0]
        wanted = [steps.where(F.col("step") == k).select(key).scalar() for k in range(0 if last is None else last + 1)]
        return df.where(reduce(or_, [F.col(key) == value for value in wanted], F.lit(False)))
    within = between(df, steps, key)
    return within.join(broadcast_if_small(steps.select(*by, key).distinct()), [*by, key], "left_semi")


def constant(df: DataFrame, key: str, text: str) -> Column:
    """A value of a column's type. As text it does not pass through the zone of the driver's Python."""
    return F.lit(text).cast(df.schema[key].dataType)


def between(df: DataFrame, steps: DataFrame, key: str, or_null: bool = False) -> DataFrame:
    """Rows within the range of the picked steps, which the scan can skip by; with ``or_null`` also those without."""
    low, high = steps.agg(F.min(key).cast("string"), F.max(key).cast("string")).first()
    inside = F.col(key).between(constant(df, key, low), constant(df, key, high)) if low is not None else F.lit(False)
    return df.where(inside | F.col(key).isNull()) if or_null else df.where(inside)


def time_slice(
    df: DataFrame,
    index: int,
    spec: GridSpec = DEFAULT,
    by: Sequence[str] = (),
    clip: bool = True,
) -> DataFrame:
    """Rows of one time step, by position. ``clip`` moves an index outside the axis to its end.

    A table without a time column is returned whole, and so are variables whose stored position is NULL.
    """
    by = names(by)
    if not spec.has_time(df):
        return df
    if not spec.has_index(df):
        wanted = clip_index(index, F.col("nt")) if clip else F.lit(index)
        return restrict(df, steps_at(df, F.array(wanted), spec, by), spec.time, by)

    position = F.col(spec.time_idx)
    if not clip:
        return df.where((position == index) | position.isNull())
    last = df.groupBy(*by).agg(clip_index(index, F.max(position) + 1).alias(spec.time_idx))
    if not by:
        return df.where((position == last.scalar()) | position.isNull())
    last = cut_lineage(last)
    rows = attach(between(df, last, spec.time_idx, or_null=True), last.withColumnRenamed(spec.time_idx, "__wanted"), by, spec.row_order(df), how="left")
    return rows.where((position == F.col("__wanted")) | position.isNull()).drop("__wanted")
