"""Temperature, rainfall, drought and snow indices of a spatial-mean series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graticule.functions import calendar
from graticule.operators.axis import month_bucket
from graticule.operators.cube import drop_missing
from graticule.operators.groups import BROADCAST_ROWS, attach, cut_lineage, fits
from graticule.spec import DEFAULT, GridSpec, names

WORD = 64
BLOCK = 4096


def extremes(
    series: DataFrame,
    spec: GridSpec = DEFAULT,
    by: Sequence[str] = (),
    hot_above: float = 30.0,
    tropical_above: float = 20.0,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Hottest and coldest step, the first among equals, and how many steps lie above two thresholds.

    Grouped extremes are found in two passes: first the extreme values, which hash aggregation combines before the
    shuffle, then the first step among the few rows that attain them. With more groups than may be broadcast it is one
    pass, which sorts within each task and shuffles one row per group and task: no raw row moves either way.

    A series with ``time_fields`` has ``hottest_label`` and ``coldest_label`` as well, since no date holds the days of a
    model calendar.
    """
    by = names(by)
    v, order = spec.v(), spec.row_order(series)
    series = drop_missing(series, spec)
    counts = [
        F.count_if(v > hot_above).alias("hot_days"),
        F.count_if(v > tropical_above).alias("tropical_nights"),
    ]
    # One row even for an empty ungrouped series, where the times stay NULL.
    model = spec.time_fields in series.columns
    when = F.struct(F.col(spec.time).alias("time"), F.col(spec.time_fields).alias("fields")) if model else F.col(spec.time)
    hot_time = F.min_by(when, F.struct(-v, *order)).alias("hot_time")
    cold_time = F.min_by(when, F.struct(v, *order)).alias("cold_time")
    limits = [F.max(v).alias("hottest"), F.min(v).alias("coldest"), *counts]
    totals = cut_lineage(series.groupBy(*by).agg(*limits)) if by else None
    if by and fits(totals, broadcast_rows):
        fields = [spec.time_fields] if model else []
        rows = attach(series.select(*dict.fromkeys([*by, *order, spec.time, *fields, spec.value])), totals, by, order)
        at_limit = rows.where((v == F.col("hottest")) | (v == F.col("coldest")))
        kept = [F.first(c).alias(c) for c in totals.columns if c not in by]
        found = at_limit.groupBy(*by).agg(hot_time, cold_time, *kept)
    else:
        found = series.groupBy(*by).agg(hot_time, cold_time, *limits)
    times = [F.col(c)["time"] if model else F.col(c) for c in ("hot_time", "cold_time")]
    labels = [
        calendar.fields_text(F.col(c)["time"], F.col(c)["fields"]).alias(name)
        for c, name in (("hot_time", "hottest_label"), ("cold_time", "coldest_label"))
    ]
    return found.select(
        *by,
        "hottest",
        F.to_date(times[0]).alias("hottest_date"),
        "coldest",
        F.to_date(times[1]).alias("coldest_date"),
        "hot_days",
        "tropical_nights",
        *(labels if model else []),
    )


def heavy_days(series: DataFrame, spec: GridSpec = DEFAULT, by: Sequence[str] = (), threshold: float = 20.0) -> DataFrame:
    """Steps above a rainfall threshold, which is at least 1."""
    if threshold < 1.0:
        raise ValueError("the threshold must be at least 1")
    return series.groupBy(*names(by)).agg(F.count_if(spec.v() > threshold).alias("heavy_days"))


def snow_days(series: DataFrame, spec: GridSpec = DEFAULT, by: Sequence[str] = ()) -> DataFrame:
    """Steps with snow and the total amount; 0.0 when there is no value."""
    return series.groupBy(*names(by)).agg(
        F.count_if(spec.v() > 0).alias("snow_days"),
        F.coalesce(F.sum(spec.v()), F.lit(0.0)).alias("snow_amount"),
    )


def _runs_by_window(series: DataFrame, spec: GridSpec, by: list[str], dry: Column) -> DataFrame:
    """Stretches of a series without stored positions: one per calendar month, by comparing each step with the last."""
    order = spec.row_order(series)
    stretch = month_bucket(F.col(spec.time)) if not spec.has_index(series) else F.floor(F.col(spec.time_idx) / WORD).cast("int")
    inside = Window.partitionBy(*by, "stretch").orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = F.coalesce(F.col("dry") != F.lag("dry").over(inside), F.lit(True)).cast("int")
    runs = (
        series.select(*by, *order, stretch.alias("stretch"), dry.alias("dry"))
        .withColumn("starts", starts)
        .withColumn("run", F.sum("starts").over(so_far))
        .groupBy(*by, "stretch", "run")
        .agg(F.sum(F.col("dry").cast("bigint")).alias("length"))
    )
    return runs.groupBy(*by, "stretch").agg(
        F.sum(F.when(F.col("run") == 1, F.col("length"))).alias("head"),
        F.max_by("length", "run").alias("tail"),
        F.max("length").alias("best"),
        F.max((F.col("length") == 0).cast("bigint")).alias("wet"),
    )


def _runs_by_bits(series: DataFrame, spec: GridSpec, by: list[str], dry: Column) -> DataFrame:
    """Stretches of 64 stored positions, one bit per step. Bits are combined before the shuffle, 64 rows into one."""
    position = F.col(spec.time_idx)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), position % WORD)
    words = series.groupBy(*by, F.floor(position / WORD).cast("int").alias("stretch")).agg(
        F.bit_or(bit).alias("present"), F.bit_or(F.when(dry, bit)).alias("dry")
    )
    is_set = lambda bits, k: F.call_function("getbit", bits, k) == 1
    steps = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda k: is_set(F.col("present"), k))
    digits = F.transform(steps, lambda k: F.when(is_set(F.coalesce("dry", F.lit(0)), k), F.lit("d")).otherwise(F.lit("w")))
    dry_runs = F.transform(F.split(F.array_join(digits, ""), "w"), lambda run: F.length(run).cast("bigint"))
    return words.withColumn("runs", dry_runs).select(
        *by,
        "stretch",
        F.element_at("runs", 1).alias("head"),
        F.element_at("runs", -1).alias("tail"),
        F.array_max("runs").alias("best"),
        (F.size("runs") > 1).cast("bigint").alias("wet"),
    )


def _join_stretches(stretches: DataFrame, by: list[str]) -> DataFrame:
    """Joins neighbouring stretches of each group into one, which has the same columns.

    A wet step ends the run that enters its stretch and begins the run that leaves it. An all-dry stretch prolongs both.
    """
    so_far = Window.partitionBy(*by).orderBy("stretch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    enters = F.struct((F.col("gap") - F.col("wet")).alias("gap"), F.col("head").alias("length"))
    leaves = F.struct(F.col("gap").alias("gap"), F.col("tail").alias("length"))
    pieces = F.when(F.col("wet") > 0, F.array(enters, leaves)).otherwise(F.array(leaves))
    joined = (
        stretches.withColumn("wet", F.least("wet", F.lit(1)))
        .withColumn("gap", F.sum("wet").over(so_far))
        .select(*by, "best", F.explode(pieces).alias("piece"))
        .groupBy(*by, "piece.gap")
        .agg(F.sum("piece.length").alias("length"), F.max("best").alias("best"))
    )
    return joined.groupBy(*by).agg(
        F.min_by("length", "gap").alias("head"),
        F.max_by("length", "gap").alias("tail"),
        F.greatest(F.max("length"), F.max("best")).alias("best"),
        F.max("gap").alias("wet"),
    )


def longest_dry_streak(
    series: DataFrame,
    spec: GridSpec = DEFAULT,
    by: Sequence[str] = (),
    dry_below: float = 1.0,
) -> DataFrame:
    """Longest run of steps below a threshold. Missing steps and calendar gaps do not end a run.

    0 when no step is dry, NULL when there is no value at all. Rows without a place on the time axis have no order and
    are left out; several rows of one step follow each other in row-major order. Runs are found in short stretches of the axis, and the
    stretches are then joined in two rounds: no task ever sorts a whole series. With stored positions the last round
    sees at most 2^31 / 64 / 4096 = 8,192 stretches of a series, else one per calendar month.
    """
    by = names(by)
    series, dry = drop_missing(series, spec), spec.v() < dry_below
    series = series.where(F.col(spec.time_key(series)).isNotNull())
    grouped = {*by, *[f"{c}_idx" for c in by]}
    if [c for c in spec.row_order(series) if c not in grouped] == [spec.time_idx]:  # one row a step
        words = _runs_by_bits(series, spec, by, dry)
        blocked = words.withColumn("block", F.floor(F.col("stretch") / BLOCK).cast("int"))
        stretches = _join_stretches(blocked, [*by, "block"]).withColumnRenamed("block", "stretch")
    else:
        stretches = _runs_by_window(series, spec, by, dry)
    return _join_stretches(stretches, by).select(*by, F.col("best").alias("longest_dry_streak"))
