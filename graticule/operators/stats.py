"""Distribution statistics over all cells of a variable."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graticule.functions.missing import is_finite
from graticule.operators.cube import drop_missing, drop_non_finite
from graticule.operators.groups import BROADCAST_ROWS, attach
from graticule.spec import DEFAULT, GridSpec, names

MAX_BINS = 40


def value_stats(df: DataFrame, spec: GridSpec = DEFAULT, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, maximum and minimum of the values present, infinities included."""
    v = spec.v()
    return df.groupBy(*names(by)).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.max(v).alias("max"), F.min(v).alias("min")
    )


def distribution_mean(df: DataFrame, spec: GridSpec = DEFAULT, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*names(by)).agg(F.count(spec.v()).alias("n"), F.avg(spec.v()).alias("mean"))


def global_stats(df: DataFrame, spec: GridSpec = DEFAULT, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, minimum, maximum and population deviation of the finite values. No row when there is none."""
    v = spec.v()
    return (
        drop_non_finite(df, spec)
        .groupBy(*names(by))
        .agg(
            F.count(v).alias("n_points"),
            F.avg(v).alias("mean"),
            F.min(v).alias("min"),
            F.max(v).alias("max"),
            F.stddev_pop(v).alias("std"),
        )
        .where(F.col("n_points") > 0)
    )


def bin_sizes(raw: Column) -> Column:
    """Round widths 1, 2 and 5 times a power of ten around a raw width, in rising order.

    They are read from text, so every engine gets the same double.
    """
    scale = F.floor(F.log10(raw)).cast("int")
    return F.flatten(
        F.transform(
            F.sequence(scale - 1, scale + 2),
            lambda k: F.array(*[F.concat(F.lit(f"{m}e"), k.cast("string")).cast("double") for m in (1, 2, 5)]),
        )
    )


def bin_width(low: Column, high: Column, max_bins: int = MAX_BINS) -> Column:
    """Smallest round width that covers low..high in at most ``max_bins`` bins. A constant field gets one bin of width 1."""
    raw = (high - low) / max_bins
    fits = F.filter(
        bin_sizes(raw), lambda s: (s >= raw) & (F.floor(high / s) - F.floor(low / s) + 1 <= max_bins)
    )
    return F.when(low == high, F.lit(1.0)).when(low < high, F.element_at(fits, 1))


def histogram_range(df: DataFrame, spec: GridSpec = DEFAULT, by: Sequence[str] = (), max_bins: int = MAX_BINS) -> DataFrame:
    """Bin width and start per group, and how many infinite values lie outside."""
    v = spec.v()
    finite = F.when(is_finite(v), v)
    start = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(
        F.floor(F.col("low") / F.col("width")) * F.col("width")
    )
    return (
        df.groupBy(*names(by))
        .agg(F.min(finite).alias("low"), F.max(finite).alias("high"), (F.count(v) - F.count(finite)).alias("n_infinite"))
        .withColumn("width", bin_width(F.col("low"), F.col("high"), max_bins))
        .select(*names(by), start.alias("start"), "width", "n_infinite")
    )


def histogram(
    df: DataFrame,
    spec: GridSpec = DEFAULT,
    by: Sequence[str] = (),
    max_bins: int = MAX_BINS,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Counts in at most ``max_bins`` bins of round width, aligned to multiples of the width. Empty bins have no row."""
    by = names(by)
    df = drop_missing(df, spec)
    ranged = attach(
        df, histogram_range(df, spec, by, max_bins), by, spec.row_order(df) or [spec.value], broadcast_rows
    )
    v, start, width = spec.v(), F.col("start"), F.col("width")
    return (
        ranged.where(is_finite(v))
        .withColumn("bin", F.floor((v - start) / width).cast("int"))
        .groupBy(*by, "bin")
        .agg(F.count("*").alias("n"), F.min(start).alias("start"), F.min(width).alias("width"))
        .select(
            *by,
            "bin",
            (start + F.col("bin") * width).alias("bin_start"),
            (start + (F.col("bin") + 1) * width).alias("bin_end"),
            "n",
        )
        .orderBy(*by, "bin")
    )
