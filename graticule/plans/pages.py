"""The main pages of all datasets and variables at once, a fixed number of passes for any number of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graticule.operators import axis, cube, indices, series, stats, wind
from graticule.operators import catalog as cat
from graticule.operators.groups import broadcast_if_small, cut_lineage
from graticule.spec import DEFAULT, GridSpec

VARIABLE = ["dataset_id", "variable"]
Results = dict[tuple[str, str], DataFrame]


def cells_of(grid: DataFrame, opened: DataFrame, *panels: str) -> DataFrame:
    """Cells of the variables that any of these panels works on. Each is read once, whatever the number of its pages."""
    targets = opened.where(F.col("panel").isin(*panels) & F.col("target").isNotNull())
    wanted = cut_lineage(targets.select("dataset_id", F.col("target").alias("variable")).distinct())
    return grid.join(broadcast_if_small(wanted), VARIABLE, "left_semi")


def paired_components(grid: DataFrame, opened: DataFrame, spec: GridSpec = DEFAULT) -> DataFrame:
    """Both wind components of every dataset that has them, under whatever names it has them."""
    pairs = opened.where("wind_source = 'components'").select("dataset_id", "u_variable", "v_variable").distinct()
    pairs = cut_lineage(pairs)

    def side(name: str) -> DataFrame:
        named = pairs.select("dataset_id", F.col(name).alias("variable"))
        return grid.join(broadcast_if_small(named), VARIABLE, "left_semi")

    return wind.pair_components(side("u_variable"), side("v_variable"), ["dataset_id", *spec.row_order(grid)], spec)


def target_results(
    grid: DataFrame, opened: DataFrame, timed: DataFrame, spec: GridSpec = DEFAULT, heavy_above: float = 20.0, dry_below: float = 1.0, **bounds
) -> Results:
    """Results of the panels that work on one variable, by ``VARIABLE``. ``timed`` names the variables with a time axis:
    the others have no index of a series but snow."""
    means = cut_lineage(cube.spatial_mean(cells_of(grid, opened, "temperature", "rainfall"), spec, VARIABLE))
    found: Results = {}
    if spec.has_time(grid):
        ts = cut_lineage(means.join(broadcast_if_small(timed), VARIABLE, "left_semi"))
        warm, wet = cells_of(ts, opened, "temperature"), cells_of(ts, opened, "rainfall")
        found = {
            ("temperature", "annual_mean"): series.annual_mean_by_period(warm, spec, VARIABLE, **bounds),
            ("temperature", "monthly_cycle"): series.monthly_cycle(warm, spec, VARIABLE),
            ("temperature", "extremes"): indices.extremes(warm, spec, VARIABLE),
            ("rainfall", "annual_total"): series.annual_total(wet, spec, VARIABLE),
            ("rainfall", "monthly_total"): series.monthly_total(wet, spec, VARIABLE),
            ("rainfall", "heavy_days"): indices.heavy_days(wet, spec, VARIABLE, heavy_above),
            ("rainfall", "dry_streak"): indices.longest_dry_streak(wet, spec, VARIABLE, dry_below),
        }
    found["rainfall", "snow"] = indices.snow_days(cells_of(means, opened, "rainfall"), spec, VARIABLE)
    values = cut_lineage(stats.value_stats(grid, spec, VARIABLE))
    found["humidity", "humidity"] = values
    found["humidity", "histogram"] = stats.histogram(cells_of(grid, opened, "humidity"), spec, VARIABLE)
    found["distribution", "mean"] = values.select(*VARIABLE, "n", "mean")
    found["distribution", "histogram"] = stats.histogram(cells_of(grid, opened, "distribution"), spec, VARIABLE)
    found["wind", "fallback"] = values
    return found


def all_pages(
    grid: DataFrame, spec: GridSpec = DEFAULT, listed: DataFrame | None = None, index: int = 0, heavy_above: float = 20.0,
    dry_below: float = 1.0, **bounds,
) -> Results:
    """Every result on the page of every variable of every dataset, by panel and result: rows by ``dataset_id``,
    ``variable`` and ``position``, the panel's place on the page.

    Columns are those that ``explore`` gives for one page; the indices of a variable that several pages show are computed
    once and join their pages at the end, as a row or some per page. ``listed`` is a stored catalog; without it one is
    made, which reads all cells. "view" are panels that every page with a map has, at position -1: the cells of step
    ``index`` and their range. Several jobs run while the pages are built: the catalog, spatial means and value statistics
    are written to the shared folder. An empty grid gives empty results. Rows without a dataset or variable are on no page.
    """
    keyed = F.col("dataset_id").isNotNull() & F.col("variable").isNotNull()
    grid = grid.where(keyed)
    listed = cut_lineage(cat.catalog(grid, spec) if listed is None else listed.where(keyed))
    opened = cut_lineage(cat.explore_panels(listed).drop("category"))
    timed = cut_lineage(listed.where("n_time > 0").select(*VARIABLE))
    by_target = target_results(grid, opened, timed, spec, heavy_above, dry_below, **bounds)
    pages: Results = {}
    for (panel, result), df in by_target.items():
        chosen = F.col("wind_source") == "fallback" if panel == "wind" else F.lit(True)
        places = opened.where((F.col("panel") == panel) & chosen).select(*VARIABLE, "position", "target")
        renamed = df.withColumnRenamed("variable", "target")
        pages[panel, result] = places.join(renamed, ["dataset_id", "target"]).drop("target")
    uv = paired_components(grid, opened, spec)
    places = opened.where("wind_source = 'components'").select(*VARIABLE, "position")
    speeds = stats.histogram(wind.with_speed(uv), spec.with_value("speed"), ["dataset_id"])
    for result, df in (("wind", wind.wind_summary(uv, ["dataset_id"])), ("histogram", speeds)):
        pages["wind", result] = places.join(df, "dataset_id")
    if spec.has_space(grid):
        mapped = broadcast_if_small(cut_lineage(cat.mappable(listed).select(*VARIABLE)))
        cells = axis.time_slice(grid.join(mapped, VARIABLE, "left_semi"), index, spec, VARIABLE)
        at = F.lit(-1).alias("position")
        pages["view", "cells"] = cells.select("*", at)
        pages["view", "range"] = cube.field_range(cells, spec, VARIABLE).select("*", at)
    return pages
