"""The main page: every panel that a dataset and the chosen variable open."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graticule.operators import catalog as cat
from graticule.operators import cube, indices, series, stats, wind
from graticule.operators.groups import cut_lineage
from graticule.plans import views
from graticule.spec import DEFAULT, GridSpec


def spatial_series(df: DataFrame, spec: GridSpec = DEFAULT) -> DataFrame:
    """The spatial-mean series, computed once: every index of a panel reads it instead of the cube."""
    return cut_lineage(cube.spatial_mean(df, spec))


def temperature_panel(df: DataFrame, spec: GridSpec = DEFAULT, **bounds) -> dict[str, DataFrame]:
    """Annual means by period, the monthly cycle and the extremes. Nothing for a variable without time."""
    if not spec.has_time(df):
        return {}
    ts = spatial_series(df, spec)
    return {
        "annual_mean": series.annual_mean_by_period(ts, spec, **bounds),
        "monthly_cycle": series.monthly_cycle(ts, spec),
        "extremes": indices.extremes(ts, spec),
    }


def rainfall_panel(df: DataFrame, spec: GridSpec = DEFAULT, threshold: float = 20.0, dry_below: float = 1.0) -> dict[str, DataFrame]:
    """Totals, heavy days, the longest dry streak, and snow. Only snow is left for a variable without time."""
    ts = spatial_series(df, spec)
    panel = {"snow": indices.snow_days(ts, spec)}
    if spec.has_time(df):
        panel |= {
            "annual_total": series.annual_total(ts, spec),
            "monthly_total": series.monthly_total(ts, spec),
            "heavy_days": indices.heavy_days(ts, spec, threshold=threshold),
            "dry_streak": indices.longest_dry_streak(ts, spec, dry_below=dry_below),
        }
    return panel


def wind_panel(uv: DataFrame | None, fallback: DataFrame | None = None, spec: GridSpec = DEFAULT) -> dict[str, DataFrame]:
    """Wind and storm statistics from both components, else plain statistics of the fallback, else nothing."""
    if uv is not None:
        speed = wind.with_speed(uv)
        return {"wind": wind.wind_summary(uv), "histogram": stats.histogram(speed, spec.with_value("speed"))}
    if fallback is not None:
        return {"wind": stats.value_stats(fallback, spec), "histogram": stats.histogram(fallback, spec)}
    return {}


def humidity_panel(df: DataFrame, spec: GridSpec = DEFAULT) -> dict[str, DataFrame]:
    return {"humidity": stats.value_stats(df, spec), "histogram": stats.histogram(df, spec)}


def levels_by_variable(dataset: DataFrame, spec: GridSpec, listed: DataFrame | None = None) -> dict[str, list[str]]:
    """The further dimensions that each variable has, in a grid that has any. A catalog with ``levels`` tells them; without
    one all cells are read."""
    extra = spec.extra_names(dataset)
    if not extra:
        return {}
    if listed is not None and "levels" in listed.columns:
        return {r["variable"]: [e for e in extra if e in (r["levels"] or ())] for r in listed.collect()}
    there = [F.max(F.col(e).isNotNull()).alias(e) for e in extra]
    return {r["variable"]: [e for e in extra if r[e]] for r in dataset.groupBy("variable").agg(*there).collect()}


def explore(
    grid: DataFrame,
    dataset_id: str,
    override: str | None = None,
    chosen: str | None = None,
    index: int = 0,
    boundaries: DataFrame | None = None,
    spec: GridSpec = DEFAULT,
    listed: DataFrame | None = None,
) -> dict[str, dict[str, DataFrame]]:
    """All panels of one dataset in a long grid, by panel name.

    Only the list of its variables comes to the driver. Spatial-mean series are computed while the page is built, and so
    is the list unless ``listed`` brings a stored catalog, with which no cell is read for it; in a grid with further
    dimensions it needs their names in ``levels``, else the cells tell them. The other results are lazy.
    Dimensions that a variable lacks, levels included, are no columns of its panels.
    """
    dataset = grid.where(F.col("dataset_id") == dataset_id)
    listed = cut_lineage(cat.catalog(dataset, spec) if listed is None else listed.where(F.col("dataset_id") == dataset_id))
    levels = levels_by_variable(dataset, spec, listed)
    chosen_row = cat.choose_variable(listed, override, chosen).first()
    if chosen_row is None:
        raise ValueError(f"no dataset {dataset_id!r}")
    variable = chosen_row["variable"]
    panels = cat.explore_panels(listed).where(F.col("variable") == variable).orderBy("position").collect()
    spans = {r["variable"]: r for r in listed.collect()}

    def cells(name: str) -> DataFrame:
        """Rows of one variable, without the columns of axes that it lacks."""
        row = spans[name]
        absent = [
            c
            for n, columns in (
                ("n_time", (spec.time_idx, spec.time)),
                ("n_lat", (spec.lat_idx, spec.lat)),
                ("n_lon", (spec.lon_idx, spec.lon)),
            )
            if row[n] == 0
            for c in columns
        ]
        absent += [c for e in spec.extra_names(dataset) if e not in levels.get(name, ()) for c in (f"{e}_idx", e)]
        return dataset.where(F.col("variable") == name).drop(*absent)

    def components(u: str | None, v: str | None) -> DataFrame | None:
        if not (u and v):
            return None
        east, north = cells(u), cells(v)
        return wind.pair_components(east, north, spec.row_order(east), spec)

    paired: dict[tuple, dict[str, DataFrame]] = {}

    def winds(u: str | None, v: str | None, target: DataFrame | None) -> dict[str, DataFrame]:
        """The panel of both components is the same at every position, and is built once."""
        if not (u and v):
            return wind_panel(None, target, spec)
        if (u, v) not in paired:
            paired[u, v] = wind_panel(components(u, v), spec=spec)
        return paired[u, v]

    page: dict[str, dict[str, DataFrame]] = {}
    main = cells(variable)
    if spec.has_space(main):
        page["heatmap"] = views.heatmap(main, index, spec)
        page["globe"] = views.globe(main, index, boundaries, spec)
    if spec.has_time(main):
        page["time_series"] = {"rows": cube.series_rows(main, spec, total_order=False)}
    for row in panels:
        target = cells(row["target"]) if row["target"] else None
        built = {
            "temperature": lambda: temperature_panel(target, spec),
            "rainfall": lambda: rainfall_panel(target, spec),
            "humidity": lambda: humidity_panel(target, spec),
            "distribution": lambda: views.distribution(target, spec),
            "wind": lambda: winds(row["u_variable"], row["v_variable"], target),
        }[row["panel"]]()
        page[f"{row['position']}_{row['panel']}"] = built
    return page
