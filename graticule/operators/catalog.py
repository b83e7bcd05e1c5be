"""What a long table holds, and which variable plays which part."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graticule.functions import classify
from graticule.operators.groups import broadcast_if_small, cut_lineage
from graticule.spec import DEFAULT, GridSpec, names


def catalog(df: DataFrame, spec: GridSpec = DEFAULT, dataset: str = "dataset_id") -> DataFrame:
    """One row per dataset and variable: axis lengths, cells and present values.

    Axis lengths come from the stored positions, which are dense. Only a table without positions needs distinct counts.
    ``ordinal`` is the order in the file (``variable_idx``), else the order of the names.
    """
    lengths = {}
    for label, idx, name in (
        ("n_time", spec.time_idx, spec.time),
        ("n_lat", spec.lat_idx, spec.lat),
        ("n_lon", spec.lon_idx, spec.lon),
    ):
        if idx in df.columns:
            lengths[label] = F.coalesce(F.max(idx) + 1, F.lit(0))
        elif name in df.columns:
            lengths[label] = F.countDistinct(name)
        else:
            lengths[label] = F.lit(0)
    in_file = [F.min("variable_idx").cast("int").alias("ordinal")] if "variable_idx" in df.columns else []
    listed = df.groupBy(dataset, "variable").agg(
        *[c.cast("bigint").alias(label) for label, c in lengths.items()],
        F.count("*").alias("n_cells"),
        F.count(spec.v()).alias("n_present"),
        *in_file,
    )
    if in_file:
        return listed
    by_name = Window.partitionBy(dataset).orderBy("variable")
    return listed.withColumn("ordinal", F.row_number().over(by_name) - 1)


def from_headers(headers: DataFrame, spec: GridSpec = DEFAULT, dataset: str = "dataset_id") -> DataFrame:
    """The same catalog from file headers, so that no cell is read. How many values are present is not known there."""
    sizes = F.map_from_arrays("dims", "sizes")

    def length(*named: str) -> Column:
        return F.coalesce(*[F.try_element_at(sizes, F.lit(n)) for n in named], F.lit(0)).cast("bigint")

    cells = F.aggregate("sizes", F.lit(1).cast("bigint"), lambda n, size: n * size)
    return headers.where(~F.col("is_coordinate")).select(
        dataset, "variable", length(spec.time, "time", "TIME").alias("n_time"), length(spec.lat).alias("n_lat"),
        length(spec.lon).alias("n_lon"), cells.alias("n_cells"), F.lit(None).cast("bigint").alias("n_present"),
        F.col("variable_idx").cast("int").alias("ordinal"),
    )


def levels_from_headers(headers: DataFrame, spec: GridSpec = DEFAULT, dataset: str = "dataset_id") -> DataFrame:
    """The further dimensions of each variable, as ``levels``, from file headers. Several files of a dataset add up."""
    axes = F.array(*[F.lit(c) for c in dict.fromkeys((spec.time, "time", "TIME", spec.lat, spec.lon))])
    further = headers.where(~F.col("is_coordinate")).groupBy(dataset, "variable").agg(F.flatten(F.collect_set("dims")).alias("dims"))
    return further.select(dataset, "variable", F.array_sort(F.array_except("dims", axes)).alias("levels"))


def mappable(catalog: DataFrame, with_time: bool = False) -> DataFrame:
    """Variables that span latitude and longitude, and time if asked."""
    spans = (F.col("n_lat") > 0) & (F.col("n_lon") > 0)
    return catalog.where(spans & (F.col("n_time") > 0) if with_time else spans)


def with_category(catalog: DataFrame) -> DataFrame:
    """Adds the category of each variable and its label."""
    return catalog.withColumn("category", classify.category(F.col("variable"))).withColumn(
        "category_label", classify.category_label(F.col("category"))
    )


def _first_match(keys: Sequence[str]) -> Column:
    hit = classify.contains_any(F.col("variable"), keys)
    return F.min_by("variable", F.when(hit, F.col("ordinal")))


def find_variable(catalog: DataFrame, keys: Sequence[str], by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """First variable in file order whose name contains a key. A dataset without one has no row."""
    hits = catalog.where(classify.contains_any(F.col("variable"), keys))
    return hits.groupBy(*names(by)).agg(F.min_by("variable", "ordinal").alias("found"))


def find_roles(catalog: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """The wind components, the humidity and the rainfall variable of each dataset, in one pass.

    A dataset with none of them has no row.
    """
    parts = {
        "u_variable": classify.WIND_U,
        "v_variable": classify.WIND_V,
        "humidity_variable": classify.HUMIDITY,
        "rain_variable": classify.RAINFALL,
    }
    every = [k for keys in parts.values() for k in keys]
    hits = catalog.where(classify.contains_any(F.col("variable"), every))
    return hits.groupBy(*names(by)).agg(*[_first_match(keys).alias(part) for part, keys in parts.items()])


def choose_variable(
    catalog: DataFrame,
    override: str | None = None,
    chosen: str | None = None,
    by: Sequence[str] = ("dataset_id",),
) -> DataFrame:
    """The typed name if the dataset has it, else the chosen one, else the first in file order."""
    variable = F.col("variable")
    wanted = [F.max(F.when(variable == name, variable)) for name in (override, chosen) if name]
    return catalog.groupBy(*names(by)).agg(F.coalesce(*wanted, F.min_by("variable", "ordinal")).alias("variable"))


def select_variable(
    df: DataFrame,
    override: str | None = None,
    chosen: str | None = None,
    spec: GridSpec = DEFAULT,
    dataset: str = "dataset_id",
    listed: DataFrame | None = None,
) -> DataFrame:
    """Rows of the chosen variable of every dataset. On a table stored by variable the scan skips the others.

    ``listed`` is a stored catalog; without it one is made, which reads every row. The choice runs as a job at once.
    """
    listed = catalog(df, spec, dataset) if listed is None else listed
    picked = cut_lineage(choose_variable(listed, override, chosen, [dataset]))
    return df.join(broadcast_if_small(picked), [dataset, "variable"], "left_semi")


def explore_panels(catalog: DataFrame, dataset: str = "dataset_id") -> DataFrame:
    """Which index panels each variable opens, in display order, and on which variable each of them works.

    ``wind_source`` tells whether a wind panel has both components, falls back to its target, or has no data.
    """
    roles = find_roles(catalog, [dataset])
    variable, category = F.col("variable"), F.col("category")
    listed = with_category(catalog).join(roles, dataset, "left")

    def panel(name: str, target: Column) -> Column:
        return F.struct(F.lit(name).alias("panel"), target.alias("target"))

    nothing = F.lit(None).cast("string")
    rain = panel("rainfall", F.coalesce("rain_variable", variable))
    indices = (
        F.when(category == "rainfall", F.array(panel("rainfall", variable), panel("temperature", variable)))
        .when(category == "wind", F.array(panel("wind", variable), panel("temperature", variable)))
        .when(category == "humidity", F.array(panel("humidity", variable), panel("wind", nothing)))
        .otherwise(F.array(panel("temperature", variable), rain))
    )
    overview = F.array(panel("distribution", variable), panel("wind", F.when(category == "wind", variable)))
    has_uv = F.col("u_variable").isNotNull() & F.col("v_variable").isNotNull()
    source = F.when(has_uv, F.lit("components")).when(F.col("target").isNotNull(), F.lit("fallback")).otherwise(F.lit("none"))
    return (
        listed.select("*", F.posexplode(F.concat(indices, overview)).alias("position", "entry"))
        .select(dataset, "variable", "category", "position", "entry.*", "u_variable", "v_variable")
        .withColumn("wind_source", F.when(F.col("panel") == "wind", source))
    )
