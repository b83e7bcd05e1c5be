"""The catalog of a stored grid from the footers of its Parquet files: no column is read."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graticule.operators import catalog
from graticule.operators.groups import cut_lineage
from graticule.shipping import ship
from graticule.sources.netcdf3 import open_path
from graticule.sources.slabs import list_files
from graticule.sources.tables import IDS, read_grid
from graticule.spec import DEFAULT, GridSpec

NO_NAME = "__HIVE_DEFAULT_PARTITION__"
ROLES = ("time", "lat", "lon", "variable")


def named_by_folders(path: str) -> dict[str, str | None]:
    """Dataset and variable of a file, as the folders above it say."""
    said = dict(part.split("=", 1) for part in path.split("/")[:-1] if "=" in part)
    return {k: None if said.get(k, NO_NAME) == NO_NAME else unquote(said[k]) for k in IDS}


def file_facts(file, spec: GridSpec = DEFAULT) -> dict:
    """Rows and present values of a file and the last position on each axis, from its footer. ``known`` is false where a
    row group keeps no statistics of a column that is needed."""
    meta = pq.read_metadata(file)
    columns = {"time": spec.time_idx, "lat": spec.lat_idx, "lon": spec.lon_idx, "variable": "variable_idx"}
    place = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
    facts: dict = {"n_cells": meta.num_rows, "n_present": 0, "known": spec.value in place and spec.time_idx in place}
    facts |= {f"last_{r}": None for r in ROLES} | {"first_variable": None}
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        for role, name in (*columns.items(), ("value", spec.value)):
            if name not in place:
                continue
            stats = group.column(place[name]).statistics
            if stats is None or not stats.has_null_count:
                facts["known"] = False
            elif role == "value":
                facts["n_present"] += group.num_rows - stats.null_count
            elif stats.has_min_max:
                facts[f"last_{role}"] = max(stats.max, facts[f"last_{role}"] if facts[f"last_{role}"] is not None else stats.max)
                if role == "variable":
                    facts["first_variable"] = min(stats.min, facts["first_variable"] if facts["first_variable"] is not None else stats.min)
            elif stats.null_count < group.num_rows:
                facts["known"] = False
    return facts


def footer_facts(spark: SparkSession, path: str, spec: GridSpec = DEFAULT) -> DataFrame:
    """A row for each file of a grid that ``write_grid`` stored: what its footer says. Tasks list the folders and read the
    footers; ``modified`` and ``bytes`` tell which rows a later run may keep."""
    ship(spark)
    files = list_files(spark, path, (".parquet",))
    kinds = {"n_cells": pa.int64(), "n_present": pa.int64(), "known": pa.bool_(), **{f"last_{r}": pa.int32() for r in ROLES}, "first_variable": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name in batch.column("path").to_pylist():
                fs, where = open_path(name)
                with fs.open_input_file(where) as file:
                    rows.append({**named_by_folders(where), **file_facts(file, spec)})
            found = {c: pa.array([r[c] for r in rows], t) for c, t in ({k: pa.string() for k in IDS} | kinds).items()}
            yield pa.RecordBatch.from_arrays([*batch.columns, *found.values()], [*batch.schema.names, *found])

    numbers = ", ".join(f"last_{r} int" for r in ROLES)
    schema = f"path string, bytes bigint, modified bigint, dataset_id string, variable string, n_cells bigint, n_present bigint, known boolean, {numbers}, first_variable int"
    tasks = max(1, min(10_000, files.count() // 64))
    inside = ~F.col("path").rlike("/[_.][^/]*/")  # other tables beside the grid, such as its catalog
    return files.where(inside).repartition(tasks).mapInArrow(run, schema)


def catalog_of_footers(spark: SparkSession, path: str, spec: GridSpec = DEFAULT) -> DataFrame:
    """``catalog.catalog`` of a stored grid with positions, without reading a column. Where a file keeps no statistics or no
    positions, the cells are counted instead. Rows of empty files count for nothing; an empty folder has no row."""
    facts = cut_lineage(footer_facts(spark, path, spec))
    if not facts.where("not known and n_cells > 0").isEmpty():
        return catalog.catalog(read_grid(spark, path, spec), spec)
    listed = facts.where("n_cells > 0").groupBy(*IDS).agg(
        *[F.coalesce(F.max(f"last_{r}") + 1, F.lit(0)).cast("bigint").alias(f"n_{r}") for r in ("time", "lat", "lon")],
        F.sum("n_cells").alias("n_cells"), F.sum("n_present").alias("n_present"), F.min("first_variable").cast("int").alias("ordinal"),
    )
    return listed
