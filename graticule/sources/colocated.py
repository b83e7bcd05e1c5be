"""Long grids stored so that variables of the same cells meet without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame

from graticule.spec import DEFAULT, GridSpec, MissingRole

FLOATING = {"float", "double"}


def cell_keys(df: DataFrame, spec: GridSpec = DEFAULT) -> list[str]:
    """What tells the cells of a long grid apart, but for the variable: the dataset and the place on every axis.

    Axes need positions, or times: Spark normalises floating keys before it joins on them, so that rows stored by the hash
    of a coordinate would be shuffled again.
    """
    keys = ["dataset_id", *spec.row_order(df)]
    floating = [c for c in keys if df.schema[c].dataType.typeName() in FLOATING]
    if floating:
        raise MissingRole(f"cells are stored by positions, and {floating} have none in {df.columns}")
    return keys


def write_colocated(
    df: DataFrame, name: str, buckets: int, spec: GridSpec = DEFAULT, mode: str = "errorifexists", path: str | None = None
) -> None:
    """Stores a long grid as the table ``name``, by variable and in buckets by the hash of the cell, sorted by dataset and time.

    Joins of two variables on ``cell_keys`` then read bucket by bucket and shuffle nothing, and so do groupings of all
    variables of a cell. One shuffle deals the rows here, once, and makes one file for each variable and bucket. A bucket
    of a variable is read by one task: choose ``buckets`` as the stored bytes of the largest variable over some 128 MB.
    Cells differ, so that no dataset or time step makes a bucket large. Slices skip row groups by time within each file.
    The table's description lives in the session's catalog, which a metastore keeps for other sessions; without ``path``
    its files are in the warehouse. An empty grid makes an empty table; rows without a dataset or place go with the
    bucket of NULL, and join with nothing.
    """
    keys = cell_keys(df, spec)
    writer = df.repartition(buckets, *keys).write.mode(mode).format("parquet")
    writer = writer.partitionBy("variable").bucketBy(buckets, keys[0], *keys[1:]).sortBy(keys[0], *keys[1:])
    (writer.option("path", path) if path else writer).saveAsTable(name)
