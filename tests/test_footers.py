"""The catalog from Parquet footers against the one that counts cells."""

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from graticule.operators import catalog
from graticule.sources import footers
from graticule.sources.tables import read_grid, write_grid


def cells(spark):
    found = spark.range(600).select(
        F.concat(F.lit("run "), (F.col("id") % 2)).alias("dataset_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b/c").alias("variable"),
        (F.col("id") % 3).cast("int").alias("variable_idx"), (F.col("id") % 7).cast("int").alias("time_idx"),
        (F.col("id") % 5).cast("int").alias("lat_idx"), (F.col("id") % 4).cast("int").alias("lon_idx"),
    )
    return found.withColumn("value", F.when(F.col("time_idx") != 3, F.col("time_idx").cast("double")))


def test_equals_a_count_of_cells(spark, tmp_path):
    path = str(tmp_path / "grid")
    write_grid(cells(spark), path, files=3)
    write_grid(cells(spark).limit(0), str(tmp_path / "grid" / "_catalog"))
    found = footers.catalog_of_footers(spark, path)
    counted = catalog.catalog(read_grid(spark, path))
    assert sorted(map(tuple, found.select(counted.columns).collect())) == sorted(map(tuple, counted.collect())) != []


def test_files_without_statistics_are_counted(spark, tmp_path):
    folder = tmp_path / "dataset_id=x" / "variable=t%3Ay"
    folder.mkdir(parents=True)
    table = pa.table({"time_idx": pa.array([0, 1], pa.int32()), "value": [1.0, None]})
    pq.write_table(table, folder / "part-0.parquet", write_statistics=False)
    row = footers.catalog_of_footers(spark, str(tmp_path)).first()
    assert (row.variable, row.n_time, row.n_cells, row.n_present) == ("t:y", 2, 2, 1)
    assert footers.named_by_folders(str(folder / "part-0.parquet")) == {"dataset_id": "x", "variable": "t:y"}
