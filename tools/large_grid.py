"""Times operators on a generated grid that is larger than the given tables.

    python tools/large_grid.py FOLDER [DAYS LATS LONS]

Writes the grid to FOLDER once (a long table by variable, files sorted by time) and reads it back.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from graticule.operators import axis, catalog, cube, indices, series, stats, wind  # noqa: E402
from graticule.plans import views  # noqa: E402
from graticule.sources.tables import write_grid  # noqa: E402
from tools.compare import session  # noqa: E402


def generate(spark: SparkSession, days: int, lats: int, lons: int) -> DataFrame:
    """Temperature and two wind components with a few missing cells."""
    cell, per_day = F.col("id"), lats * lons
    day, rest = F.floor(cell / per_day).cast("int"), cell % per_day
    lat_idx, lon_idx = F.floor(rest / lons).cast("int"), (rest % lons).cast("int")
    noise = (F.xxhash64("id") % 1024) / 64
    season = F.sin(day / 58.1) * 12
    grid = spark.range(0, days * per_day, 1, 64).select(
        F.lit("model").alias("dataset_id"),
        day.alias("time_idx"),
        F.expr("timestamp_ntz'1990-01-01 00:00:00'") + F.make_dt_interval(day),
        lat_idx.alias("lat_idx"),
        (lat_idx * (180 / lats) - 90).alias("lat"),
        lon_idx.alias("lon_idx"),
        (lon_idx * (360 / lons) - 180).alias("lon"),
        F.when(cell % 997 != 0, season + noise + 10).alias("tas"),
        (season + noise).alias("uas"),
        (noise * 2 - 3).alias("vas"),
    )
    grid = grid.toDF("dataset_id", "time_idx", "time", "lat_idx", "lat", "lon_idx", "lon", "tas", "uas", "vas")
    ids = ["dataset_id", "time_idx", "time", "lat_idx", "lat", "lon_idx", "lon"]
    return cube.to_long(grid, ids, ["tas", "uas", "vas"])


def main() -> None:
    folder = sys.argv[1]
    days, lats, lons = (int(a) for a in sys.argv[2:5]) if len(sys.argv) > 4 else (3650, 90, 180)
    spark = session()
    path = Path(folder) / f"grid_{days}_{lats}_{lons}"
    began = time.perf_counter()
    if not path.exists():
        write_grid(generate(spark, days, lats, lons), f"file://{path}")
    print(f"write {time.perf_counter() - began:.1f} s", flush=True)
    grid = spark.read.parquet(f"file://{path}")
    tas = grid.where(F.col("variable") == "tas")
    uv = wind.pair_from_long(grid, "uas", "vas", ["time_idx", "lat_idx", "lon_idx"])
    cell = ["lat_idx", "lon_idx"]
    runs = {
        "spatial_mean": lambda: cube.spatial_mean(tas),
        "annual_mean": lambda: series.annual_mean_by_period(cube.spatial_mean(tas)),
        "extremes_per_cell": lambda: indices.extremes(tas, by=cell),
        "dry_streak": lambda: indices.longest_dry_streak(cube.spatial_mean(tas), dry_below=15),
        "dry_streak_per_cell": lambda: indices.longest_dry_streak(tas, by=cell, dry_below=15),
        "histogram": lambda: stats.histogram(tas),
        "histogram_per_latitude": lambda: stats.histogram(tas, by=["lat_idx"]),
        "histogram_per_latitude_salted": lambda: stats.histogram(tas, by=["lat_idx"], broadcast_rows=0),
        "global_stats": lambda: stats.global_stats(tas),
        "time_slice": lambda: axis.time_slice(tas, days // 2),
        "story": lambda: views.tell_story(tas)["frames"],
        "hotspot_per_time": lambda: cube.hotspot(tas, by=["time_idx"]),
        "wind_stats": lambda: wind.wind_stats(uv),
        "catalog": lambda: catalog.catalog(grid),
    }
    for name, run in runs.items():
        began = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        print(f"{name:32s} {time.perf_counter() - began:6.2f} s", flush=True)


if __name__ == "__main__":
    main()
