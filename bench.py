"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

$BENCH_QUERIES names other queries, separated by commas, or is "all". Each query runs once to warm up and then
$BENCH_REPEATS times (default 1); the median counts. Results go to Spark's no-op sink, so every row is computed and
none is collected.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from checks.queries import REGISTERED  # noqa: E402

HEADLINE = """
spatial_mean annual_mean_periods monthly_cycle extremes annual_total monthly_total heavy_days snow_days
longest_dry_streak dry_streak_per_cell time_slice slice_range compare_slices story_steps story_hotspots globe_points
normalise_slice boundary_vertices histogram distribution_mean global_stats wind_stats prevailing_direction
storm_counts wind_histogram wind_fallback humidity_stats series_rows export_slice_preview export_series_preview
catalog_of_runs unpivot_variables classify_variables find_variable dispatch csv_roundtrip netcdf_scan
""".split()


def session(cores: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("graticule-bench")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    asked = os.environ.get("BENCH_QUERIES", "")
    chosen = list(REGISTERED) if asked == "all" else asked.split(",") if asked else HEADLINE
    spark = session(cores)

    def run(name: str) -> float:
        began = time.perf_counter()
        REGISTERED[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    seconds = {}
    for name in chosen:
        run(name)
        seconds[name] = round(statistics.median(run(name) for _ in range(repeats)), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale[1]) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
