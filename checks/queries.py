"""The registered queries. Computed doubles are cut to six digits, off the ties, as the SQL does."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import netcdf_fixture, standins
from checks.shapefile_fixture import write_shapefiles
from graticule import GridSpec, sinks
from graticule.functions import calendar, classify, sphere
from graticule.operators import axis, boundary, catalog, cube, indices, series, stats, story, wind
from graticule.operators.groups import shared_dir
from graticule.plans import explore, pages, views
from graticule.sources import boundaries, colocated, footers, slabs
from graticule.sources.netcdf3 import ingest_netcdf3, read_catalog, read_netcdf3
from graticule.sources.shapefile import read_shapefile
from graticule.sources.tables import ingest_table, read_grid, write_grid

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, Query] = {}
PERIODS = {"baseline_until": 1997, "current_until": 1999}
DRY_BELOW = 15.0


def query(run: Query) -> Query:
    REGISTERED[run.__name__] = run
    return run


def cut(value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.floor(value * 1_000_000 + 0.123) / 1_000_000


def cut_all(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: cut(c) for c in columns})


def text_time(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns or ("time",)})


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share, as a URI."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/{uuid.uuid4().hex}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


# Series


@query
def spatial_mean(spark, sf_dir):
    return text_time(cube.spatial_mean(standins.temperature(spark, sf_dir)))


@query
def spatial_mean_levels(spark, sf_dir):
    return text_time(cut_all(cube.spatial_mean(standins.levels(spark, sf_dir), GridSpec(extra=("lev",))), "value"))


@query
def spatial_mean_levels_found(spark, sf_dir):
    """The level is known by its positions, without a spec that names it."""
    df = standins.levels(spark, sf_dir).withColumn("lev_idx", F.col("lev").cast("int") - 1)
    return text_time(cut_all(cube.spatial_mean(df), "value"))


@query
def series_rows(spark, sf_dir):
    return text_time(cube.series_rows(standins.temperature(spark, sf_dir)))


@query
def annual_mean_periods(spark, sf_dir):
    ts = cube.spatial_mean(standins.temperature(spark, sf_dir))
    return cut_all(series.annual_mean_by_period(ts, **PERIODS), "mean")


@query
def annual_mean_default_periods(spark, sf_dir):
    return cut_all(series.annual_mean_by_period(cube.spatial_mean(standins.temperature(spark, sf_dir))), "mean")


@query
def monthly_cycle(spark, sf_dir):
    return cut_all(series.monthly_cycle(cube.spatial_mean(standins.temperature(spark, sf_dir))), "mean")


@query
def annual_total(spark, sf_dir):
    return cut_all(series.annual_total(cube.spatial_mean(standins.temperature(spark, sf_dir))), "total")


@query
def annual_total_rain(spark, sf_dir):
    return cut_all(series.annual_total(cube.spatial_mean(standins.rain(spark, sf_dir))), "total")


@query
def monthly_total(spark, sf_dir):
    return cut_all(series.monthly_total(cube.spatial_mean(standins.temperature(spark, sf_dir))), "total")


@query
def monthly_total_per_cell(spark, sf_dir):
    return cut_all(series.monthly_total(standins.temperature(spark, sf_dir), by=["lat", "lon"]), "total")


# Indices


@query
def extremes(spark, sf_dir):
    ts = cube.spatial_mean(standins.temperature(spark, sf_dir))
    return text_time(indices.extremes(ts), "hottest_date", "coldest_date")


@query
def extremes_per_cell(spark, sf_dir):
    per_cell = indices.extremes(standins.temperature(spark, sf_dir), by=["lat", "lon"])
    return text_time(per_cell, "hottest_date", "coldest_date")


@query
def heavy_days(spark, sf_dir):
    return indices.heavy_days(cube.spatial_mean(standins.rain(spark, sf_dir)))


@query
def snow_days(spark, sf_dir):
    return cut_all(indices.snow_days(cube.spatial_mean(standins.rain(spark, sf_dir))), "snow_amount")


@query
def longest_dry_streak(spark, sf_dir):
    return indices.longest_dry_streak(cube.spatial_mean(standins.rain(spark, sf_dir)), dry_below=DRY_BELOW)


@query
def longest_dry_streak_default(spark, sf_dir):
    return indices.longest_dry_streak(cube.spatial_mean(standins.rain(spark, sf_dir)))


@query
def dry_streak_per_cell(spark, sf_dir):
    return indices.longest_dry_streak(standins.rain(spark, sf_dir), by=["lat", "lon"], dry_below=DRY_BELOW)


@query
def dry_streak_zonal(spark, sf_dir):
    """Several latitudes a step, with stored positions: the steps follow each other in row-major order."""
    zonal = standins.rain(spark, sf_dir).groupBy("time", "lat").agg(F.max("value").alias("value"))
    return indices.longest_dry_streak(axis.with_time_index(zonal), dry_below=DRY_BELOW)


@query
def dry_streak_by_position(spark, sf_dir):
    """The same over stored positions, on a long multi-year series."""
    ts = axis.with_time_index(cube.spatial_mean(standins.temperature(spark, sf_dir)))
    return indices.longest_dry_streak(ts, dry_below=25.0)


# Slices


@query
def time_axis(spark, sf_dir):
    return text_time(axis.time_axis(standins.rain(spark, sf_dir)))


@query
def time_slice(spark, sf_dir):
    return text_time(axis.time_slice(standins.temperature(spark, sf_dir), 100))


@query
def time_slice_clipped(spark, sf_dir):
    return text_time(axis.time_slice(standins.temperature(spark, sf_dir), 10**6))


@query
def time_slice_per_dataset(spark, sf_dir):
    return text_time(axis.time_slice(standins.runs(spark, sf_dir), 50, by=["dataset_id", "variable"]))


@query
def slices_at_many(spark, sf_dir):
    """Twelve evenly spaced slices, more than a story has."""
    df = standins.temperature(spark, sf_dir)
    spaced = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.floor((k * (F.col("nt") - 1)) / 11).cast("int"))
    return text_time(story.story_slices(df, axis.steps_at(df, spaced)))


@query
def slice_range(spark, sf_dir):
    return views.heatmap(standins.temperature(spark, sf_dir), 100)["range"]


@query
def compare_slices(spark, sf_dir):
    return text_time(views.compare(standins.temperature(spark, sf_dir), 10, 500)["cells"])


@query
def compare_ranges(spark, sf_dir):
    return views.compare(standins.temperature(spark, sf_dir), 10, 500)["range"]


@query
def story_steps(spark, sf_dir):
    return text_time(story.story_steps(standins.temperature(spark, sf_dir)))


@query
def story_hotspots(spark, sf_dir):
    frames = views.tell_story(standins.temperature(spark, sf_dir))["frames"]
    return frames.select("step", "time_idx", "symmetric_max", "hot_lat", "hot_lon", "hot_value")


@query
def story_globe(spark, sf_dir):
    told = views.tell_story(standins.temperature(spark, sf_dir))["globe"]
    return text_time(cut_all(told, "x", "y", "z", "normalised"))


@query
def hotspot_per_time(spark, sf_dir):
    wind_u = standins.atmosphere(spark, sf_dir).select("time", "lat", "lon", F.col("u").alias("value"))
    return text_time(cube.hotspot(wind_u, by=["time"]))


@query
def globe_points(spark, sf_dir):
    surface = views.globe(standins.temperature(spark, sf_dir), 100)["surface"]
    return text_time(cut_all(surface, "x", "y", "z", "normalised"))


@query
def normalise_slice(spark, sf_dir):
    cells = axis.time_slice(standins.temperature(spark, sf_dir), 2000)
    return text_time(cut_all(cube.normalise(cells), "normalised"))


@query
def normalise_per_time(spark, sf_dir):
    return text_time(cut_all(cube.normalise(standins.temperature(spark, sf_dir), by=["time"]), "normalised"))


@query
def sphere_of_grid(spark, sf_dir):
    cells = standins.humidity(spark, sf_dir)
    xyz = sphere.unit_sphere(F.col("lat"), F.col("lon"))
    places = cells.groupBy("lat", "lon").agg(F.count("*").alias("n"))
    return cut_all(places.withColumns(xyz), "x", "y", "z")


@query
def axis_lookup(spark, sf_dir):
    """Cells that keep only their latitude position, and the axis table of the latitudes."""
    cells = standins.humidity(spark, sf_dir)
    position = ((F.col("lat") + 60) / 30).cast("int").alias("lat_idx")
    lats = cells.select(position, "lat").distinct()
    placed = cube.attach_axis(cells.select(position, "value"), lats, "lat_idx")
    return cut_all(placed.groupBy("lat_idx", "lat").agg(F.count("*").alias("n"), F.avg("value").alias("mean")), "mean")


@query
def boundary_vertices(spark, sf_dir):
    shapes = standins.features(spark, sf_dir)
    rings = boundaries.exterior_rings(F.col("kind"), F.col("coordinates")).alias("rings")
    return cut_all(boundary.outline_vertices(shapes.select("name", rings)), "x", "y", "z")


@query
def boundary_scan(spark, sf_dir):
    """The same boundaries through GeoJSON files."""
    folder = scratch(spark)
    named = F.to_json(F.struct(F.col("name").alias("NAME")))
    geometry = F.when(
        F.col("kind").isNotNull(),
        F.format_string('{"type":"%s","coordinates":%s}', F.col("kind"), F.col("coordinates")),
    )
    line = F.format_string('{"type":"Feature","properties":%s,"geometry":%s}', named, F.coalesce(geometry, F.lit("null")))
    standins.features(spark, sf_dir).select(line.alias("value")).write.text(folder)
    return cut_all(boundary.outline_vertices(boundaries.read_boundaries(spark, folder)), "x", "y", "z")


@query
def boundary_collection(spark, sf_dir):
    """The same boundaries through pretty-printed collections of at most 500 features, read with the defaults."""
    folder = scratch(spark)
    shapes = standins.features(spark, sf_dir)
    geometry = F.when(
        F.col("kind").isNotNull(),
        F.format_string('{"type":"%s","coordinates":%s}', F.col("kind"), F.col("coordinates")),
    )
    named = F.to_json(F.struct(F.col("name").alias("NAME")))
    feature = F.format_string('{"type":"Feature","properties":%s,\n"geometry":%s}', named, F.coalesce(geometry, F.lit("null")))
    part = (F.substring("name", -9, 9).cast("int") / 500).cast("int")
    listed = shapes.groupBy(part.alias("part")).agg(F.array_join(F.collect_list(feature), ",\n").alias("all"))
    whole = F.format_string('{"type":"FeatureCollection",\n"features":[\n%s\n]}', F.col("all"))
    listed.select("part", whole.alias("value")).write.partitionBy("part").text(folder)
    return cut_all(boundary.outline_vertices(boundaries.read_boundaries(spark, folder)), "x", "y", "z")


@query
def boundary_split_collection(spark, sf_dir):
    """The same boundaries through collections of up to 5,000 features without a line break, cut at their features."""
    folder = scratch(spark)
    shapes = standins.features(spark, sf_dir)
    geometry = F.format_string('{"type":"%s","coordinates":%s}', F.col("kind"), F.col("coordinates"))
    named = F.to_json(F.struct(F.col("name").alias("NAME")))
    feature = F.format_string('{"type":"Feature","properties":%s,"geometry":%s}', named, F.coalesce(F.when(F.col("kind").isNotNull(), geometry), F.lit("null")))
    part = (F.substring("name", -9, 9).cast("int") / 5000).cast("int")
    listed = shapes.groupBy(part.alias("part")).agg(F.array_join(F.collect_list(feature), ",").alias("all"))
    whole = F.format_string('{"type":"FeatureCollection","features":[%s]}', F.col("all"))
    listed.select("part", whole.alias("value")).write.partitionBy("part").text(folder)
    return cut_all(boundary.outline_vertices(boundaries.read_boundaries(spark, folder, split=True)), "x", "y", "z")


@query
def boundary_shapefile(spark, sf_dir):
    """The same boundaries through shapefiles of at most 500 records."""
    folder = scratch(spark)
    part = (F.substring("name", -9, 9).cast("int") / 500).cast("int").alias("part")
    write_shapefiles(standins.features(spark, sf_dir).select("*", part), folder, "part")
    return cut_all(boundary.outline_vertices(read_shapefile(spark, folder)), "x", "y", "z")


# Distribution


@query
def histogram(spark, sf_dir):
    return stats.histogram(standins.humidity(spark, sf_dir))


@query
def histogram_temperature(spark, sf_dir):
    return stats.histogram(standins.temperature(spark, sf_dir))


@query
def histogram_per_latitude(spark, sf_dir):
    return stats.histogram(standins.humidity(spark, sf_dir), by=["lat"])


@query
def histogram_finite(spark, sf_dir):
    return stats.histogram(standins.gappy_humidity(spark, sf_dir))


@query
def histogram_infinite_cells(spark, sf_dir):
    return stats.histogram_range(standins.gappy_humidity(spark, sf_dir))


@query
def distribution_mean(spark, sf_dir):
    return cut_all(stats.distribution_mean(standins.humidity(spark, sf_dir)), "mean")


@query
def global_stats(spark, sf_dir):
    return cut_all(stats.global_stats(standins.humidity(spark, sf_dir)), "mean", "std")


@query
def global_stats_finite(spark, sf_dir):
    return cut_all(stats.global_stats(standins.gappy_humidity(spark, sf_dir)), "mean", "std")


@query
def missing_cells(spark, sf_dir):
    """NaN never passes a threshold and is not counted; infinity is."""
    cells = standins.gappy_humidity(spark, sf_dir)
    value = F.col("value")
    return text_time(
        cells.groupBy("time").agg(
            F.count("*").alias("n_cells"), F.count(value).alias("n_present"), F.count_if(value > 50).alias("n_above")
        )
    )


# Wind and humidity


def _components(spark, sf_dir) -> DataFrame:
    grid = standins.atmosphere(spark, sf_dir)
    keys = ["time", "lat", "lon"]
    u = grid.select(*keys, F.col("u").alias("value"))
    v = grid.select(*keys, F.col("v").alias("value"))
    return wind.pair_components(u, v, keys)


@query
def wind_stats(spark, sf_dir):
    found = wind.wind_stats(_components(spark, sf_dir)).select("n_speed", "mean_speed", "max_speed")
    return cut_all(found, "mean_speed", "max_speed")


@query
def wind_stats_per_cell(spark, sf_dir):
    found = wind.wind_stats(standins.atmosphere(spark, sf_dir), by=["lat", "lon"])
    return cut_all(found, "mean_speed", "max_speed", "mean_u", "mean_v", "direction")


@query
def wind_stats_long(spark, sf_dir):
    """Both components from one long table, joined on the cell. Two runs have them."""
    long = standins.runs(spark, sf_dir)
    uv = wind.pair_from_long(long, "uas", "vas", ["dataset_id", "time", "lat", "lon"])
    found = wind.wind_stats(uv, by=["dataset_id"])
    return cut_all(found, "mean_speed", "max_speed", "mean_u", "mean_v", "direction")


@query
def wind_stats_colocated(spark, sf_dir):
    """The same from a table stored by the hash of the cell: the components meet without a shuffle."""
    places = {f"{c}_idx": F.floor((F.col(c) - start) / step).cast("int") for c, start, step in (("lat", -60, 30), ("lon", -144, 72))}
    folder = scratch(spark)
    name = f"runs_{uuid.uuid4().hex}"
    colocated.write_colocated(standins.runs(spark, sf_dir).withColumns(places), name, 8, path=folder)
    stored = spark.table(name)
    uv = wind.pair_from_long(stored, "uas", "vas", colocated.cell_keys(stored))
    found = wind.wind_stats(uv, by=["dataset_id"])
    return cut_all(found, "mean_speed", "max_speed", "mean_u", "mean_v", "direction")


@query
def wind_gaps(spark, sf_dir):
    """Cells that only one component has: their means are independent, speed needs both."""
    uv = standins.atmosphere(spark, sf_dir)
    keys = ["time", "lat", "lon"]
    east = uv.where("lat <> -60").select(*keys, F.col("u").alias("value"))
    north = uv.where("lon <> -144").select(*keys, F.col("v").alias("value"))
    found = wind.wind_stats(wind.pair_components(east, north, keys))
    return cut_all(found, "mean_speed", "max_speed", "mean_u", "mean_v", "direction")


@query
def prevailing_direction(spark, sf_dir):
    found = wind.wind_stats(standins.atmosphere(spark, sf_dir)).select("mean_u", "mean_v", "direction", "compass")
    return cut_all(found, "mean_u", "mean_v", "direction")


@query
def storm_counts(spark, sf_dir):
    return cut_all(wind.storm_counts(standins.atmosphere(spark, sf_dir)), "peak_speed")


@query
def wind_panel(spark, sf_dir):
    found = explore.wind_panel(standins.atmosphere(spark, sf_dir))["wind"]
    return cut_all(found, "mean_speed", "max_speed", "mean_u", "mean_v", "direction", "peak_speed")


@query
def humidity_panel(spark, sf_dir):
    found = explore.humidity_panel(standins.humidity(spark, sf_dir))["humidity"]
    return cut_all(found, "mean", "min", "max")


@query
def temperature_panel_extremes(spark, sf_dir):
    panel = explore.temperature_panel(standins.temperature(spark, sf_dir))
    return text_time(panel["extremes"], "hottest_date", "coldest_date")


@query
def rainfall_panel_streak(spark, sf_dir):
    return explore.rainfall_panel(standins.rain(spark, sf_dir), dry_below=DRY_BELOW)["dry_streak"]


@query
def wind_histogram(spark, sf_dir):
    speed = wind.with_speed(standins.atmosphere(spark, sf_dir)).withColumn("speed", cut("speed"))
    return stats.histogram(speed, GridSpec(value="speed"))


@query
def wind_fallback(spark, sf_dir):
    return cut_all(stats.value_stats(standins.temperature(spark, sf_dir)).select("n", "mean", "max"), "mean")


@query
def humidity_stats(spark, sf_dir):
    return cut_all(stats.value_stats(standins.humidity(spark, sf_dir)), "mean", "min", "max")


# Catalog


def _catalog(spark, sf_dir) -> DataFrame:
    return catalog.catalog(standins.runs(spark, sf_dir))


@query
def catalog_of_runs(spark, sf_dir):
    return _catalog(spark, sf_dir).withColumn("ordinal", F.col("ordinal").cast("int"))


@query
def mappable_variables(spark, sf_dir):
    """Humidity has no place and sea temperature no time: neither is a map over time."""
    runs = standins.runs(spark, sf_dir)
    placed, timed = F.col("variable") != "hurs", F.col("variable") != "sst"
    partial = runs.withColumns({"lat": F.when(placed, F.col("lat")), "lon": F.when(placed, F.col("lon")), "time": F.when(timed, F.col("time"))})
    return catalog.mappable(catalog.catalog(partial), with_time=True).select("dataset_id", "variable")


@query
def unpivot_variables(spark, sf_dir):
    return text_time(cube.to_long(standins.atmosphere(spark, sf_dir), ["time", "lat", "lon"], ["u", "v", "hurs"]).withColumn("value", cut("value")))


@query
def pivot_variables(spark, sf_dir):
    every = sorted({v for names in standins.RUN_VARIABLES for v in names})
    return text_time(cube.to_wide(standins.runs(spark, sf_dir), ["dataset_id", "time", "lat", "lon"], every))


@query
def classify_variables(spark, sf_dir):
    names = standins.words(spark, sf_dir).select("variable").distinct()
    return catalog.with_category(names)


@query
def find_variable(spark, sf_dir):
    return catalog.find_variable(standins.words(spark, sf_dir), classify.RAINFALL)


@query
def find_roles(spark, sf_dir):
    return catalog.find_roles(_catalog(spark, sf_dir))


@query
def choose_variable(spark, sf_dir):
    return catalog.choose_variable(_catalog(spark, sf_dir), override="hurs", chosen="sst")


@query
def select_variable(spark, sf_dir):
    picked = catalog.select_variable(standins.runs(spark, sf_dir), override="hurs")
    return picked.groupBy("dataset_id", "variable").agg(F.count("*").alias("n"), F.max("value").alias("max"))


@query
def dispatch(spark, sf_dir):
    return catalog.explore_panels(_catalog(spark, sf_dir)).withColumn("position", F.col("position").cast("int"))


# Times


@query
def time_decode(spark, sf_dir):
    hours = F.col("o_orderkey") * 0.25
    decoded = calendar.decode_time(hours, "hours since 1995-01-01 06:00:00")
    return standins.table(spark, sf_dir, "orders").select("o_orderkey", decoded.cast("string").alias("time"))


@query
def time_parse(spark, sf_dir):
    key = F.col("o_orderkey")
    raw = F.concat(F.col("o_orderdate").cast("date").cast("string"), F.when(key % 7 == 0, F.lit(" noon")).otherwise(F.lit("")))
    return standins.table(spark, sf_dir, "orders").select("o_orderkey", calendar.parse_time(raw).cast("string").alias("time"))


@query
def time_labels(spark, sf_dir):
    """Orders of one status carry no readable date, so their labels stay raw."""
    day = F.col("o_orderdate").cast("date").cast("string")
    raw = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("step "), day)).when(F.day("o_orderdate") == 1, F.lit("?")).otherwise(day)
    steps = standins.table(spark, sf_dir, "orders").select("o_orderstatus", raw.alias("raw")).distinct()
    return story.time_labels(steps, "raw", ["o_orderstatus"])


@query
def time_numeric(spark, sf_dir):
    """Times as day numbers, decoded by their units."""
    days = F.datediff("time", F.lit("1990-01-01"))
    df = ingest_table(standins.temperature(spark, sf_dir).withColumn("time", days), units="days since 1990-01-01")
    return cube.spatial_mean(df).select(F.date_format("time", "yyyy-MM-dd").alias("time"), "value")


@query
def time_zoned(spark, sf_dir):
    """Instants an hour after midnight in UTC stay on their day in any session zone."""
    instant = F.timestamp_seconds(F.unix_date("time") * 86_400 + 3_600)
    df = ingest_table(standins.temperature(spark, sf_dir).withColumn("time", instant))
    return cube.spatial_mean(df).select(F.date_format("time", "yyyy-MM-dd HH").alias("time"), "value")


@query
def story_labels_raw(spark, sf_dir):
    """No time of this record parses, so its steps are labelled by what the axis says."""
    df = axis.with_time_index(standins.temperature(spark, sf_dir))
    df = ingest_table(df.withColumn("time", F.concat(F.lit("day "), F.col("time").cast("string"))))
    return story.story_steps(df).select("step", "time_idx", "label")


# Exports and files


@query
def export_slice_preview(spark, sf_dir):
    return text_time(sinks.preview(sinks.slice_table(standins.temperature(spark, sf_dir), "t2m", 100)))


@query
def export_series_preview(spark, sf_dir):
    return text_time(sinks.preview(sinks.series_table(standins.temperature(spark, sf_dir), "t2m")))


@query
def export_stats(spark, sf_dir):
    return cut_all(sinks.stats_table(standins.humidity(spark, sf_dir), "hurs"), "mean", "std")


@query
def csv_roundtrip(spark, sf_dir):
    folder = scratch(spark)
    path = sinks.export_series(standins.temperature(spark, sf_dir), folder, "t2m")
    return spark.read.schema("time string, t2m double").option("header", True).csv(path)


@query
def csv_slice_roundtrip(spark, sf_dir):
    folder = scratch(spark)
    path = sinks.export_slice(standins.temperature(spark, sf_dir), folder, "t2m", 2000)
    return spark.read.schema("lat double, lon double, time string, t2m double").option("header", True).csv(path)


@query
def stats_csv_roundtrip(spark, sf_dir):
    path = sinks.export_stats(standins.humidity(spark, sf_dir), scratch(spark), "hurs")
    schema = "variable string, n_points long, mean double, min double, max double, std double"
    return cut_all(spark.read.schema(schema).option("header", True).csv(path), "mean", "std")


@query
def grid_roundtrip(spark, sf_dir):
    """Datasets with the names 001 and 1 stay apart when their folders are read back."""
    run = F.substring("dataset_id", 4, 9).cast("int")
    named = standins.runs(spark, sf_dir).withColumn("dataset_id", F.when(run % 2 == 0, F.lit("001")).otherwise(F.lit("1")))
    path = f"{scratch(spark)}/grid"
    write_grid(named, path)
    found = read_grid(spark, path).groupBy("dataset_id", "variable")
    return found.agg(F.count("*").alias("n"), F.max("value").alias("max"))


def _wind_files(spark, sf_dir) -> str:
    folder = scratch(spark)
    netcdf_fixture.write_years(standins.atmosphere(spark, sf_dir), folder)
    return folder


@query
def netcdf_scan(spark, sf_dir):
    cells = read_netcdf3(spark, _wind_files(spark, sf_dir), slabBytes=65_536)
    found = cells.where(F.col("variable").isin("uas", "vas")).drop("variable_idx")
    return found.withColumn("time", F.date_format("time", "yyyy-MM-dd"))


@query
def netcdf_scan_all(spark, sf_dir):
    """All variables in one scan."""
    found = read_netcdf3(spark, _wind_files(spark, sf_dir), slabBytes=65_536).drop("variable_idx")
    return found.withColumns({"time": F.date_format("time", "yyyy-MM-dd"), "value": cut("value")})


@query
def netcdf_catalog(spark, sf_dir):
    cells = read_netcdf3(spark, _wind_files(spark, sf_dir))
    return catalog.catalog(cells)


@query
def stored_catalog(spark, sf_dir):
    """The catalog that ingest writes from the headers."""
    target = f"{scratch(spark)}/grid"
    ingest_netcdf3(spark, _wind_files(spark, sf_dir), target, files=12)
    return read_catalog(spark, target).drop("n_present")


@query
def explore_page(spark, sf_dir):
    """Single-row panels of the main page of one run, flattened to panel, metric and value."""
    page = explore.explore(standins.runs(spark, sf_dir), "run1", override="hurs")
    rows = None
    for panel in ("0_humidity", "1_wind", "2_distribution"):
        for name, df in page[panel].items():
            numbers = [c for c, kind in df.dtypes if kind in ("double", "bigint")]
            if name in ("histogram",):
                continue
            flat = df.select(F.lit(f"{panel}.{name}").alias("panel"), F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), cut(F.col(c).cast("double")).alias("value")) for c in numbers])))
            rows = flat if rows is None else rows.unionByName(flat)
    return rows


@query
def explore_pages(spark, sf_dir):
    """All panels of the pages of all variables of all runs, flattened: an item is a year, month or bin, else 0."""
    whole = F.pmod(F.rint(F.col("value") * 100), F.lit(64.0))  # whole numbers have exact sums, so that ties are ties
    grid = standins.runs(spark, sf_dir).withColumn("value", whole)
    found = pages.all_pages(grid, index=50, dry_below=DRY_BELOW, **PERIODS)
    rows = None
    for (panel, result), df in found.items():
        if result == "cells":
            df = df.groupBy("dataset_id", "variable", "position").agg(F.count("value").alias("n"), F.sum("value").alias("total"))
        item = next((c for c in ("year", "month", "bin") if c in df.columns), None)
        days = {c: F.unix_date(c) for c, kind in df.dtypes if kind == "date"}
        df = df.withColumns(days)
        numbers = [c for c, kind in df.dtypes if kind in ("double", "bigint", "int") and c not in ("position", item)]
        metrics = F.array(*[F.struct(F.lit(c).alias("metric"), cut(F.col(c).cast("double")).alias("value")) for c in numbers])
        flat = df.select(
            "dataset_id", "variable", F.col("position").cast("int").alias("position"), F.lit(f"{panel}.{result}").alias("panel"),
            (F.col(item) if item else F.lit(0)).cast("int").alias("item"), F.inline(metrics),
        )
        rows = flat if rows is None else rows.unionByName(flat)
    return rows


@query
def netcdf_header(spark, sf_dir):
    listed = read_netcdf3(spark, _wind_files(spark, sf_dir), content="header")
    return listed.select(
        "dataset_id", "variable", "is_coordinate",
        F.concat_ws(",", "dims").alias("dims"), F.concat_ws(",", F.col("sizes").cast("array<string>")).alias("sizes"),
    )


# Files by their index of slabs


def _hdf5_files(spark, sf_dir) -> str:
    folder = scratch(spark)
    netcdf_fixture.write_years(standins.atmosphere(spark, sf_dir), folder, netcdf_fixture.wind_year_hdf5)
    return folder


def _model_files(spark, sf_dir, made) -> str:
    folder = scratch(spark)
    netcdf_fixture.write_years(standins.temperature(spark, sf_dir), folder, made, "tas")
    return folder


def _plain_cells(cells: DataFrame) -> DataFrame:
    found = cells.drop("variable_idx", "time_fields", "time_raw")
    return found.withColumns({"time": F.date_format("time", "yyyy-MM-dd"), "value": cut("value")})


def stem(pattern: str = r"([^/]*)_[0-9]+\.[^./]*$") -> Column:
    """The name of a file without its year: a dataset for all of them."""
    return F.regexp_extract("path", pattern, 1)


@query
def hdf5_scan(spark, sf_dir):
    """Chunked and compressed files of four styles, cell by cell."""
    return _plain_cells(slabs.read_netcdf(spark, _hdf5_files(spark, sf_dir)))


@query
def hdf5_catalog(spark, sf_dir):
    """The catalog from the index: no cell is read."""
    return slabs.catalog_of_index(slabs.indexed(spark, _hdf5_files(spark, sf_dir)))


@query
def netcdf_joined(spark, sf_dir):
    """A file a year as one dataset: steps are numbered on from file to file."""
    return _plain_cells(slabs.read_netcdf(spark, _wind_files(spark, sf_dir), dataset=stem()))


@query
def hdf5_joined_steps(spark, sf_dir):
    """A stretch of steps of one variable, across the border of two files."""
    return _plain_cells(slabs.read_netcdf(spark, _hdf5_files(spark, sf_dir), ["hurs"], stem(), steps=(300, 420)))


@query
def wind_from_files(spark, sf_dir):
    """Wide rows straight from classic files: the components need no join."""
    cells = slabs.read_netcdf(spark, _wind_files(spark, sf_dir), ["uas", "vas"], stem(), wide=True)
    found = wind.wind_summary(cells.withColumnsRenamed({"uas": "u", "vas": "v"}), by=["dataset_id"])
    return cut_all(found, "mean_speed", "max_speed", "mean_u", "mean_v", "direction", "peak_speed")


@query
def wind_from_hdf5(spark, sf_dir):
    """The same from files in which the components are chunked differently."""
    cells = slabs.read_netcdf(spark, _hdf5_files(spark, sf_dir), ["uas", "vas"], stem(), wide=True)
    found = wind.wind_summary(cells.withColumnsRenamed({"uas": "u", "vas": "v"}), by=["dataset_id"])
    return cut_all(found, "mean_speed", "max_speed", "mean_u", "mean_v", "direction", "peak_speed")


@query
def annual_mean_noleap(spark, sf_dir):
    """Years of a calendar without leap days, over several NetCDF-4 files."""
    cells = slabs.read_netcdf(spark, _model_files(spark, sf_dir, netcdf_fixture.noleap_year), dataset=stem())
    return cut_all(series.annual_mean_by_period(cube.spatial_mean(cells), **PERIODS), "mean")


@query
def monthly_total_noleap(spark, sf_dir):
    cells = slabs.read_netcdf(spark, _model_files(spark, sf_dir, netcdf_fixture.noleap_year), dataset=stem())
    return cut_all(series.monthly_total(cube.spatial_mean(cells)), "total")


@query
def monthly_cycle_360(spark, sf_dir):
    """Months of 30 days, over several classic files."""
    cells = slabs.read_netcdf(spark, _model_files(spark, sf_dir, netcdf_fixture.year_of_360_days), dataset=stem())
    return cut_all(series.monthly_cycle(cube.spatial_mean(cells)), "mean")


@query
def story_labels_360(spark, sf_dir):
    """Labels of the steps of a story in a model calendar, and of every 30 February."""
    cells = slabs.read_netcdf(spark, _model_files(spark, sf_dir, netcdf_fixture.year_of_360_days), dataset=stem())
    told = story.story_steps(cells).select("step", "time_idx", "label")
    late = cells.where("time_fields.month = 2 and time_fields.day = 30").groupBy("time_idx").agg(F.max("time_raw").alias("label"))
    return told.unionByName(late.select(F.lit(-1).alias("step"), "time_idx", "label"))


@query
def extremes_360(spark, sf_dir):
    """Hottest and coldest day, as days of the model calendar."""
    cells = slabs.read_netcdf(spark, _model_files(spark, sf_dir, netcdf_fixture.year_of_360_days), dataset=stem())
    return indices.extremes(cube.spatial_mean(cells)).drop("hottest_date", "coldest_date")


@query
def footer_catalog(spark, sf_dir):
    """The catalog of a stored grid from the footers of its files."""
    target = f"{scratch(spark)}/grid"
    cells = slabs.read_netcdf(spark, _wind_files(spark, sf_dir), dataset=stem())
    write_grid(cells.drop("time_fields", "time_raw"), target, files=8)
    return footers.catalog_of_footers(spark, target)
