"""Boundaries from files, CSV exports, and whole pages."""

import csv
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from checks.shapefile_fixture import file_bytes, shape_bytes
from graticule import sinks
from graticule.operators import boundary, catalog
from graticule.plans import explore, pages, views
from graticule.sources import boundaries, shapefile

SQUARE = [[0, 0], [1, 0], [1, 1], [0, 0]]
FEATURES = [
    {"type": "Feature", "properties": {"NAME": "A", "POP": 5}, "geometry": {"type": "Polygon", "coordinates": [SQUARE, SQUARE]}},
    {"type": "Feature", "properties": {"NAME": "B"}, "geometry": {"type": "MultiPolygon", "coordinates": [[SQUARE], [SQUARE[:3]]]}},
    {"type": "Feature", "properties": {"NAME": "C"}, "geometry": {"type": "LineString", "coordinates": SQUARE}},
    {"type": "Feature", "properties": {"NAME": "D"}, "geometry": None},
]


def test_boundaries_from_files(spark, tmp_path):
    lines, whole = tmp_path / "lines.json", tmp_path / "whole.json"
    lines.write_text("\n".join(json.dumps(f) for f in FEATURES))
    whole.write_text(json.dumps({"type": "FeatureCollection", "features": FEATURES}, indent=1))
    for table in (
        boundaries.read_boundaries(spark, str(lines)),
        boundaries.read_boundaries(spark, str(whole), per_line=False),
        boundaries.read_boundaries(spark, str(tmp_path / "absent.json"), str(lines)),
    ):
        counts = {r["name"]: r["count"] for r in boundary.outline_vertices(table).groupBy("name").count().collect()}
        assert counts == {"A": 4, "B": 7}
    stored = f"{tmp_path}/b.parquet"
    boundaries.read_boundaries(spark, str(lines)).write.parquet(stored)
    assert boundary.outline_vertices(boundaries.read_boundaries(spark, stored)).count() == 11
    assert boundaries.read_boundaries(spark, str(tmp_path / "absent.json")).count() == 0


def read_csv(path):
    rows = []
    for part in sorted(Path(path).glob("part-*.csv")):
        rows += list(csv.DictReader(part.open()))
    return rows


def test_exports(grid, tmp_path):
    cells = grid([(t, y, x, float(t * 100 + y * 10 + x)) for t in range(3) for y in (1, 0) for x in (1, 0)] + [(3, 0, 0, float("nan"))])
    path = sinks.export_slice(cells, str(tmp_path), "tas", 1)
    assert path.endswith("tas_map_slice_t1.csv")
    rows = read_csv(path)
    assert [float(r["tas"]) for r in rows] == [100.0, 101.0, 110.0, 111.0]
    assert list(rows[0]) == ["lat", "lon", "time", "tas"] and rows[0]["time"].startswith("2001-01-02 00:00:00")

    path = sinks.export_series(cells, str(tmp_path), "tas")
    assert path.endswith("tas_timeseries.csv")
    assert [r["tas"] for r in read_csv(path)] == ["5.5", "105.5", "205.5", ""]

    path = sinks.export_stats(cells, str(tmp_path), "tas")
    (row,) = read_csv(path)
    assert (row["variable"], row["n_points"], row["min"], row["max"]) == ("tas", "12", "0.0", "211.0")

    still = cells.where("time_idx = 0").drop("time", "time_idx")
    assert sinks.slice_name(still, "orog", 0) == "orog_map_slice.csv"
    assert sinks.slice_table(still, "orog").columns == ["lat", "lon", "orog"]
    with pytest.raises(ValueError):
        sinks.series_table(still, "orog")


def test_preview_is_a_top_n(grid):
    cells = grid([(0, y, x, 1.0) for y in range(10) for x in range(10)])
    table = sinks.preview(sinks.slice_table(cells, "tas"))
    assert "TakeOrderedAndProject" in table._jdf.queryExecution().executedPlan().toString()
    assert [(r.lat, r.lon) for r in table.collect()][:11] == [(0.0, float(x)) for x in range(10)] + [(1.0, 0.0)]


@pytest.fixture
def dataset(grid):
    cells = grid([(t, y, x, float((t * 5 + y * 3 + x) % 37)) for t in range(40) for y in range(2) for x in range(2)])
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("variable"), F.lit(i).alias("variable_idx")) for i, n in enumerate(("tas", "pr", "uas", "vas", "hurs"))]))
    long = cells.select("*", named.alias("n")).select(*cells.columns, "n.*")
    still = long.where("time_idx = 0 and variable = 'tas'").withColumns(
        {"variable": F.lit("orog"), "variable_idx": F.lit(9), "time_idx": F.lit(None).cast("int"), "time": F.lit(None).cast("timestamp_ntz")}
    )
    return long.unionByName(still).withColumn("dataset_id", F.lit("d"))


@pytest.mark.parametrize(
    "variable, panels",
    [
        (None, ["0_temperature", "1_rainfall", "2_distribution", "3_wind"]),
        ("pr", ["0_rainfall", "1_temperature", "2_distribution", "3_wind"]),
        ("uas", ["0_wind", "1_temperature", "2_distribution", "3_wind"]),
        ("hurs", ["0_humidity", "1_wind", "2_distribution", "3_wind"]),
    ],
)
def test_explore(dataset, variable, panels):
    page = explore.explore(dataset, "d", override=variable)
    assert [p for p in page if p[0].isdigit()] == panels
    assert page["heatmap"]["cells"].count() == 4
    assert page["3_wind"]["wind"].first().n_speed == 160
    if variable is None:
        assert page["0_temperature"]["annual_mean"].first().year == 2001
        assert page["1_rainfall"]["heavy_days"].first().heavy_days > 0
        assert page["time_series"]["rows"].count() == 160


def test_explore_of_a_static_field(dataset):
    page = explore.explore(dataset, "d", override="orog", boundaries=None)
    assert page["heatmap"]["cells"].count() == 4
    assert "time_series" not in page and page["0_temperature"] == {}
    assert set(page["1_rainfall"]) == {"snow", "annual_total", "monthly_total", "heavy_days", "dry_streak"}
    alone = explore.explore(dataset.where("variable = 'orog'"), "d")
    assert set(alone["1_rainfall"]) == {"snow"} and alone["3_wind"] == {}


def test_all_pages_hold_each_page(dataset):
    """Every result of a page is that of ``explore``, for another dataset beside it too."""
    both = dataset.unionByName(dataset.where("variable <> 'pr'").withColumns({"dataset_id": F.lit("e"), "value": F.col("value") + 1}))
    unnamed = dataset.where("time_idx = 0").withColumn("dataset_id", F.lit(None).cast("string"))
    every = {key: (df.columns, df.collect()) for key, df in pages.all_pages(both.unionByName(unnamed)).items()}
    for variable, least in (("tas", 10), ("hurs", 6)):
        panels = {k: v for k, v in explore.explore(dataset, "d", override=variable).items() if k[0].isdigit()}
        shown = [(int(name[0]), name[2:], result, df) for name, results in panels.items() for result, df in results.items()]
        assert len(shown) >= least
        for position, panel, result, df in shown:
            columns, rows = every[panel, result]
            mine = [r for r in rows if (r.dataset_id, r.variable, r.position) == ("d", variable, position)]
            assert sorted(tuple(r[c] for c in df.columns) for r in mine) == sorted(map(tuple, df.collect())), (panel, result)
        assert sum(r.dataset_id == "d" and r.variable == variable for r in every["view", "cells"][1]) == 4


def test_all_pages_of_awkward_grids(dataset):
    assert all(df.isEmpty() for df in pages.all_pages(dataset.where("false")).values())
    alone = pages.all_pages(dataset.where("variable = 'orog'"))
    assert alone["rainfall", "snow"].count() == 1 and alone["wind", "wind"].count() == 0


def test_levels_of_a_page_come_from_the_catalog(dataset, spark):
    height = dataset.withColumns({"lev_idx": F.lit(None).cast("int"), "lev": F.lit(None).cast("double")})
    deep = height.where("variable = 'tas'").withColumns({"lev_idx": F.lit(1), "lev": F.lit(500.0)})
    grid = height.where("variable <> 'tas'").unionByName(deep)
    listed = catalog.catalog(grid)
    told = listed.withColumn("levels", F.when(F.col("variable") == "tas", F.array(F.lit("lev"))))
    spec = explore.DEFAULT
    assert explore.levels_by_variable(grid, spec, told)["tas"] == explore.levels_by_variable(grid, spec)["tas"] == ["lev"]
    unread = grid.withColumn("lev", F.raise_error(F.lit("a cell was read")).cast("double"))
    assert explore.levels_by_variable(unread, spec, told)["pr"] == []
    page = explore.explore(grid, "d", override="tas", listed=told)
    assert "lev" in page["heatmap"]["cells"].columns
    assert "lev" not in explore.explore(grid, "d", override="pr", listed=told)["heatmap"]["cells"].columns
    headers = spark.createDataFrame(
        [("d", "tas", False, ["time", "lev", "lat", "lon"]), ("d", "pr", False, ["time", "lat", "lon"]), ("d", "lev", True, ["lev"])],
        "dataset_id string, variable string, is_coordinate boolean, dims array<string>",
    )
    assert {r.variable: r.levels for r in catalog.levels_from_headers(headers).collect()} == {"tas": ["lev"], "pr": []}


def test_views(dataset):
    tas = dataset.where("variable = 'tas'")
    compared = views.compare(tas, 3, 3)
    assert {r["slice"]: r["count"] for r in compared["cells"].groupBy("slice").count().collect()} == {"A": 4, "B": 4}
    told = views.tell_story(tas)
    assert [r.time_idx for r in told["frames"].orderBy("step").collect()] == [0, 7, 15, 23, 31, 39]
    assert told["globe"].where("abs(x * x + y * y + z * z - 1) > 1e-12").count() == 0
    assert views.globe(tas, 0)["surface"].count() == 4


def collection(text_of_features, more=""):
    return f'{{"type":"FeatureCollection","name":"x","features":[{text_of_features}]{more}}}'


@pytest.mark.parametrize("spaced", [False, True])
def test_one_long_object_is_read_by_several_tasks(spark, tmp_path, spaced):
    many = [dict(f, properties={"NAME": f"{f['properties']['NAME']}{k}"}) for k in range(300) for f in FEATURES]
    separators, path = (" , ", " : ") if spaced else (",", ":"), tmp_path / "one.json"
    path.write_text(collection(",".join(json.dumps(f, separators=separators) for f in many), ',"bbox":[0,0,1,1]'))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        table = boundaries.read_boundaries(spark, str(path), split=True)
        rows = table.select("name", "rings", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len({r.task for r in rows}) > 4
    assert sorted(r.name for r in rows) == sorted(f["properties"]["NAME"] for f in many)
    assert {(r.name[0], len(r.rings) if r.rings is not None else None) for r in rows} == {("A", 1), ("B", 2), ("C", None), ("D", None)}


def test_collections_that_cannot_be_cut(spark, tmp_path):
    feature = json.dumps(FEATURES[0])
    for k, (text, count) in enumerate([
        (collection(""), 0), (collection(feature), 1), (collection(feature.replace('"A"', '"Feature"')), None),
        (collection('{"properties":{"NAME":"A"},"type":"Feature","geometry":null}'), None), (collection(feature)[:-30], None),
    ]):
        path = tmp_path / f"{k}.json"
        path.write_text(text)
        table = boundaries.read_geojson(spark, str(path), split=True)
        if count is None:
            with pytest.raises(Exception):
                table.collect()
        else:
            assert len(table.collect()) == count


SHAPES = [
    shape_bytes([SQUARE[::-1], SQUARE]),  # a hole runs the other way
    shape_bytes([SQUARE[::-1], [[x + 5, y] for x, y in SQUARE[::-1]]]),
    shape_bytes([SQUARE]),  # alone, it is outer
    shape_bytes(None, [1, 2]), shape_bytes(None),
]


def save_shapefile(folder, shapes, names, stem="a", upper=False, **other):
    folder.mkdir(exist_ok=True)
    for suffix, content in {**file_bytes(shapes, names), **other}.items():
        (folder / f"{stem}.{suffix.upper() if upper else suffix}").write_bytes(content)
    return str(folder / f"{stem}.{'SHP' if upper else 'shp'}")


@pytest.mark.parametrize("upper", [False, True])
def test_shapefile(spark, tmp_path, monkeypatch, upper):
    monkeypatch.setattr(shapefile, "RECORDS", 2)
    path = save_shapefile(tmp_path / "s", SHAPES, ["A", "Åland", "", "P", "N"], upper=upper)
    for table in (boundaries.read_boundaries(spark, path), boundaries.read_boundaries(spark, str(tmp_path / "none.shp"), path), shapefile.read_shapefile(spark, str(tmp_path / "s"), "name")):
        rows = {r.name: [[(p.lon, p.lat) for p in ring] for ring in r.rings] if r.rings is not None else None for r in table.collect()}
        square = [tuple(map(float, p)) for p in SQUARE]
        assert rows == {"A": [square], "Åland": [square, [(x + 5, y) for x, y in square]], None: [square], "P": None, "N": None}


def test_awkward_shapefiles(spark, tmp_path):
    assert shapefile.read_shapefile(spark, save_shapefile(tmp_path / "empty", [], [])).count() == 0
    latin = save_shapefile(tmp_path / "latin", SHAPES[:1], ["\xc5"], cpg=b"UTF-8")
    assert [r.name for r in shapefile.read_shapefile(spark, latin).collect()] == ["\xc5"]
    (tmp_path / "latin" / "a.dbf").unlink()
    assert [r.name for r in shapefile.read_shapefile(spark, latin).collect()] == [None]
    whole = file_bytes(SHAPES, list("abcde"))
    bad = {"shp": whole["shp"][:200], "shx": b"x" * 140, "dbf": whole["dbf"][:150], "prj": b'PROJCS["UTM"]'}
    for suffix, content in bad.items():
        path = save_shapefile(tmp_path / suffix, SHAPES, list("abcde"), **{suffix: content})
        with pytest.raises(Exception, match="a.shx: "):
            shapefile.read_shapefile(spark, path).collect()
    with pytest.raises(Exception, match="no field POP, only scalerank, name"):
        shapefile.read_shapefile(spark, save_shapefile(tmp_path / "f", SHAPES, list("abcde")), "POP").collect()
