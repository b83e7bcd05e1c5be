"""Files of both kinds, written from their public layouts and read back through the index of slabs."""

import io
import os
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.hdf5_fixture import hdf5_bytes
from checks.netcdf_fixture import netcdf3_bytes
from graticule.functions import calendar
from graticule.operators import cube, series, story
from graticule.sources import hdf5, slabs

NT, NY, NX = 9, 3, 4
CUBE = np.arange(NT * NY * NX, dtype="f4").reshape(NT, NY, NX)
DIMS = {"time": NT, "lat": NY, "lon": NX}
CUBED = ["time", "lat", "lon"]


def variables(first_day=0.5, **more):
    return {
        "time": (["time"], np.arange(NT) + first_day, {"units": "days since 2000-01-01", "calendar": "standard"}),
        "lat": (["lat"], np.array([10.0, 0.0, -10.0]), {}),
        "lon": (["lon"], np.array([0.0, 90.0, 180.0, 270.0]), {}),
        "tas": (CUBED, CUBE, {"units": "K", **{f"note{i}": "x" * (40 * i) for i in range(12)}}),
        **more,
    }


def as_array(cells, value="value", shape=(NT, NY, NX)):
    rows = cells.collect()
    assert len(rows) == np.prod(shape)
    out = np.full(shape, np.nan)
    for r in rows:
        out[r.time_idx, r.lat_idx, r.lon_idx] = np.nan if r[value] is None else r[value]
    return out


def save(folder, name, data):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)
    return str(folder)


@pytest.mark.parametrize("style", ["old", "new", "dense", "latest"])
@pytest.mark.parametrize("filters", [(), ("shuffle", "deflate"), ("deflate", "fletcher")])
def test_hdf5_layouts(style, filters):
    """Every layout, with packed, big-endian, unwritten and unchunked data, and enough members for heaps and trees."""
    held = variables(
        pr=(CUBED, CUBE.astype(">i2"), {"_FillValue": np.int16(5), "scale_factor": 0.5, "add_offset": 1.0}),
        **{f"v{i}": (["time", "bnds"], np.full((NT, 2), float(i)), {}) for i in range(14)}, height=([], np.array(2.0), {}),
    )
    chunks = {"tas": (2, 2, 3), "pr": (1, NY, NX), "time": (4,)}
    data = hdf5_bytes({**DIMS, "bnds": 2}, held, style, chunks, filters, {"tas": {(2, 0, 0)}}, {"tas": 1e20})
    found = {}
    for s in slabs.file_slabs(io.BytesIO(data), "hdf5"):
        whole = found.setdefault(s["variable"], np.full(s["shape"], np.nan))
        part = slabs.unpacked(slabs.slab_values(io.BytesIO(data), s, 1, {}), s)
        whole[tuple(slice(o, o + n) for o, n in zip(s["offset"], s["extent"]))] = part
        assert s["dims"] == held[s["variable"]][0]
    expected = CUBE.astype("f8").copy()
    expected[2:4, 0:2, 0:3] = np.float32(1e20)
    assert np.array_equal(found["tas"], expected)
    packed = CUBE * 0.5 + 1
    packed[CUBE == 5] = np.nan
    assert np.array_equal(found["pr"], packed, equal_nan=True)
    assert all((found[f"v{i}"] == i).all() for i in range(14)) and found["height"] == 2.0 and "bnds" not in found
    notes = {v.name: v for v in hdf5.Container(io.BytesIO(data)).arrays()}["tas"].attributes
    assert all(notes[f"note{i}"] == "x" * (40 * i) for i in range(12)) and notes["units"] == "K"


def test_many_chunks_lie_under_a_tree_of_two_levels():
    data = hdf5_bytes(DIMS, variables(), "old", {"tas": (1, 1, 1)}, ("shuffle",))
    array = {v.name: v for v in hdf5.Container(io.BytesIO(data)).arrays()}["tas"]
    container = hdf5.Container(io.BytesIO(data))
    assert len({first for first, *_ in container.chunks(array)}) == CUBE.size
    assert container.cursor(array.layout["address"] + 5, 1).number(1) == 1


class Counting(io.BytesIO):
    count = 0

    def read(self, n=-1):
        data = super().read(n)
        self.count += len(data)
        return data


def test_only_the_bytes_of_chosen_chunks_are_read():
    big = np.random.default_rng(1).normal(size=(40, 30, 50)).astype("f4")
    held = {
        "time": (["time"], np.arange(40.0), {"units": "days since 2000-01-01"}), "lat": (["lat"], np.arange(30.0), {}),
        "lon": (["lon"], np.arange(50.0), {}), "a": (CUBED, big, {}), "b": (CUBED, big, {}),
    }
    data = hdf5_bytes({"time": 40, "lat": 30, "lon": 50}, held, "new", {"a": (8, 30, 50), "b": (8, 30, 50)}, ("shuffle", "deflate"))
    rows = [s for s in slabs.file_slabs(io.BytesIO(data), "hdf5") if s["variable"] == "a"]
    file = Counting(data)
    for s in rows:
        row = {"slabs": [s], "coords": [s["coords"]], "dataset_id": "x", "time_before": 0, "time_units": s["time_units"], "time_calendar": None}
        assert sum(b.num_rows for b in slabs.block_cells(file, row, [], None, {})) == np.prod(s["extent"])
    assert file.count == sum(s["stored"] for s in rows)
    walking = Counting(data)
    slabs.file_slabs(walking, "hdf5")
    assert walking.count < len(data) / 2


def test_both_kinds_in_one_folder(spark, tmp_path):
    save(tmp_path, "a/one.nc", netcdf3_bytes({"time": None, "lat": NY, "lon": NX}, variables()))
    extra = (["time", "lev", "lat", "lon"], np.stack([CUBE, CUBE + 500], axis=1), {})
    static = (["lat", "lon"], np.ones((NY, NX)), {})
    level = {"lev": (["lev"], np.array([850.0, 500.0]), {}), "ta": extra, "orog": static}
    folder = save(tmp_path, "b/deep/two.nc", hdf5_bytes({**DIMS, "lev": 2}, variables(**level), "dense", {"ta": (4, 1, 2, 3)}, ("deflate",)))
    save(tmp_path, "b/notes.txt", b"no grid")
    cells = slabs.read_netcdf(spark, folder)
    assert {tuple(r) for r in cells.select("dataset_id", "variable").distinct().collect()} == {
        ("a/one", "tas"), ("b/deep/two", "tas"), ("b/deep/two", "ta"), ("b/deep/two", "orog"),
    }
    for dataset in ("a/one", "b/deep/two"):
        assert np.array_equal(as_array(cells.where(f"dataset_id = '{dataset}' and variable = 'tas'")), CUBE)
    high = cells.where("variable = 'ta' and lev = 500")
    assert np.array_equal(as_array(high), CUBE + 500) and high.first().lev_idx == 1
    row = cells.where("variable = 'tas' and time_idx = 1 and lat_idx = 2 and lon_idx = 3").first()
    assert (row.time, row.lat, row.lon, row.lev) == (datetime(2000, 1, 2, 12), -10.0, 270.0, None)
    flat = cells.where("variable = 'orog'").collect()
    assert len(flat) == NY * NX and all(r.time is None and r.time_idx is None for r in flat)


def test_files_of_a_dataset_follow_their_times(spark, tmp_path):
    """Names in another order than times; a stretch of steps over a border; one slab of records for two variables."""
    for name, day in (("run_z", 0.0), ("run_a", 9.0), ("run_m", 18.0)):
        save(tmp_path, f"{name}.nc", netcdf3_bytes({"time": None, "lat": NY, "lon": NX}, variables(day, pr=(CUBED, CUBE + day, {}))))
    index = slabs.indexed(spark, str(tmp_path), F.lit("run"))
    cells = slabs.read_index(index)
    whole = np.concatenate([CUBE + day for day in (0, 9, 18)])
    assert np.array_equal(as_array(cells.where("variable = 'pr'"), shape=(3 * NT, NY, NX)), whole)
    steps = cells.groupBy("time_idx").agg(F.max("time").alias("time")).collect()
    assert all((r.time - datetime(2000, 1, 1)).days == r.time_idx for r in steps)
    part = slabs.read_index(index, ["pr"], steps=(7, 10))
    assert part.count() == 4 * NY * NX and {r[0] for r in part.select("time_idx").distinct().collect()} == {7, 8, 9, 10}
    listed = slabs.catalog_of_index(index).collect()
    assert {(r.variable, r.n_time, r.n_lat, r.n_lon, r.n_cells) for r in listed} == {
        (v, 3 * NT, NY, NX, 3 * NT * NY * NX) for v in ("tas", "pr")
    }


@pytest.mark.parametrize("kind", ["classic", "hdf5"])
def test_wide_rows_need_no_join(spark, tmp_path, kind):
    held = variables(uas=(CUBED, CUBE + 1, {}), vas=(CUBED, CUBE.astype("f8") + 2, {}))
    if kind == "classic":
        data = netcdf3_bytes({"time": None, "lat": NY, "lon": NX}, held)
    else:
        data = hdf5_bytes(DIMS, held, "old", {"uas": (2, NY, 2), "vas": (3, 2, NX)}, ("deflate",), {"vas": {(3, 0, 0)}}, {"vas": -1.0})
    cells = slabs.read_netcdf(spark, save(tmp_path, "w.nc", data), ["uas", "vas"], wide=True)
    assert np.array_equal(as_array(cells, "uas"), CUBE + 1)
    expected = CUBE + 2.0
    if kind == "hdf5":
        expected[3:6, 0:2] = -1
    assert np.array_equal(as_array(cells, "vas"), expected)
    plan = cells._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Join" not in plan
    assert plan.count("MapInArrow") == 1


def test_wide_rows_need_equal_dimensions(spark, tmp_path):
    held = variables(orog=(["lat", "lon"], np.ones((NY, NX)), {}))
    folder = save(tmp_path, "w.nc", hdf5_bytes(DIMS, held))
    with pytest.raises(ValueError, match="do not share"):
        slabs.read_netcdf(spark, folder, ["tas", "orog"], wide=True)


def test_a_manifest_walks_only_what_has_changed(spark, tmp_path):
    data, store = tmp_path / "data", str(tmp_path / "manifest")
    for name in ("a", "b", "c"):
        save(data, f"{name}.nc", hdf5_bytes(DIMS, variables()))
    assert slabs.refresh_manifest(spark, str(data), store) == 3
    assert slabs.refresh_manifest(spark, str(data), store) == 0
    save(data, "b.nc", hdf5_bytes(DIMS, variables(tas=(CUBED, CUBE * 2, {}))))
    os.utime(data / "b.nc", (10**9, 10**9))
    save(data, "d.nc", netcdf3_bytes({"time": None, "lat": NY, "lon": NX}, variables()))
    os.remove(data / "a.nc")
    assert slabs.refresh_manifest(spark, str(data), store) == 2
    index = slabs.named_index(slabs.read_manifest(spark, store), slabs.dataset_of(str(data)))
    cells = slabs.read_index(index, ["tas"])
    for name, factor in (("b", 2), ("c", 1), ("d", 1)):
        assert np.array_equal(as_array(cells.where(F.col("dataset_id") == name)), CUBE * factor)
    assert cells.count() == 3 * CUBE.size


def test_what_cannot_be_read_is_named(spark, tmp_path):
    for name, data in (("odd.nc", b"something else" * 300), ("cut.nc", hdf5_bytes(DIMS, variables())[:3000])):
        folder = save(tmp_path / name, name, data)
        with pytest.raises(Exception, match=name):
            slabs.read_netcdf(spark, folder).count()
    (tmp_path / "none").mkdir()
    assert slabs.read_netcdf(spark, str(tmp_path / "none")).count() == 0


# Model calendars


def days_one_by_one(model, year):
    """Every day from the first of January of a year, counted by hand."""
    lengths = [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
    while True:
        for month in range(1, 13):
            leap = model == "all_leap" or model == "julian" and year % 4 == 0
            for day in range(1, (30 if model == "360_day" else lengths[month - 1] + (leap and month == 2)) + 1):
                yield year, month, day
        year += 1


@pytest.mark.parametrize("name", ["noleap", "365_day", "all_leap", "366_day", "360_day", "julian", "NoLeap"])
def test_days_of_model_calendars(name):
    model = {"365_day": "noleap", "366_day": "all_leap"}.get(name, name.lower())
    for start in (0, 1, 1899, 2000):
        days = days_one_by_one(model, start)
        found = calendar.fields_of(range(3000), f"days since {start}-01-01", name)
        assert [f[:3] for f in found] == [next(days) for _ in found]
    back = calendar.fields_of([-1, -0.25, 0.5], "days since 2001-03-01 06:00", name)
    last = {"360_day": 30, "all_leap": 29}.get(model, 28)
    assert back == [(2001, 2, last, 6 * 3_600_000_000), (2001, 3, 1, 0), (2001, 3, 1, 18 * 3_600_000_000)]


def test_model_dates_that_cannot_be():
    assert calendar.fields_of([0], "days since 2001-02-29", "noleap") is None
    assert calendar.fields_of([0], "days since 2001-02-30", "360_day") == [(2001, 2, 30, 0)]
    assert calendar.fields_of([0], "days since 2001-02-30 12:00:00.5 +01:00", "360_day") == [(2001, 2, 30, 39_600_500_000)]
    assert calendar.fields_of([0], "days since 2001-01-01", "standard") is None
    assert calendar.fields_of([0], "months since 2001-01-01", "noleap") is None
    assert calendar.fields_of([float("nan"), 1e30, -1e6], "days since 2001-01-01", "noleap") == [None] * 3


def test_30_february_and_numbers_that_do_not_decode(spark, tmp_path):
    axis = lambda units, name: (["time"], np.arange(NT) + 55.5, {"units": units, "calendar": name})
    save(tmp_path, "model.nc", hdf5_bytes(DIMS, variables(time=axis("days since 2001-01-01", "360_day"))))
    folder = save(tmp_path, "odd.nc", hdf5_bytes(DIMS, variables(time=axis("fortnights of old", "standard"))))
    cells = slabs.read_netcdf(spark, folder)
    model = cells.where("dataset_id = 'model'")
    means = cube.spatial_mean(model)
    totals = {r.month: r.total for r in series.monthly_total(means).collect()}
    steps = CUBE.reshape(NT, -1).mean(axis=1)
    assert totals == {2: steps[:5].sum(), 3: steps[5:].sum()}
    labels = {r.time_idx: r.label for r in story.story_steps(model).collect()}
    assert labels[4 - 1] == "2001-02-29 12:00:00" and labels[NT - 1] == "2001-03-04 12:00:00"
    assert [r.label for r in story.story_steps(cells.where("dataset_id = 'odd'")).orderBy("step").collect()][0] == "55.5"


def test_extremes_in_a_model_calendar(spark, tmp_path):
    from graticule.operators import indices

    axis = (["time"], np.arange(NT) + 55.25, {"units": "days since 2001-01-01", "calendar": "360_day"})
    cells = slabs.read_netcdf(spark, save(tmp_path, "m.nc", hdf5_bytes(DIMS, variables(time=axis))))
    means = cube.spatial_mean(cells, by=["dataset_id"])
    for by in ([], ["dataset_id"]):
        row = indices.extremes(means, by=by).first()
        assert (row.hottest_label, row.coldest_label, row.hottest_date) == ("2001-03-04 06:00:00", "2001-02-26 06:00:00", None)
