"""Files written from the public layout of the classic format, read back through the data source."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.netcdf_fixture import netcdf3_bytes
from graticule.operators import catalog, cube
from graticule.sources import netcdf3
from graticule.sources.tables import read_grid

NT, NY, NX = 5, 3, 4
CUBE = np.arange(NT * NY * NX, dtype="f4").reshape(NT, NY, NX)
LAT, LON = np.array([10.0, 0.0, -10.0]), np.array([0.0, 90.0, 180.0, 270.0])
DAYS = np.arange(NT, dtype="f8") + 0.5


def variables(**more):
    return {
        "time": (["time"], DAYS, {"units": "days since 2000-01-01", "calendar": "gregorian"}),
        "lat": (["lat"], LAT, {}),
        "lon": (["lon"], LON, {}),
        "tas": (["time", "lat", "lon"], CUBE, {}),
        **more,
    }


@pytest.fixture
def write(tmp_path):
    def save(name, content, dims=None, version=2):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(netcdf3_bytes(dims or {"time": None, "lat": NY, "lon": NX}, content, version))
        return str(tmp_path)

    return save


def as_array(cells, variable="tas"):
    rows = cells.where(F.col("variable") == variable).collect()
    out = np.full((NT, NY, NX), np.nan)
    for r in rows:
        out[r.time_idx, r.lat_idx, r.lon_idx] = np.nan if r.value is None else r.value
    assert len(rows) == NT * NY * NX
    return out


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("records", [None, NT])
@pytest.mark.parametrize("slab", [64, 10**8])
def test_round_trip(spark, write, version, records, slab):
    folder = write("a.nc", variables(pr=(["time", "lat", "lon"], CUBE.astype("i2"), {})),
                   {"time": records, "lat": NY, "lon": NX}, version)
    cells = netcdf3.read_netcdf3(spark, folder, slabBytes=slab)
    assert np.array_equal(as_array(cells), CUBE)
    assert np.array_equal(as_array(cells, "pr"), CUBE)
    row = cells.where("variable = 'tas' and time_idx = 1 and lat_idx = 2 and lon_idx = 3").first()
    assert (row.time, row.lat, row.lon, row.dataset_id) == (datetime(2000, 1, 2, 12), -10.0, 270.0, "a")
    parts = cells.rdd.getNumPartitions()
    assert parts > 5 if slab == 64 else parts == 1


def test_reads_stay_within_the_share(write, tmp_path, monkeypatch):
    """Large records: a task reads its own records and their times, not the file."""
    monkeypatch.setattr(netcdf3, "GAP_BYTES", 0)
    monkeypatch.setattr(netcdf3, "READ_CELLS", NY * NX)
    wide = {f"v{i}": (["time", "lat", "lon"], CUBE + i, {}) for i in range(8)}
    write("a.nc", {**variables(), **wide})

    class Counting:
        def __init__(self, file):
            self.file, self.bytes = file, 0

        def __getattr__(self, name):
            return getattr(self.file, name)

        def read(self, n):
            data = self.file.read(n)
            self.bytes += len(data)
            return data

    reader = netcdf3.NetCDF3Reader(str(tmp_path), [], 10**8, "cells")
    reader.variables, reader.time_range = {"v3"}, [2, 3]
    with open(tmp_path / "a.nc", "rb") as raw:
        file = Counting(raw)
        file.size = lambda: (tmp_path / "a.nc").stat().st_size
        header = netcdf3.read_header(file)
        before = file.bytes
        batches = list(reader._cells(file, header, "a", 0, 1))
    found = [v for b in batches for v in b.column("value").to_pylist()]
    assert found == (CUBE[2:4] + 3).ravel().tolist()
    assert file.bytes - before == 2 * NY * NX * 4 + 2 * 8 + LAT.nbytes + LON.nbytes


class Counted:
    """A file that counts the bytes read from it."""

    def __init__(self, file):
        self.file, self.read_bytes = file, 0

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    def size(self):
        return self.file.size()

    def seek(self, place):
        return self.file.seek(place)

    def read(self, size):
        data = self.file.read(size)
        self.read_bytes += len(data)
        return data


@pytest.mark.parametrize("held", [10_000, 16 << 20])
def test_records_are_read_once_for_all_variables(write, tmp_path, monkeypatch, held):
    ny = nx = 30
    shape = (40, ny, nx)
    dims = {"time": None, "lat": ny, "lon": nx}
    axes = {"time": (["time"], np.arange(40.0), {"units": "days since 2000-01-01"}), "lat": (["lat"], np.arange(30.0), {}), "lon": (["lon"], np.arange(30.0), {})}
    cubes = {f"v{k}": (["time", "lat", "lon"], (np.arange(np.prod(shape)) + k).astype("f4").reshape(shape), {}) for k in range(12)}
    write("a.nc", axes | cubes, dims)
    monkeypatch.setattr(netcdf3, "READ_BYTES", held)
    size = (tmp_path / "a.nc").stat().st_size
    reader = netcdf3.NetCDF3Reader(str(tmp_path), [], 10**9, "cells")

    def scan(wanted):
        reader.variables = wanted
        with netcdf3.open_path(str(tmp_path))[0].open_input_file(str(tmp_path / "a.nc")) as plain:
            file = Counted(plain)
            header = netcdf3.read_header(file)
            batches = list(reader._cells(file, header, "a", 0, 1))
        return file.read_bytes, {(n, t, y, x): v for b in batches for n, t, y, x, v in zip(*(b.column(c).to_pylist() for c in ("variable", "time_idx", "lat_idx", "lon_idx", "value")))}

    read, cells = scan(None)
    assert read <= 1.1 * size
    assert len(cells) == 12 * np.prod(shape) and all(cells[f"v{k}", 7, 3, 9] == 7 * 900 + 99 + k for k in range(12))
    read, cells = scan({"v3"})
    assert len(cells) == np.prod(shape) and cells["v3", 39, 29, 29] == np.prod(shape) - 1 + 3


def test_levels_before_time(spark, write):
    swapped = np.arange(2 * NT * 3, dtype="f8").reshape(2, NT, 3)
    folder = write("l.nc", {
        "time": (["time"], DAYS, {"units": "days since 2000-01-01"}),
        "ta": (["lev", "time", "lat"], swapped, {}),
    }, {"lev": 2, "time": NT, "lat": 3})
    for slab in (40, 10**8):
        cells = netcdf3.read_netcdf3(spark, folder, slabBytes=slab).where("time_idx >= 1")
        rows = {(r.lev_idx, r.time_idx, r.lat_idx): (r.value, r.time.day) for r in cells.collect()}
        assert rows == {(z, t, y): (swapped[z, t, y], t + 1) for z in range(2) for t in range(1, NT) for y in range(3)}


def test_single_record_variable_is_not_padded(spark, write):
    shorts = np.arange(NT * 3, dtype="i2").reshape(NT, 3)
    folder = write("s.nc", {"pr": (["time", "x"], shorts, {})}, {"time": None, "x": 3})
    cells = netcdf3.read_netcdf3(spark, folder)
    assert [r.value for r in cells.orderBy("time_idx", "x_idx").collect()] == list(range(NT * 3))
    assert cells.where("time is not null").count() == 0


def test_missing_and_packed_values(spark, write):
    packed = np.array(CUBE, dtype="i2")
    packed[0, 0, 0] = -99
    floats = CUBE.copy()
    floats[1, 1, 1], floats[2, 2, 2] = np.nan, np.inf
    folder = write("p.nc", variables(
        pr=(["time", "lat", "lon"], packed, {"_FillValue": np.int16(-99), "scale_factor": 0.5, "add_offset": 10.0}),
        hurs=(["time", "lat", "lon"], floats, {"missing_value": np.float32(7)}),
    ))
    cells = netcdf3.read_netcdf3(spark, folder)
    expected = CUBE * 0.5 + 10.0
    expected[0, 0, 0] = np.nan
    assert np.array_equal(as_array(cells, "pr"), expected, equal_nan=True)
    floats[floats == 7] = np.nan
    assert np.array_equal(as_array(cells, "hurs"), floats, equal_nan=True)


def test_static_fields_levels_and_text(spark, write):
    folder = write("m.nc", {
        **variables(),
        "lev": (["lev"], np.array([1000.0, 500.0]), {}),
        "orog": (["lat", "lon"], CUBE[0], {}),
        "ta": (["lev", "lat", "lon"], CUBE[:2].astype("f8"), {}),
        "note": (["lat"], np.array([b"a", b"b", b"c"], dtype="S1"), {}),
        "total": ([], np.array(3.0), {}),
    }, {"time": None, "lat": NY, "lon": NX, "lev": 2})
    cells = netcdf3.read_netcdf3(spark, folder).persist()
    counts = {r.variable: r["count"] for r in cells.groupBy("variable").count().collect()}
    assert counts == {"tas": NT * NY * NX, "orog": NY * NX, "ta": 2 * NY * NX, "total": 1}
    assert cells.where("variable = 'ta' and lev_idx = 1").select("lev").distinct().first()[0] == 500.0
    listed = {r.variable: r for r in catalog.catalog(cells).collect()}
    assert (listed["orog"].n_time, listed["orog"].n_lat, listed["tas"].n_time) == (0, NY, NT)
    assert [r.variable for r in catalog.mappable(catalog.catalog(cells), with_time=True).collect()] == ["tas"]
    assert catalog.choose_variable(catalog.catalog(cells)).first().variable == "tas"
    cells.unpersist()
    with pytest.raises(Exception, match="extraDims"):
        netcdf3.read_netcdf3(spark, folder, extraDims="").count()


def test_undecodable_times_keep_their_positions(spark, write):
    content = variables()
    content["time"] = (["time"], DAYS, {"units": "days since 2000-01-01", "calendar": "noleap"})
    cells = netcdf3.read_netcdf3(spark, write("n.nc", content))
    assert cells.where("time is not null").count() == 0
    assert cells.agg(F.max("time_idx")).first()[0] == NT - 1


def test_upper_case_time(spark, write):
    content = {k: ([{"time": "TIME"}.get(d, d) for d in dims], a, att) for k, (dims, a, att) in variables().items()}
    content["TIME"] = content.pop("time")
    cells = netcdf3.read_netcdf3(spark, write("u.nc", content, {"TIME": None, "lat": NY, "lon": NX}))
    assert cells.where("time is not null").count() == NT * NY * NX


def test_filters_reach_the_reader(spark, write):
    folder = write("a.nc", variables(pr=(["time", "lat", "lon"], CUBE, {})))
    write("sub/b.nc", variables())
    cells = netcdf3.read_netcdf3(spark, folder)
    assert {r[0] for r in cells.select("dataset_id").distinct().collect()} == {"a", "sub/b"}
    picked = cells.where("variable = 'tas' and dataset_id = 'sub/b' and time_idx between 1 and 2")
    formatted = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = picked._jdf.queryExecution().explainString(formatted)
    assert "EqualTo(variable,tas)" in plan and "EqualTo(dataset_id,sub/b)" in plan
    assert picked.count() == 2 * NY * NX

    reader = netcdf3.NetCDF3Reader(folder, [], 10**8, "cells")
    low = netcdf3.GreaterThanOrEqual(("time_idx",), 3)
    assert list(reader.pushFilters([netcdf3.EqualTo(("variable",), "tas"), low])) == [low]
    rows = sum(b.num_rows for share in reader.partitions() for b in reader.read(share))
    assert rows == 2 * (NT - 3) * NY * NX


def test_header_only(spark, write):
    folder = write("a.nc", variables())
    found = {r.variable: r for r in netcdf3.read_netcdf3(spark, folder, content="header").collect()}
    assert (found["tas"].dims, found["tas"].sizes, found["tas"].is_coordinate) == (["time", "lat", "lon"], [NT, NY, NX], False)
    assert found["time"].is_coordinate and found["time"].units == "days since 2000-01-01"


def test_other_files_are_refused(spark, tmp_path):
    (tmp_path / "x.nc").write_bytes(b"\x89HDF\r\n\x1a\n" + b"\0" * 64)
    with pytest.raises(Exception, match="NotClassicNetCDF|not a NetCDF"):
        netcdf3.read_netcdf3(spark, str(tmp_path), extraDims="").count()


def test_ingest_to_parquet_keeps_cells_and_prunes(spark, write, tmp_path):
    folder = write("a.nc", variables(pr=(["time", "lat", "lon"], CUBE, {})))
    out = f"file://{tmp_path}/grid"
    netcdf3.ingest_netcdf3(spark, folder, out, slabBytes=200)
    stored = read_grid(spark, out)
    assert np.array_equal(as_array(stored), CUBE)
    means = {r.time_idx: r.value for r in cube.spatial_mean(stored.where("variable = 'tas'")).collect()}
    assert means == {t: CUBE[t].mean() for t in range(NT)}
    plan = stored.where("variable = 'tas' and time_idx = 2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(variable" in plan and "EqualTo(time_idx,2)" in plan
