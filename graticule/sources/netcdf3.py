"""NetCDF classic files as a Spark data source, ``spark.read.format("netcdf3")``.

The driver only lists files. A task gets a share of each file, reads its header and then just the bytes of its share,
and hands Arrow batches to Spark. Filters on ``variable``, ``dataset_id`` and ``time_idx`` reach the reader, so other
variables and other time steps are not read.

Options: ``path`` (a file or a folder), ``extraDims`` (comma-separated dimensions besides time, lat and lon; taken from
the first file if absent), ``slabBytes`` (file bytes per task), ``content`` ("cells", or "header" for one row per
variable).
"""

from __future__ import annotations

import posixpath
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import prod

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

from graticule.functions.calendar import decodable_range, parse_units
from graticule.operators.catalog import from_headers, levels_from_headers
from graticule.shipping import ship
from graticule.sources.tables import write_grid

SLAB_BYTES = 64 * 1024 * 1024
READ_CELLS = 2_097_152
READ_BYTES = 16 * 1024 * 1024  # of records held at once
BATCH_CELLS = 131_072
GAP_BYTES = 65_536
TIME_NAMES = ("time", "TIME")

# Tags and external types of the classic format, all big-endian.
TAG_DIMENSION, TAG_VARIABLE, TAG_ATTRIBUTE = 0x0A, 0x0B, 0x0C
EXTERNAL_TYPES = {
    1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8",
    7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8",
}
STREAMING = 0xFFFFFFFF

HEADER_SCHEMA = (
    "dataset_id string, variable string, variable_idx int, is_coordinate boolean, dims array<string>, "
    "sizes array<bigint>, units string, calendar string"
)


class NotClassicNetCDF(ValueError):
    """The file is not in a NetCDF classic format; HDF5-based files must be converted first."""


@dataclass
class Variable:
    name: str
    dims: list[str]
    shape: list[int]
    record: bool
    attributes: dict
    dtype: np.dtype
    begin: int
    index: int = -1

    @property
    def record_cells(self) -> int:
        return prod(self.shape[1:]) if self.record else prod(self.shape)

    @property
    def cells(self) -> int:
        return prod(self.shape)


@dataclass
class Header:
    dims: dict[str, int]
    variables: dict[str, Variable]
    record_bytes: int
    coordinates: set[str] = field(default_factory=set)

    def data_variables(self) -> list[Variable]:
        return [v for v in self.variables.values() if v.name not in self.coordinates]


class _Cursor:
    """Reads the header front to back, fetching more bytes of the file as it needs them."""

    def __init__(self, file, step: int = 65_536):
        self.file, self.step, self.data, self.at = file, step, b"", 0

    def take(self, n: int) -> bytes:
        while len(self.data) < self.at + n:
            more = self.file.read(max(self.step, self.at + n - len(self.data)))
            if not more:
                raise NotClassicNetCDF("the header is cut off")
            self.data += more
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, wide: bool = False) -> int:
        return struct.unpack(">Q", self.take(8))[0] if wide else struct.unpack(">I", self.take(4))[0]

    def padded(self, n: int) -> bytes:
        return self.take(n + -n % 4)[:n]


def read_header(file) -> Header:
    cursor = _Cursor(file)
    magic = cursor.take(4)
    if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
        raise NotClassicNetCDF(f"not a NetCDF classic file: it starts with {magic!r}")
    wide, wide_offset = magic[3] == 5, magic[3] in (2, 5)

    def count() -> int:
        return cursor.number(wide)

    def text() -> str:
        return cursor.padded(count()).decode("utf-8")

    def listed(tag: int) -> int:
        found, n = cursor.number(), count()
        if n and found != tag:
            raise NotClassicNetCDF(f"unexpected tag {found} in the header")
        return n

    def attributes() -> dict:
        found = {}
        for _ in range(listed(TAG_ATTRIBUTE)):
            name, kind, n = text(), cursor.number(), count()
            dtype = np.dtype(EXTERNAL_TYPES[kind])
            raw = cursor.padded(n * dtype.itemsize)
            found[name] = raw.decode("utf-8", "replace").rstrip("\x00") if kind == 2 else np.frombuffer(raw, dtype)
        return found

    records = count()
    dims = [(text(), count()) for _ in range(listed(TAG_DIMENSION))]
    attributes()
    variables = []
    for _ in range(listed(TAG_VARIABLE)):
        name = text()
        ids = [count() for _ in range(count())]
        own, kind, _size = attributes(), cursor.number(), count()
        begin = cursor.number(wide_offset)
        record = bool(ids) and dims[ids[0]][1] == 0
        variables.append(
            Variable(name, [dims[i][0] for i in ids], [dims[i][1] for i in ids], record, own,
                     np.dtype(EXTERNAL_TYPES[kind]), begin)
        )

    in_records = [v for v in variables if v.record]
    slots = [v.record_cells * v.dtype.itemsize for v in in_records]
    record_bytes = slots[0] if len(slots) == 1 else sum(s + -s % 4 for s in slots)
    if records == (2**64 - 1 if wide else STREAMING):
        start = min((v.begin for v in in_records), default=0)
        records = (file.size() - start) // record_bytes if record_bytes else 0
    sizes = {name: size or records for name, size in dims}
    for v in variables:
        v.shape = [sizes[d] for d in v.dims]
    # Dimension coordinates, and variables that others list as theirs, are not data.
    named = {n for v in variables for n in str(v.attributes.get("coordinates", "")).split()}
    coordinates = {v.name for v in variables if v.dims == [v.name]} | named
    header = Header(sizes, {v.name: v for v in variables}, record_bytes, coordinates)
    for i, v in enumerate(header.data_variables()):
        v.index = i
    return header


def read_cells(file, header: Header, variable: Variable, start: int, stop: int) -> np.ndarray:
    """Raw values of a row-major stretch of a variable, read by byte range."""
    size = variable.dtype.itemsize
    if not variable.record:
        file.seek(variable.begin + start * size)
        return np.frombuffer(file.read((stop - start) * size), variable.dtype)

    per = variable.record_cells
    first, last = start // per, -(-stop // per)
    slot, stride = per * size, header.record_bytes
    if slot * 4 >= stride or stride - slot <= GAP_BYTES:
        # Little lies between the records: one read is cheaper than many.
        file.seek(variable.begin + first * stride)
        data = file.read((last - first - 1) * stride + slot)
        rows = np.lib.stride_tricks.as_strided(
            np.frombuffer(data, np.uint8), (last - first, slot), (stride, 1)
        )
        cells = np.ascontiguousarray(rows).reshape(-1).view(variable.dtype)
    else:
        parts = []
        for record in range(first, last):
            file.seek(variable.begin + record * stride)
            parts.append(file.read(slot))
        cells = np.frombuffer(b"".join(parts), variable.dtype)
    return cells[start - first * per : stop - first * per]


class Held:
    """A file of which one stretch is in memory. Reads within it cost nothing, others go to the file."""

    def __init__(self, file):
        self.file, self.at, self.start, self.data = file, 0, 0, b""

    def hold(self, start: int, size: int) -> None:
        self.file.seek(start)
        self.start, self.data = start, self.file.read(size)

    def seek(self, place: int) -> None:
        self.at = place

    def read(self, size: int) -> bytes:
        offset = self.at - self.start
        if offset < 0 or offset + size > len(self.data):
            self.file.seek(self.at)
            return self.file.read(size)
        return self.data[offset : offset + size]


def unpack(raw: np.ndarray, attributes: dict) -> np.ndarray:
    """Doubles with NaN for missing cells, after scale and offset."""
    values = raw.astype(np.float64)
    for name in ("_FillValue", "missing_value"):
        for marker in np.atleast_1d(attributes.get(name, [])):
            values[raw == marker] = np.nan
    if "scale_factor" in attributes:
        values = values * float(np.atleast_1d(attributes["scale_factor"])[0])
    if "add_offset" in attributes:
        values = values + float(np.atleast_1d(attributes["add_offset"])[0])
    return values


def decode_axis(offsets: np.ndarray, units: str | None, calendar: str | None) -> np.ndarray:
    """Times of a numeric axis as datetime64[us]; NaT where they cannot be decoded."""
    times = np.full(len(offsets), np.datetime64("NaT"), "datetime64[us]")
    parsed, limits = parse_units(units, calendar), decodable_range(calendar)
    if parsed is None or limits is None:
        return times
    step, start = parsed
    rough = offsets * step + start
    good = (rough >= limits[0]) & (rough < limits[1])
    whole = np.floor(offsets[good])
    micros = whole.astype(np.int64) * step + np.round((offsets[good] - whole) * step).astype(np.int64) + start
    times[good] = micros.astype("datetime64[us]")
    return times


@dataclass
class Share(InputPartition):
    """Parts of files for one task: (path, dataset, part, parts)."""

    files: list[tuple[str, str, int, int]]


def open_path(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and root of a URI. A path without a scheme must be the same folder for every task."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return pafs.LocalFileSystem(), posixpath.abspath(path)


def list_files(path: str) -> list[tuple[str, str, int]]:
    """(path, dataset id, bytes) of a file or of all .nc files below a folder. The id is the relative path without suffix."""
    fs, root = open_path(path)
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.File:
        return [(info.path, posixpath.splitext(posixpath.basename(info.path))[0], info.size)]
    if info.type != pafs.FileType.Directory:
        raise FileNotFoundError(path)
    found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
    files = sorted((f for f in found if f.type == pafs.FileType.File and f.path.endswith(".nc")), key=lambda f: f.path)
    return [(f.path, posixpath.splitext(posixpath.relpath(f.path, root))[0], f.size) for f in files]


class NetCDF3Reader(DataSourceReader):
    def __init__(self, path: str, extra: list[str], slab_bytes: int, content: str):
        self.path, self.extra, self.slab_bytes, self.content = path, extra, slab_bytes, content
        self.variables: set[str] | None = None
        self.datasets: set[str] | None = None
        self.time_range = [0, 2**31 - 1]

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if not self._push(f):
                yield f

    def _push(self, f: Filter) -> bool:
        column = f.attribute[0] if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) else None
        if column in ("variable", "dataset_id") and isinstance(f, (EqualTo, In)):
            wanted = set(f.value) if isinstance(f, In) else {f.value}
            name = "variables" if column == "variable" else "datasets"
            known = getattr(self, name)
            setattr(self, name, wanted if known is None else known & wanted)
            return True
        if column == "time_idx" and self.content == "cells" and not isinstance(f, In):
            low, high = self.time_range
            if isinstance(f, EqualTo):
                low, high = max(low, f.value), min(high, f.value)
            elif isinstance(f, GreaterThanOrEqual):
                low = max(low, f.value)
            elif isinstance(f, GreaterThan):
                low = max(low, f.value + 1)
            elif isinstance(f, LessThanOrEqual):
                high = min(high, f.value)
            else:
                high = min(high, f.value - 1)
            self.time_range = [low, high]
            # Only a narrower read: Spark still checks the rows, so a variable without time is handled there.
        return False

    def partitions(self) -> list[InputPartition]:
        """Splits large files and packs small ones, by size alone: no header is read on the driver."""
        shares, pack, packed = [], [], 0
        for path, dataset, size in list_files(self.path):
            if self.datasets is not None and dataset not in self.datasets:
                continue
            parts = 1 if self.content == "header" else max(1, -(-size // self.slab_bytes))
            if parts > 1:
                shares += [Share([(path, dataset, part, parts)]) for part in range(parts)]
                continue
            pack.append((path, dataset, 0, 1))
            packed += 65_536 if self.content == "header" else size
            if packed >= self.slab_bytes:
                shares.append(Share(pack))
                pack, packed = [], 0
        return shares + ([Share(pack)] if pack else [])

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        fs, _ = open_path(self.path)
        for path, dataset, part, parts in partition.files:
            with fs.open_input_file(path) as file:
                header = read_header(file)
                if self.content == "header":
                    yield self._describe(dataset, header)
                else:
                    yield from self._cells(file, header, dataset, part, parts)

    def _wanted(self, name: str) -> bool:
        return self.variables is None or name in self.variables

    def _describe(self, dataset: str, header: Header) -> pa.RecordBatch:
        listed = [v for v in header.variables.values() if self._wanted(v.name)]
        return pa.record_batch(
            {
                "dataset_id": pa.array([dataset] * len(listed), pa.string()),
                "variable": pa.array([v.name for v in listed], pa.string()),
                "variable_idx": pa.array([v.index if v.index >= 0 else None for v in listed], pa.int32()),
                "is_coordinate": pa.array([v.name in header.coordinates for v in listed], pa.bool_()),
                "dims": pa.array([v.dims for v in listed], pa.list_(pa.string())),
                "sizes": pa.array([v.shape for v in listed], pa.list_(pa.int64())),
                "units": pa.array([v.attributes.get("units") for v in listed], pa.string()),
                "calendar": pa.array([v.attributes.get("calendar") for v in listed], pa.string()),
            }
        )

    def _cells(self, file, header: Header, dataset: str, part: int, parts: int) -> Iterator[pa.RecordBatch]:
        wanted = [v for v in header.data_variables() if v.dtype.kind != "S" and self._wanted(v.name)]
        if not wanted:
            return
        axes = {d: self._axis(file, header, d) for d in {d for v in wanted for d in v.dims} if d not in TIME_NAMES}
        for variable in wanted:
            strangers = [d for d in variable.dims if d not in (*TIME_NAMES, "lat", "lon", *self.extra)]
            if strangers:
                raise ValueError(f"{dataset}: {variable.name} has dimensions {strangers}; name them in extraDims")
        in_records = [v for v in wanted if v.record and v.dims[0] in TIME_NAMES]
        for variable in wanted:
            if variable not in in_records:
                time = next((d for d in variable.dims if d in TIME_NAMES), None)
                inner = max(prod(variable.shape[1:]), 1) if time is not None and variable.dims[0] == time else None
                start, stop = self._stretch(variable.cells, inner, part, parts)
                yield from self._values(file, header, dataset, variable, axes, start, stop)
        if in_records:
            yield from self._records(file, header, dataset, in_records, axes, part, parts)

    def _stretch(self, cells: int, inner: int | None, part: int, parts: int) -> tuple[int, int]:
        """One task's cells of a variable with ``inner`` cells a time step, within the wanted steps."""
        low, high = 0, cells
        if inner is not None:
            low, high = max(low, self.time_range[0] * inner), min(high, (self.time_range[1] + 1) * inner)
        count = max(high - low, 0)
        return low + count * part // parts, low + count * (part + 1) // parts

    def _records(
        self, file, header: Header, dataset: str, variables: list[Variable], axes: dict, part: int, parts: int
    ) -> Iterator[pa.RecordBatch]:
        """Cells of variables that lie interleaved in records. Where they fill a good part of the records, each stretch
        of records is read once for all of them and their times; else each variable reads its own byte ranges."""
        start, stop = self._stretch(header.dims[variables[0].dims[0]], 1, part, parts)
        stride, base = header.record_bytes, min(v.begin for v in header.variables.values() if v.record)
        filled = 4 * sum(v.record_cells * v.dtype.itemsize for v in variables) >= stride
        held, step = Held(file), max(1, READ_BYTES // stride)
        for first in range(start, stop, step):
            last = min(first + step, stop)
            if filled:
                held.hold(base + first * stride, (last - first) * stride)
            for v in variables:
                yield from self._values(held, header, dataset, v, axes, first * v.record_cells, last * v.record_cells)

    def _values(
        self, file, header: Header, dataset: str, variable: Variable, axes: dict, start: int, stop: int
    ) -> Iterator[pa.RecordBatch]:
        """Cells ``start`` to ``stop`` of a variable."""
        time = next((d for d in variable.dims if d in TIME_NAMES), None)
        leading = time is not None and variable.dims[0] == time
        inner = max(prod(variable.shape[1:]), 1)
        for at in range(start, stop, READ_CELLS):
            end = min(at + READ_CELLS, stop)
            values = unpack(read_cells(file, header, variable, at, end), variable.attributes)
            # Times of just these records: in a record file the time axis is scattered over the whole file.
            span = (at // inner, (end - 1) // inner + 1) if leading else (0, header.dims[time] if time else 0)
            times = self._axis(file, header, time, *span) if time else None
            for i in range(at, end, BATCH_CELLS):
                stretch = values[i - at : min(i + BATCH_CELLS, end) - at]
                yield self._batch(dataset, variable, axes, i, stretch, time, times, span[0])

    def _axis(self, file, header: Header, dim: str, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Coordinate values of a stretch of a dimension; its positions where the file has none."""
        axis, stop = header.variables.get(dim), header.dims[dim] if stop is None else stop
        if axis is None or axis.dims != [dim] or axis.dtype.kind == "S":
            positions = np.arange(start, stop, dtype=np.float64)
            return np.full(stop - start, np.datetime64("NaT"), "datetime64[us]") if dim in TIME_NAMES else positions
        values = unpack(read_cells(file, header, axis, start, stop), axis.attributes)
        if dim in TIME_NAMES:
            return decode_axis(values, axis.attributes.get("units"), axis.attributes.get("calendar"))
        return values

    def _batch(
        self, dataset: str, variable: Variable, axes: dict, start: int, values: np.ndarray,
        time: str | None, times: np.ndarray | None, first_time: int,
    ) -> pa.RecordBatch:
        """Cells ``start``, ``start + 1``, ... of a variable with their coordinates."""
        n = len(values)
        places = np.unravel_index(np.arange(start, start + n), variable.shape) if variable.dims else ()
        at = dict(zip(variable.dims, places, strict=True))

        def position(dim: str | None) -> pa.Array:
            return pa.array(at[dim].astype(np.int32)) if dim in at else pa.nulls(n, pa.int32())

        def coordinate(dim: str) -> pa.Array:
            return pa.array(axes[dim][at[dim]], from_pandas=True) if dim in at else pa.nulls(n, pa.float64())

        columns = {
            "dataset_id": pa.repeat(dataset, n),
            "variable": pa.repeat(variable.name, n),
            "variable_idx": pa.repeat(pa.scalar(variable.index, pa.int32()), n),
            "time_idx": position(time),
            "time": pa.array(times[at[time] - first_time]) if time else pa.nulls(n, pa.timestamp("us")),
            "lat_idx": position("lat"),
            "lat": coordinate("lat"),
            "lon_idx": position("lon"),
            "lon": coordinate("lon"),
        }
        for dim in self.extra:
            columns[f"{dim}_idx"], columns[dim] = position(dim), coordinate(dim)
        columns["value"] = pa.array(values, from_pandas=True)
        return pa.record_batch(columns)


class NetCDF3Source(DataSource):
    @classmethod
    def name(cls) -> str:
        return "netcdf3"

    def _path(self) -> str:
        if not self.options.get("path"):
            raise ValueError("netcdf3 needs a path")
        return self.options["path"]

    def _content(self) -> str:
        content = self.options.get("content", "cells")
        if content not in ("cells", "header"):
            raise ValueError(f"content must be cells or header, not {content!r}")
        return content

    def _extra(self) -> list[str]:
        named = self.options.get("extraDims")
        if named is not None:
            return [d.strip() for d in named.split(",") if d.strip()]
        files = list_files(self._path())
        if not files:
            return []
        fs, _ = open_path(self._path())
        with fs.open_input_file(files[0][0]) as file:
            header = read_header(file)
        dims = [d for v in header.data_variables() if v.dtype.kind != "S" for d in v.dims]
        return [d for d in dict.fromkeys(dims) if d not in (*TIME_NAMES, "lat", "lon")]

    def schema(self) -> str:
        if self._content() == "header":
            return HEADER_SCHEMA
        extra = "".join(f", `{d}_idx` int, `{d}` double" for d in self._extra())
        return (
            "dataset_id string, variable string, variable_idx int, time_idx int, time timestamp_ntz, "
            f"lat_idx int, lat double, lon_idx int, lon double{extra}, value double"
        )

    def reader(self, schema) -> NetCDF3Reader:
        known = {"dataset_id", "variable", "variable_idx", "time_idx", "time", "lat_idx", "lat", "lon_idx", "lon", "value"}
        extra = [n for n in schema.fieldNames() if n not in known and f"{n}_idx" in schema.fieldNames()]
        slab = int(self.options.get("slabBytes", SLAB_BYTES))
        return NetCDF3Reader(self._path(), extra, slab, self._content())


def read_netcdf3(spark: SparkSession, path: str, **options) -> DataFrame:
    """Registers the source, with filter pushdown on, and reads cells or headers.

    The package is sent along with the session's files, so executors need numpy and pyarrow only.
    """
    ship(spark)
    if "://" not in path:  # the cluster's own file system, not each machine's
        named = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        path = named.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(named).toString()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NetCDF3Source)
    return spark.read.format("netcdf3").options(**options).load(path)


def ingest_netcdf3(
    spark: SparkSession, source: str, target: str, mode: str = "errorifexists", files: int | None = None, **options
) -> None:
    """Converts files to a long Parquet table by dataset and variable, without a shuffle unless ``files`` asks for it
    (see ``write_grid``), and writes the catalog of their headers beside it."""
    write_grid(read_netcdf3(spark, source, **options), target, mode=mode, files=files)
    headers = read_netcdf3(spark, source, content="header")
    levels = levels_from_headers(headers)
    from_headers(headers).join(levels, ["dataset_id", "variable"], "left").write.mode(mode).parquet(catalog_path(target))


def catalog_path(target: str) -> str:
    """Where the catalog of a grid lies: in its folder, under a name that grid scans pass over."""
    return f"{target.rstrip('/')}/_catalog"


def read_catalog(spark: SparkSession, target: str, levels: bool = False) -> DataFrame:
    """The catalog that ingest stored: a row per dataset and variable, from which pages start without reading a cell. With
    ``levels`` also the names of further dimensions, which a page over a grid that has any needs for that."""
    found = spark.read.parquet(catalog_path(target))
    return found if levels else found.drop("levels")
