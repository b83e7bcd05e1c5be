"""NetCDF files of either kind by an index of slabs, which is a table.

A slab is a block of one variable that lies together in a file: a chunk of a NetCDF-4 (HDF5) file, or a stretch of rows or
records of a classic one. Tasks list folders and walk the metadata of files into the index, which is stored in the shared
folder: a row for each slab with its bytes, how to decode them, and the coordinates of its cells. Everything else is plans
over that table: choosing variables and steps prunes slabs before a byte of data is read, one dataset may span many files,
the catalog needs no cell, and the tasks that read get ranges of slabs of about equal bytes.

Cells come long, one row for each cell of each variable, or wide, with variables of the same dimensions as columns.
"""

from __future__ import annotations

import posixpath
import re
import zlib
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import product
from math import ceil, lcm, prod

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graticule.functions.calendar import clock_text, days_in_model, fields_of
from graticule.operators.groups import cut_lineage
from graticule.shipping import ship
from graticule.sources import hdf5, netcdf3
from graticule.sources.netcdf3 import TIME_NAMES, decode_axis, open_path

SLAB_CELLS = 524_288  # of a stretch of a classic file or of unchunked data
TASK_BYTES = 64 << 20  # of stored data that a task reads
FILES_BYTES = 1 << 20  # of metadata, guessed, for which an indexing task is made
FILE_GUESS = 1 << 15
BATCH_CELLS = 131_072
SPACE = ("lat", "lon")
MAGIC = {b"CDF": "classic", b"\x89HD": "hdf5"}

INDEX = """path string, file_bytes bigint, modified bigint, variable string, variable_idx int, is_coordinate boolean, dims array<string>,
  shape array<bigint>, units string, calendar string, dtype string, missing array<double>, scale double, shift double,
  fill double, chunk array<bigint>, offset array<bigint>, extent array<bigint>, address bigint, stored bigint, stride bigint,
  skip bigint, data binary, filters array<int>, client array<int>, mask int, coords array<array<double>>, time_units string,
  time_calendar string"""
SLAB = "variable variable_idx dims dtype missing scale shift fill chunk offset extent address stored stride skip data filters client mask".split()


# Listing


def qualified(spark: SparkSession, path: str) -> str:
    """The path in the cluster's own file system, unless it names one."""
    if "://" in path or path.startswith("file:"):
        return path
    named = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return named.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(named).toString()


def list_files(spark: SparkSession, path: str, suffixes: Sequence[str] = (".nc", ".nc4", ".h5")) -> DataFrame:
    """``path``, ``bytes`` and ``modified`` of the files below a folder, or of one file. The driver knows the folder alone:
    each level of folders is listed by tasks and written, until a level holds no folder."""
    ship(spark)
    wanted = tuple(suffixes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                fs, root = open_path(folder)
                info = fs.get_file_info(root)
                if info.type == pafs.FileType.NotFound:
                    raise FileNotFoundError(folder)
                scheme = folder[: len(folder) - len(root)] if folder.endswith(root) else "file:" if folder.startswith("file:") else ""
                found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(root))
                kept = [f for f in found if not f.is_file or f.path.endswith(wanted) or f is info]
                times = [int(f.mtime.timestamp()) if f.mtime else None for f in kept]
                held = [[f"{scheme}{f.path}" for f in kept], [f.size if f.is_file else None for f in kept], times, [not f.is_file for f in kept]]
                yield pa.record_batch(dict(zip(("path", "bytes", "modified", "is_folder"), map(pa.array, held, (pa.string(), pa.int64(), pa.int64(), pa.bool_())))))

    schema = "path string, bytes bigint, modified bigint, is_folder boolean"
    level, files = spark.createDataFrame([(qualified(spark, path),)], "path string"), []
    while True:
        listed = cut_lineage(level.mapInArrow(run, schema))
        files.append(listed.where("not is_folder").drop("is_folder"))
        folders = listed.where("is_folder").select("path")
        n = folders.count()
        if not n:
            return reduce(DataFrame.unionAll, files)
        level = folders.repartition(min(n, 1000))


# Indexing


def first_number(value: object, default: float) -> float:
    return float(np.atleast_1d(value)[0]) if value is not None else default


def described(name: str, index: int, coordinate: bool, dims: list[str], shape: list[int], attributes: dict, dtype: np.dtype) -> dict:
    markers = [float(m) for k in ("_FillValue", "missing_value") for m in np.atleast_1d(attributes.get(k, [])) if not isinstance(m, str)]
    text = {k: attributes[k] if isinstance(attributes.get(k), str) else None for k in ("units", "calendar")}
    return {
        "variable": name, "variable_idx": index if index >= 0 else None, "is_coordinate": coordinate, "dims": dims, "shape": shape,
        **text, "dtype": dtype.str, "missing": markers, "scale": first_number(attributes.get("scale_factor"), 1.0),
        "shift": first_number(attributes.get("add_offset"), 0.0), "fill": float("nan"), "stride": 0, "skip": 0, "data": None,
        "filters": [], "client": [], "mask": 0,
    }


def stretches(shape: list[int], rows: int) -> Iterator[tuple[int, int]]:
    length = shape[0] if shape else 1
    yield from ((at, min(rows, length - at)) for at in range(0, length, rows))


def classic_slabs(file) -> Iterator[dict]:
    """Rows of arrays, and stretches of records. The variables of a record file share their records: their slabs name the
    same bytes, and where in them each one's begin."""
    header = netcdf3.read_header(file)
    recorded = [v for v in header.variables.values() if v.record]
    base = min((v.begin for v in recorded), default=0)
    widest = max((v.record_cells for v in recorded), default=1)
    for v in header.variables.values():
        if v.dtype.kind == "S":
            continue
        about = described(v.name, v.index, v.name in header.coordinates, v.dims, v.shape, v.attributes, v.dtype)
        inner = prod(v.shape[1:]) if v.dims else 1
        rows = max(1, SLAB_CELLS // max(widest if v.record else inner, 1))
        for at, n in stretches(v.shape, rows):
            held = {"chunk": [n, *v.shape[1:]] if v.dims else [], "offset": [at] + [0] * (len(v.dims) - 1) if v.dims else []}
            held["chunk"] = [rows, *v.shape[1:]] if v.dims else []
            held["extent"] = [n, *v.shape[1:]] if v.dims else []
            if v.record:
                where = {"address": base + at * header.record_bytes, "stored": n * header.record_bytes,
                         "stride": header.record_bytes, "skip": v.begin - base}
            else:
                where = {"address": v.begin + at * inner * v.dtype.itemsize, "stored": n * inner * v.dtype.itemsize}
            yield {**about, **held, **where}


def hdf5_slabs(file) -> Iterator[dict]:
    """Stored chunks, those that were never written, and stretches of data that is not in chunks."""
    container = hdf5.Container(file)
    arrays = container.arrays()
    named = {n for v in arrays for n in str(v.attributes.get("coordinates", "")).split()}
    coordinates = {v.name for v in arrays if v.dims == [v.name]} | named
    index = 0
    for v in arrays:
        if v.kind.dtype is None:
            continue
        at_index = -1
        if v.name not in coordinates:
            at_index, index = index, index + 1
        about = described(v.name, at_index, v.name in coordinates, v.dims, v.shape, v.attributes, v.kind.dtype)
        if len(v.fill) == v.kind.size:
            about["fill"] = float(np.frombuffer(v.fill, v.kind.dtype)[0])
        else:
            about["fill"] = 0.0
        layout, size = v.layout, v.kind.size
        if layout["form"] == "compact":
            yield {**about, "chunk": v.shape, "offset": [0] * len(v.shape), "extent": v.shape, "address": -1, "stored": 0, "data": layout["data"]}
        elif layout["form"] == "contiguous":
            inner = prod(v.shape[1:])
            rows = max(1, SLAB_CELLS // max(inner, 1))
            for at, n in stretches(v.shape, rows):
                where = -1 if layout["address"] is None else layout["address"] + container.base + at * inner * size
                yield {**about, "chunk": [rows, *v.shape[1:]] if v.shape else [], "offset": [at] + [0] * (len(v.shape) - 1) if v.shape else [],
                       "extent": [n, *v.shape[1:]] if v.shape else [], "address": where, "stored": n * inner * size if where >= 0 else 0}
        else:
            about |= {"filters": [n for n, _ in v.filters], "client": [c for _, c in v.filters], "chunk": layout["chunk"]}
            seen = set()
            for first, address, stored, mask in container.chunks(v):
                if any(f >= n for f, n in zip(first, v.shape)):
                    continue  # beyond the data: the array was made shorter
                seen.add(first)
                extent = [min(c, n - f) for f, c, n in zip(first, layout["chunk"], v.shape)]
                where = {"address": -1 if address is None else address + container.base, "stored": 0 if address is None else stored}
                yield {**about, "offset": list(first), "extent": extent, **where, "mask": mask}
            for first in product(*(range(0, n, c) for n, c in zip(v.shape, layout["chunk"]))):
                if first not in seen:
                    extent = [min(c, n - f) for f, c, n in zip(first, layout["chunk"], v.shape)]
                    yield {**about, "offset": list(first), "extent": extent, "address": -1, "stored": 0}


def file_slabs(file, kind: str) -> list[dict]:
    """Slabs of a file, each with the coordinates along its sides."""
    slabs = list(classic_slabs(file) if kind == "classic" else hdf5_slabs(file))
    about = {s["variable"]: s for s in slabs}
    axes: dict[str, np.ndarray] = {}
    for name in {d for s in slabs for d in s["dims"]}:
        pieces = [s for s in slabs if s["variable"] == name and s["dims"] == [name]]
        if pieces:
            axes[name] = np.full(pieces[0]["shape"][0], np.nan)
            for s in pieces:
                axes[name][s["offset"][0] : s["offset"][0] + s["extent"][0]] = unpacked(slab_values(file, s, 1, {}), s)
    for s in slabs:
        sides = zip(s["dims"], s["offset"], s["extent"])
        s["coords"] = [axes[d][a : a + n].tolist() if d in axes else [] for d, a, n in sides]
        time = next((d for d in s["dims"] if d in TIME_NAMES), None)
        told = about.get(time, {}) if time in axes else {}
        s["time_units"], s["time_calendar"] = told.get("units"), told.get("calendar")
    return slabs


def slab_index(spark: SparkSession, files: DataFrame) -> DataFrame:
    """The index of files that ``list_files`` found, stored: metadata is walked once, by tasks, and nothing else is read
    but the axes. A file that is neither kind fails the job by name."""
    ship(spark)
    schema = T._parse_datatype_string(INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        for batch in batches:
            for path, size, modified in zip(*(batch.column(c).to_pylist() for c in ("path", "bytes", "modified"))):
                fs, where = open_path(path)
                with fs.open_input_file(where) as file:
                    kind = MAGIC.get(file.read(3))
                    file.seek(0)
                    try:
                        rows = file_slabs(file, kind or "hdf5")
                    except (hdf5.NotReadable, netcdf3.NotClassicNetCDF) as wrong:
                        raise ValueError(f"{path}: {wrong}") from wrong
                for at in range(0, len(rows), 4096):
                    part = [{**r, "path": path, "file_bytes": size, "modified": modified} for r in rows[at : at + 4096]]
                    yield pa.RecordBatch.from_pylist(part, kinds)

    tasks = max(1, min(10_000, files.count() * FILE_GUESS // FILES_BYTES))
    return cut_lineage(files.repartition(tasks).select("path", "bytes", "modified").mapInArrow(run, schema))


def generations(spark: SparkSession, store: str) -> list[str]:
    """The complete generations of a manifest, oldest first."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(store)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    found = [f.getPath() for f in fs.listStatus(folder)]
    return sorted(p.toString() for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def refresh_manifest(spark: SparkSession, path: str, store: str) -> int:
    """Keeps the index of a folder in ``store`` and returns how many files were walked: those that are new, or whose size
    or time has changed. Slabs of files that are gone leave. Every refresh writes a new generation, which counts once it is
    complete, so that a reader of the last one is never disturbed; old ones may be deleted when nobody reads them."""
    known, listed = generations(spark, store), cut_lineage(list_files(spark, path))
    same = ["path", "file_bytes", "modified"]
    current = listed.withColumnRenamed("bytes", "file_bytes")
    if known:
        held = spark.read.parquet(known[-1])
        fresh = cut_lineage(current.join(held.select(*same).distinct(), same, "left_anti")).withColumnRenamed("file_bytes", "bytes")
        rows = held.join(current.select(*same), same, "left_semi").unionByName(slab_index(spark, fresh))
    else:
        fresh, rows = listed, slab_index(spark, listed)
    rows.write.parquet(f"{store.rstrip('/')}/{len(known):08d}")
    return fresh.count()


def read_manifest(spark: SparkSession, store: str) -> DataFrame:
    """The index of the last generation, for ``named_index``. No folder and no file of the data is looked at."""
    return spark.read.parquet(generations(spark, store)[-1])


def dataset_of(root: str) -> Column:
    """The path below the folder, without its suffix; of a single file its name."""
    path = F.regexp_replace("path", "^file:/*", "/")
    below = re.sub("^file:/*", "/", root).rstrip("/")
    inside = F.when(path.startswith(f"{below}/"), F.substring(path, len(below) + 2, 1 << 20)).otherwise(F.element_at(F.split(path, "/"), -1))
    return F.regexp_replace(inside, r"\.[^./]*$", "")


def indexed(spark: SparkSession, path: str, dataset: Column | None = None) -> DataFrame:
    """The index of a file or folder, as ``named_index`` gives it. Without ``dataset`` each file is one."""
    named = dataset if dataset is not None else dataset_of(qualified(spark, path))
    return named_index(slab_index(spark, list_files(spark, path)), named)


def named_index(index: DataFrame, dataset: Column) -> DataFrame:
    """An index with ``dataset_id`` and ``time_before``, the steps that precede a file in its dataset.

    ``dataset`` names the dataset of a ``path``. The files of a dataset follow each other by
    their first time, then by path; their steps are numbered on from file to file, by a running sum of one row a file.
    """
    ship(index.sparkSession)
    named = index.withColumn("dataset_id", dataset)
    axis = F.array_max(F.transform("dims", lambda d, i: F.when(d.isin(*TIME_NAMES), i)))
    steps = named.where(axis.isNotNull()).select(
        "dataset_id", "path", F.get("shape", axis).alias("steps"), F.get("offset", axis).alias("at"),
        F.struct("time_units", "time_calendar", F.get(F.get("coords", axis), F.lit(0)).alias("number")).alias("first"),
    )
    lengths = steps.groupBy("dataset_id", "path").agg(F.max("steps").alias("steps"), F.min_by("first", "at").alias("first"))

    def first_days(units, calendars, numbers):
        import pandas as pd

        found = [days_in_model(n, u, c) for n, u, c in zip(numbers, units, calendars)]
        return pd.Series(found, dtype="float64")

    day = F.pandas_udf(first_days, "double")("first.time_units", "first.time_calendar", "first.number")
    earlier = Window.partitionBy("dataset_id").orderBy(F.asc_nulls_last("day"), "path").rowsBetween(Window.unboundedPreceding, -1)
    before = lengths.withColumn("day", day).select("dataset_id", "path", F.coalesce(F.sum("steps").over(earlier), F.lit(0)).alias("time_before"))
    # One row a file on the right; the left has its slabs.
    return cut_lineage(named.join(before, ["dataset_id", "path"], "left").fillna(0, ["time_before"]))


# Reading


def slab_bytes(file, s: dict, wanted: int, held: dict) -> bytes | None:
    """The bytes of a slab, one row after the other. Records that ``wanted`` variables fill to a good part are read whole,
    and kept for the next variable."""
    if s["data"] is not None:
        return s["data"]
    if s["address"] < 0:
        return None
    if not s["stride"]:
        file.seek(s["address"])
        return file.read(s["stored"])
    rows, stride = s["extent"][0], s["stride"]
    size = prod(s["extent"][1:]) * np.dtype(s["dtype"]).itemsize
    if 4 * wanted * size < stride and stride - size > netcdf3.GAP_BYTES:
        parts = []
        for row in range(rows):
            file.seek(s["address"] + s["skip"] + row * stride)
            parts.append(file.read(size))
        return b"".join(parts)
    place = (s["address"], s["stored"])
    if held.get("place") != place:
        file.seek(s["address"])
        data = file.read(s["stored"])
        held["place"], held["records"] = place, data.ljust(s["stored"], b"\0")  # the last record may lack its padding
    block = np.frombuffer(held["records"], np.uint8).reshape(rows, stride)
    return block[:, s["skip"] : s["skip"] + size].tobytes()


def unfiltered(data: bytes, s: dict) -> bytes:
    """Undoes the filters of a chunk, last first, but for those that its mask says were skipped."""
    size = np.dtype(s["dtype"]).itemsize
    for n in reversed(range(len(s["filters"]))):
        if s["mask"] >> n & 1:
            continue
        if s["filters"][n] == hdf5.DEFLATE:
            data = zlib.decompress(data)
        elif s["filters"][n] == hdf5.FLETCHER:
            data = data[:-4]
        else:
            width = s["client"][n] or size
            whole = len(data) // width * width
            data = np.frombuffer(data[:whole], np.uint8).reshape(width, -1).T.tobytes() + data[whole:]
    return data


def slab_values(file, s: dict, wanted: int, held: dict) -> np.ndarray:
    """Raw values of a slab within the array."""
    dtype = np.dtype(s["dtype"])
    raw = slab_bytes(file, s, wanted, held)
    if raw is None:
        values = np.full(s["extent"], s["fill"])
        return values.astype(dtype) if np.isfinite(s["fill"]) else values
    shape = s["chunk"] if s["filters"] or (s["address"] >= 0 and prod(s["chunk"]) * dtype.itemsize == s["stored"]) else s["extent"]
    cells = np.frombuffer(unfiltered(raw, s), dtype, prod(shape)).reshape(shape)
    return cells[tuple(slice(n) for n in s["extent"])]


def unpacked(raw: np.ndarray, s: dict) -> np.ndarray:
    """Doubles with NaN for missing cells, after scale and offset."""
    values = raw.astype(np.float64)
    for marker in s["missing"]:
        values[raw == np.array(marker).astype(raw.dtype)] = np.nan
    if s["scale"] != 1.0:
        values = values * s["scale"]
    return values + s["shift"] if s["shift"] else values


def time_columns(numbers: np.ndarray, units: str | None, calendar: str | None) -> dict[str, pa.Array]:
    """``time`` of a stretch of the axis; ``time_fields`` (year, month, day and microseconds of the day) of a model
    calendar; and ``time_raw``, the clock of such a calendar or the number that could not be decoded."""
    times = decode_axis(numbers, units, calendar)
    unknown = np.isnat(times)
    fields = fields_of(numbers, units, calendar) if unknown.any() else None
    if fields is not None:
        named = [dict(zip(("year", "month", "day", "micros"), f)) if f else None for f in fields]
        raw = [clock_text(f) if f else None for f in fields]
    else:
        named = [None] * len(numbers)
        raw = [None if not lost or np.isnan(n) else f"{n:g}" if n != int(n) else str(int(n)) for lost, n in zip(unknown, numbers.tolist())]
    kind = pa.struct([("year", pa.int32()), ("month", pa.int32()), ("day", pa.int32()), ("micros", pa.int64())])
    return {"time": pa.array(times), "time_fields": pa.array(named, kind), "time_raw": pa.array(raw, pa.string())}


def block_cells(file, row: dict, extra: list[str], columns: list[str] | None, held: dict) -> Iterator[pa.RecordBatch]:
    """Cells of the slabs of a row, which lie in one block of the array: long for a single variable without ``columns``,
    else with a column for each variable."""
    slabs = row["slabs"]
    first = slabs[0]
    low = [min(s["offset"][k] for s in slabs) for k in range(len(first["dims"]))]
    high = [max(s["offset"][k] + s["extent"][k] for s in slabs) for k in range(len(first["dims"]))]
    shape = [h - a for a, h in zip(low, high)]
    values = {}
    names = sorted({s["variable"] for s in slabs})
    for s in slabs:
        part = unpacked(slab_values(file, s, len(names), held), s)
        if part.shape == tuple(shape):
            values[s["variable"]] = part
        else:
            whole = values.setdefault(s["variable"], np.full(shape, np.nan))
            whole[tuple(slice(o - a, o - a + n) for o, n, a in zip(s["offset"], s["extent"], low))] = part
    sides: list[np.ndarray] = [np.full(n, np.nan) for n in shape]
    for s, coords in zip(slabs, row["coords"]):
        for k, side in enumerate(coords):
            at = s["offset"][k] - low[k]
            sides[k][at : at + s["extent"][k]] = side if side else np.arange(s["offset"][k], s["offset"][k] + s["extent"][k])
    dims = first["dims"]
    time = next((d for d in dims if d in TIME_NAMES), None)
    empty = pa.struct([("year", pa.int32()), ("month", pa.int32()), ("day", pa.int32()), ("micros", pa.int64())])
    if time:
        k = dims.index(time)
        numbers = sides[k] if row["coords"][0][k] else np.full(shape[k], np.nan)
        clocks = time_columns(numbers, row["time_units"], row["time_calendar"])
    flat = {name: v.reshape(-1) for name, v in values.items()}
    count = prod(shape)
    for start in range(0, count, BATCH_CELLS):
        n = min(BATCH_CELLS, count - start)
        places = np.unravel_index(np.arange(start, start + n), shape) if dims else ()
        at = dict(zip(dims, places))
        out: dict[str, pa.Array] = {"dataset_id": pa.repeat(row["dataset_id"], n)}
        if columns is None:
            out |= {"variable": pa.repeat(first["variable"], n), "variable_idx": pa.repeat(pa.scalar(first["variable_idx"], pa.int32()), n)}
        if time:
            k, step = dims.index(time), pa.array(at[time])
            out["time_idx"] = pa.array((at[time] + (low[k] + row["time_before"])).astype(np.int32))
            out |= {c: clocks[c].take(step) for c in ("time", "time_fields", "time_raw")}
        else:
            out |= {"time_idx": pa.nulls(n, pa.int32()), "time": pa.nulls(n, pa.timestamp("us")), "time_fields": pa.nulls(n, empty), "time_raw": pa.nulls(n, pa.string())}
        for d in (*SPACE, *extra):
            known = d in at
            out[f"{d}_idx"] = pa.array((at[d] + low[dims.index(d)]).astype(np.int32)) if known else pa.nulls(n, pa.int32())
            out[d] = pa.array(sides[dims.index(d)][at[d]], from_pandas=True) if known else pa.nulls(n, pa.float64())
        for name in columns or [first["variable"]]:
            found = flat.get(name)
            cells = pa.nulls(n, pa.float64()) if found is None else pa.array(found[start : start + n], from_pandas=True)
            out[name if columns else "value"] = cells
        yield pa.record_batch(out)


def read_index(
    index: DataFrame, variables: Sequence[str] | None = None, datasets: Sequence[str] | None = None,
    steps: tuple[int, int] | None = None, wide: bool = False,
) -> DataFrame:
    """Cells of an index that ``indexed`` made: long, or with ``wide`` a row for each cell and a column for each of the
    ``variables``, which must share their dimensions.

    ``variables``, ``datasets`` and ``steps`` (first and last position on the time axis of a dataset) choose slabs before
    any data is read; cells of a chosen slab outside the steps leave behind it. Slabs go to tasks by ranges of file and
    place, so that a task reads on through a file. Wide rows need no join: the slabs of all variables in a block, which is
    a whole number of chunks of each, go to one task, and only rows of the index are shuffled for it. Variables that lack a
    block have NULL there.
    """
    spark = index.sparkSession
    ship(spark)
    rows = index.where(~F.col("is_coordinate"))
    if variables is not None:
        rows = rows.where(F.col("variable").isin(*variables))
    if datasets is not None:
        rows = rows.where(F.col("dataset_id").isin(*datasets))
    axis = F.array_max(F.transform("dims", lambda d, i: F.when(d.isin(*TIME_NAMES), i)))
    if steps is not None:
        first = F.get("offset", axis) + F.col("time_before")
        rows = rows.where(axis.isNull() | ((first <= steps[1]) & (first + F.get("extent", axis) > steps[0])))
    shared = ["dataset_id", "path", "time_before", "time_units", "time_calendar"]
    slab = F.struct(*SLAB)
    if wide:
        if not variables:
            raise ValueError("wide rows need the names of their variables")
        sizes = rows.groupBy("path", "dims").agg(F.collect_set("chunk").alias("chunks"), F.max("shape").alias("whole"))

        def common(chunks, wholes):
            import pandas as pd

            return pd.Series([[min(max(n, 1), lcm(*side)) for side, n in zip(zip(*c), w)] for c, w in zip(chunks, wholes)])

        sizes = sizes.select("path", "dims", F.pandas_udf(common, "array<bigint>")("chunks", "whole").alias("block"))
        block = F.transform("offset", lambda o, k: F.floor(o / F.get("block", k)))
        rows = rows.join(sizes, ["path", "dims"]).withColumn("block", block)
        rows = rows.groupBy(*shared, "dims", "block").agg(
            F.collect_list(slab).alias("slabs"), F.collect_list("coords").alias("coords"), F.sum("stored").alias("stored"), F.min("address").alias("address")
        )
        if rows.select("dims").distinct().limit(2).count() > 1:
            raise ValueError(f"{list(variables)} do not share their dimensions")
    else:
        rows = rows.select(*shared, F.array(slab).alias("slabs"), F.array("coords").alias("coords"), "stored", "address")
    rows = cut_lineage(rows)
    found = rows.agg(F.sum("stored")).first()[0] or 0
    # The names of dimensions, not their rows: bounded by what files declare.
    dims = [r[0] for r in rows.select(F.explode(F.flatten(F.col("slabs.dims")))).distinct().collect()]
    extra = sorted(d for d in dims if d not in (*TIME_NAMES, *SPACE))
    columns = list(variables) if wide else None
    names = "" if wide else "variable string, variable_idx int, "
    more = "".join(f", `{d}_idx` int, `{d}` double" for d in extra)
    values = ", ".join(f"`{v}` double" for v in columns) if wide else "value double"
    schema = (
        f"dataset_id string, {names}time_idx int, time timestamp_ntz, time_fields struct<year:int,month:int,day:int,micros:bigint>, "
        f"time_raw string, lat_idx int, lat double, lon_idx int, lon double{more}, {values}"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file, held = None, None, {}
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                if row["path"] != path:
                    if file is not None:
                        file.close()
                    path, held = row["path"], {}
                    fs, where = open_path(path)
                    file = fs.open_input_file(where)
                yield from block_cells(file, row, extra, columns, held)
        if file is not None:
            file.close()

    tasks = max(1, ceil(found / TASK_BYTES))
    dealt = rows.repartitionByRange(tasks, "path", "address").sortWithinPartitions("path", "address")
    cells = dealt.mapInArrow(run, schema)
    return cells.where(F.col("time_idx").isNull() | F.col("time_idx").between(*steps)) if steps is not None else cells


def read_netcdf(
    spark: SparkSession, path: str, variables: Sequence[str] | None = None, dataset: Column | None = None,
    steps: tuple[int, int] | None = None, wide: bool = False,
) -> DataFrame:
    """Cells of a NetCDF file of either kind, or of all below a folder. Runs the jobs that list and index them."""
    return read_index(indexed(spark, path, dataset), variables, None, steps, wide)


def catalog_of_index(index: DataFrame) -> DataFrame:
    """The catalog of an index: a row for each dataset and variable, with the lengths of its axes over all its files."""
    headers = index.groupBy("dataset_id", "path", "variable").agg(
        F.first("is_coordinate").alias("is_coordinate"), F.first("variable_idx").alias("variable_idx"), F.first("dims").alias("dims"), F.first("shape").alias("shape")
    )
    sizes = F.map_from_arrays("dims", "shape")

    def length(*named: str) -> Column:
        return F.coalesce(*[F.try_element_at(sizes, F.lit(n)) for n in named], F.lit(0))

    cells = F.aggregate("shape", F.lit(1).cast("bigint"), lambda n, size: n * size)
    return headers.where(~F.col("is_coordinate")).groupBy("dataset_id", "variable").agg(
        F.sum(length(*TIME_NAMES)).alias("n_time"), F.max(length("lat")).alias("n_lat"), F.max(length("lon")).alias("n_lon"),
        F.sum(cells).alias("n_cells"), F.min("variable_idx").alias("ordinal"),
    )
