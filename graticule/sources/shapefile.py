"""Country boundaries from shapefiles.

The record index (.shx) has eight bytes for every record, so its size alone tells how many there are: the driver makes
ranges of records, and each task reads the index, the shapes and the names of its ranges by their places.
"""

from __future__ import annotations

import codecs
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graticule.operators.groups import cut_lineage
from graticule.shipping import ship
from graticule.sources.netcdf3 import open_path
from graticule.sources.slabs import list_files

RECORDS = 1024  # of a range
READ_BYTES = 4 << 20  # of neighbouring records that are read at once
HEADER, MAGIC = 100, 9994
POLYGONS = {5, 15, 25}  # plain, with heights, with measures: rings and points lie at the same places
SCHEMA = "name string, rings array<array<struct<lon:double,lat:double>>>"


class NotReadable(ValueError):
    pass


def exterior(rings: list[np.ndarray]) -> list[np.ndarray]:
    """The outer rings, which run clockwise here, turned as GeoJSON turns them. A ring alone is outer however it runs, and
    so are all rings of a shape without a clockwise one."""

    def area(ring: np.ndarray) -> float:
        x, y = (ring - ring[:1]).T
        return float(x[:-1] @ y[1:] - x[1:] @ y[:-1])

    areas = [area(r) for r in rings]
    outer = [(r, a) for r, a in zip(rings, areas) if a < 0] or list(zip(rings, areas))
    return [r[::-1] if a < 0 else r for r, a in outer]


def shape_rings(content: bytes) -> list[np.ndarray] | None:
    """Exterior rings of a record; None for a record that is not a polygon."""
    if len(content) < 4:
        raise NotReadable("record is cut off")
    if struct.unpack_from("<i", content)[0] not in POLYGONS:
        return None
    if len(content) < 44:
        raise NotReadable("record is cut off")
    parts, points = struct.unpack_from("<ii", content, 36)
    start = 44 + 4 * parts
    if parts < 0 or points < 0 or start + 16 * points > len(content):
        raise NotReadable("polygon is cut off")
    bounds = [*np.frombuffer(content, "<i4", parts, 44).tolist(), points]
    if any(a > b for a, b in zip([0, *bounds], bounds)):
        raise NotReadable("parts are out of order")
    place = np.frombuffer(content, "<f8", 2 * points, start).reshape(-1, 2)
    return exterior([place[a:b] for a, b in zip(bounds, bounds[1:]) if b > a])


def shapes(fs: pafs.FileSystem, stem: str, upper: bool, first: int, n: int) -> Iterator[list[np.ndarray] | None]:
    """Exterior rings of a range of records, neighbours read together."""
    with fs.open_input_file(stem + companion("shx", upper)) as file:
        if file.size() < HEADER or struct.unpack(">i", file.read(4))[0] != MAGIC:
            raise NotReadable("not a record index")
        index = np.frombuffer(file.read_at(8 * n, HEADER + 8 * first), ">i4").reshape(-1, 2).astype(np.int64) * 2
    starts, stops = index[:, 0] + 8, index[:, 0] + 8 + index[:, 1]
    with fs.open_input_file(stem + companion("shp", upper)) as file:
        at = 0
        while at < n:
            end = at + 1
            while end < n and starts[end] >= stops[end - 1] and stops[end] - starts[at] <= READ_BYTES:
                end += 1
            data = file.read_at(int(stops[end - 1] - starts[at]), int(starts[at]))
            for k in range(at, end):
                yield shape_rings(data[starts[k] - starts[at] : stops[k] - starts[at]])
            at = end


def encoding(fs: pafs.FileSystem, stem: str, upper: bool) -> str:
    """Of the names: what the code page file says, otherwise UTF-8."""
    path = stem + companion("cpg", upper)
    if not fs.get_file_info(path).is_file:
        return "utf-8"
    with fs.open_input_file(path) as file:
        said = file.read().decode("ascii", "replace").strip().lower().removeprefix("ansi ")
    try:
        return codecs.lookup(f"cp{said}" if said.isdigit() else said).name
    except LookupError:
        return "latin-1"


def names(fs: pafs.FileSystem, stem: str, upper: bool, field: str, first: int, n: int) -> list[str | None]:
    """One field of a range of rows of the attribute table; NULL where it is blank, or where there is no table."""
    path = stem + companion("dbf", upper)
    if not fs.get_file_info(path).is_file:
        return [None] * n
    code = encoding(fs, stem, upper)
    with fs.open_input_file(path) as file:
        rows, head, width = struct.unpack("<IHH", file.read(32)[4:12])
        if rows < first + n:
            raise NotReadable("fewer attributes than shapes")
        described = file.read_at(head - 32, 32)
        data = file.read_at(width * n, head + width * first)
    if len(data) < width * n:
        raise NotReadable("attributes are cut off")
    place, found = 1, {}  # behind the mark of deletion
    for at in range(0, len(described) - 31, 32):
        if described[at] == 0x0D:
            break
        title = described[at : at + 11].split(b"\0")[0].decode("ascii", "replace")
        found.setdefault(title.lower(), (place, place + described[at + 16]))
        place += described[at + 16]
    if field.lower() not in found:
        raise NotReadable(f"no field {field}, only {', '.join(found)}")
    low, high = found[field.lower()]
    cut = [data[width * k + low : width * k + high].split(b"\0")[0].decode(code, "replace").strip() for k in range(n)]
    return [c or None for c in cut]


def companion(kind: str, upper: bool) -> str:
    return f".{kind.upper() if upper else kind}"


def refuse_projected(fs: pafs.FileSystem, stem: str, upper: bool) -> None:
    path = stem + companion("prj", upper)
    if fs.get_file_info(path).is_file:
        with fs.open_input_file(path) as file:
            if file.read().lstrip()[:6].upper() in (b"PROJCS", b"PROJCR"):
                raise NotReadable("coordinates are projected; only geographic ones are read")


def to_batch(titles: list[str | None], found: list[list[np.ndarray] | None]) -> pa.RecordBatch:
    rings = [r for f in found for r in f or ()]
    points = np.concatenate([*rings, np.zeros((0, 2))])
    place = pa.StructArray.from_arrays([pa.array(points[:, k], pa.float64()) for k in range(2)], ["lon", "lat"])
    by_ring = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rings)]), pa.int32()), place)
    by_shape = np.cumsum([0, *(len(f or ()) for f in found)])
    missing = pa.array([f is None for f in found], pa.bool_())
    column = pa.ListArray.from_arrays(pa.array(by_shape, pa.int32()), by_ring, mask=missing)
    return pa.RecordBatch.from_arrays([pa.array(titles, pa.string()), column], ["name", "rings"])


def read_shapefile(spark: SparkSession, path: str, name: str = "NAME") -> DataFrame:
    """Boundaries of a shapefile, given by its .shp, or of all shapefiles below a folder: ``name`` and exterior rings.

    The record index must lie beside the shapes. ``name`` is a field of the attribute table, in any case. Records that are
    no polygons have NULL rings, blank names are NULL. Rings run as in GeoJSON, so that both formats give equal vertices.
    A damaged or projected file fails the job by name.
    """
    upper = path.endswith(".SHP")
    wanted = path[:-4] + companion("shx", upper) if path.lower().endswith(".shp") else path
    files = list_files(spark, wanted, (".shx", ".SHX"))
    count = F.floor((F.col("bytes") - HEADER) / 8)
    last = F.greatest(F.ceil(count / RECORDS) - 1, F.lit(0))
    part = F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("part")
    ranges = files.select("path", count.alias("count"), part)
    ranges = cut_lineage(ranges.select("path", (F.col("part") * RECORDS).alias("first"), F.least(F.lit(RECORDS), F.col("count") - F.col("part") * RECORDS).alias("n")))
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, first, n in zip(*(batch.column(c).to_pylist() for c in ("path", "first", "n"))):
                fs, where = open_path(file)
                stem, upper = where[:-4], where.endswith("SHX")
                try:
                    refuse_projected(fs, stem, upper)
                    if n < 0:
                        raise NotReadable("not a record index")
                    titles, found, held, done = names(fs, stem, upper, name, first, n), [], 0, 0
                    for rings in shapes(fs, stem, upper, first, n):
                        found.append(rings)
                        held += sum(map(len, rings or ())) * 16 + 64
                        if held > READ_BYTES:
                            yield to_batch(titles[done : done + len(found)], found)
                            found, held, done = [], 0, done + len(found)
                    if found:
                        yield to_batch(titles[done:], found)
                except (NotReadable, struct.error) as wrong:
                    raise ValueError(f"{file}: {wrong}") from wrong

    return ranges.repartition(max(1, min(10_000, ranges.count()))).mapInArrow(run, SCHEMA)
