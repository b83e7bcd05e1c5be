"""Writes small shapefiles, for trying the reader. Spark tasks write one each."""

from __future__ import annotations

import json
import struct

import pandas as pd
from pyspark.sql import DataFrame

import checks
import graticule
from graticule.shipping import ship
from graticule.sources.netcdf3 import open_path

POLYGON, POINT, NOTHING = 5, 1, 0
WIDTH = 80  # bytes of a name


def shape_bytes(rings: list | None, point: list | None = None) -> bytes:
    """The content of a record: a polygon of these rings, a point, or nothing."""
    if rings is None:
        return struct.pack("<i", NOTHING) if point is None else struct.pack("<idd", POINT, *point)
    flat = [p for ring in rings for p in ring]
    starts = [sum(map(len, rings[:k])) for k in range(len(rings))]
    xs, ys = [x for x, _ in flat], [y for _, y in flat]
    box = struct.pack("<4d", min(xs), min(ys), max(xs), max(ys))
    return struct.pack("<i", POLYGON) + box + struct.pack(f"<ii{len(rings)}i", len(rings), len(flat), *starts) + b"".join(struct.pack("<dd", *p) for p in flat)


def file_bytes(shapes: list[bytes], names: list[str]) -> dict[str, bytes]:
    """The parts of a shapefile, by suffix."""

    def head(size: int) -> bytes:
        return struct.pack(">i20xi", 9994, size // 2) + struct.pack("<ii8d", 1000, POLYGON, *[0.0] * 8)

    at, index, body = 100, b"", b""
    for k, shape in enumerate(shapes):
        index += struct.pack(">ii", at // 2, len(shape) // 2)
        body += struct.pack(">ii", k + 1, len(shape) // 2) + shape
        at += 8 + len(shape)
    fields = b"".join(struct.pack("<11sc4xBB14x", title, b"C", width, 0) for title, width in ((b"SCALERANK", 4), (b"NAME", WIDTH)))
    table = struct.pack("<4BIHH20x", 3, 100, 1, 1, len(names), 32 + len(fields) + 1, 5 + WIDTH) + fields + b"\r"
    table += b"".join(b" " + b"1   " + n.encode()[:WIDTH].ljust(WIDTH) for n in names) + b"\x1a"
    return {"shp": head(at) + body, "shx": head(100 + len(index)) + index, "dbf": table, "cpg": b"UTF-8"}


def write_shapefiles(features: DataFrame, folder: str, group: str) -> None:
    """A shapefile for each value of ``group``, from rows (name, kind, coordinates). Outer rings run clockwise there."""

    def save(rows: pd.DataFrame) -> pd.DataFrame:
        shapes = []
        for kind, text in zip(rows["kind"], rows["coordinates"]):
            place = json.loads(text) if isinstance(text, str) else None
            polygons = {"Polygon": [place], "MultiPolygon": place}.get(kind)
            shapes.append(shape_bytes([ring[::-1] if k == 0 else ring for p in polygons for k, ring in enumerate(p)]) if polygons else shape_bytes(None, place))
        fs, root = open_path(folder)
        fs.create_dir(root, recursive=True)
        for suffix, content in file_bytes(shapes, list(rows["name"])).items():
            with fs.open_output_stream(f"{root}/part{rows[group].iloc[0]}.{suffix}") as file:
                file.write(content)
        return pd.DataFrame({"n": [len(rows)]})

    for package in (graticule, checks):
        ship(features.sparkSession, package)
    features.groupBy(group).applyInPandas(save, "n long").count()
