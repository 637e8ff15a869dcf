"""Shapefiles as a Spark data source: ``spark.read.format("shp").load(path)``.

A partition is a file.  The columns are ``file``, ``geom`` (two-dimensional well-known
binary; null shapes are null) and the attributes of all files' tables: what a file lacks is
null, what files give different types is the wider number or text.  Z and M values are left
out.  Rings are told apart by direction: a clockwise ring is a polygon's shell, a
counter-clockwise one a hole of the smallest shell that it lies in, in whatever order they come.
"""

from __future__ import annotations

import os
import struct

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .gpkg import FilePart, find_files

KINDS = {"C": "string", "D": "string", "L": "boolean", "F": "double"}


def shape_files(path: str) -> list[str]:
    return [f for f in find_files(path, suffix=".shp") if f.lower().endswith(".shp")]


def system_of(path: str) -> int | None:
    """The code of a path's shapefiles, from their ``.prj`` files; None if they have none, ValueError if they differ."""
    from ..functions import wkt

    found = set()
    for f in shape_files(path):
        prj = os.path.splitext(f)[0] + ".prj"
        if os.path.exists(prj):
            with open(prj, encoding="utf-8", errors="replace") as p:
                found.add(wkt.identify(p.read()))
    if len(found) > 1:
        raise ValueError("shapefiles of several systems: " + ", ".join(sorted(map(str, found))))
    return found.pop() if found else None


def table_fields(path: str) -> list[tuple[str, str, int, int]]:
    """Name, type letter, width and decimals of each attribute."""
    with open(os.path.splitext(path)[0] + ".dbf", "rb") as f:
        head = f.read(32)
        (size,) = struct.unpack_from("<H", head, 8)
        raw = f.read(size - 32)
    out = []
    for i in range(0, len(raw) - 31, 32):
        if raw[i] == 0x0D:
            break
        name = raw[i : i + 11].split(b"\0")[0].decode("latin-1")
        out.append((name, chr(raw[i + 11]), raw[i + 16], raw[i + 17]))
    return out


def column_type(kind: str, width: int, decimals: int) -> str:
    return KINDS.get(kind, "double" if decimals else "long" if kind == "N" and width <= 18 else "double" if kind == "N" else "string")


def cell(raw: bytes, kind: str, type_: str):
    text = raw.decode("utf-8", "replace").strip(" \0")
    if kind == "L":
        return True if text in ("Y", "y", "T", "t") else False if text in ("N", "n", "F", "f") else None
    if type_ in ("long", "double"):
        try:
            return int(text) if type_ == "long" else float(text)
        except ValueError:
            return None
    if kind == "D":
        return f"{text[:4]}-{text[4:6]}-{text[6:8]}" if len(text) == 8 else None
    return text or None


def merged_fields(files: list[str]) -> dict[str, str]:
    """Name and type of the attributes of all files."""
    out: dict[str, str] = {}
    for f in files:
        for n, k, w, d in table_fields(f):
            new = column_type(k, w, d)
            old = out.setdefault(n, new)
            out[n] = old if old == new else "double" if {old, new} == {"long", "double"} else "string"
    return out


def attributes(path: str):
    """A table's rows as tuples, by its own fields."""
    fields = [(k, w, column_type(k, w, d)) for _, k, w, d in table_fields(path)]
    with open(os.path.splitext(path)[0] + ".dbf", "rb") as f:
        n, start, size = struct.unpack_from("<IHH", f.read(32), 4)
        f.seek(start)
        for _ in range(n):
            row, at, out = f.read(size), 1, []
            for kind, width, type_ in fields:
                out.append(cell(row[at : at + width], kind, type_))
                at += width
            yield tuple(out)


def _line(p: np.ndarray) -> bytes:
    return struct.pack("<I", len(p)) + np.ascontiguousarray(p, "<f8").tobytes()


def with_holes(rings: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Shells, each with its holes; a hole that lies in no shell is a polygon of its own."""
    areas = [(r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]).sum() for r in rings]
    shells = sorted((i for i, a in enumerate(areas) if a <= 0), key=lambda i: abs(areas[i]))
    out = {i: [rings[i]] for i, a in enumerate(areas) if a <= 0}
    low, high = (np.array([f(rings[i], axis=0) for i in shells]).reshape(-1, 2) for f in (np.min, np.max))
    for i, a in enumerate(areas):
        if a <= 0:
            continue
        r = rings[i]
        near = np.flatnonzero((low <= r.min(0)).all(1) & (high >= r.max(0)).all(1))
        home = next((shells[k] for k in near if lies_in(r, rings[shells[k]])), None)
        out.setdefault(i if home is None else home, []).append(r)
    return [out[i] for i in sorted(out)]


def lies_in(hole: np.ndarray, shell: np.ndarray) -> bool:
    """Whether most corners of a ring are inside another (rings that touch have some on it)."""
    (x, y), a, b = hole[:-1].T, shell[:-1], shell[1:]
    up = (a[:, 1] > y[:, None]) != (b[:, 1] > y[:, None])
    with np.errstate(divide="ignore", invalid="ignore"):
        at = a[:, 0] + (y[:, None] - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0])
    return 2 * int(((up & (at > x[:, None])).sum(1) % 2).sum()) > len(x)


def shape_wkb(data: bytes) -> bytes | None:
    """Well-known binary of one shape record."""
    (kind,) = struct.unpack_from("<i", data)
    base = kind % 10
    if kind == 0:
        return None
    if base == 1:
        return struct.pack("<BI", 1, 1) + data[4:20]
    if base == 8:
        (n,) = struct.unpack_from("<i", data, 36)
        points = np.frombuffer(data, "<f8", 2 * n, 40).reshape(n, 2)
        return struct.pack("<BII", 1, 4, n) + b"".join(struct.pack("<BI2d", 1, 1, *p) for p in points)
    if base not in (3, 5):
        raise ValueError(f"shape type {kind}")
    parts, n = struct.unpack_from("<ii", data, 36)
    starts = [*struct.unpack_from(f"<{parts}i", data, 44), n]
    points = np.frombuffer(data, "<f8", 2 * n, 44 + 4 * parts).reshape(n, 2)
    rings = [points[a:b] for a, b in zip(starts[:-1], starts[1:])]
    if base == 3:
        lines = [struct.pack("<BI", 1, 2) + _line(r) for r in rings]
        return lines[0] if len(lines) == 1 else struct.pack("<BII", 1, 5, len(lines)) + b"".join(lines)
    polygons = with_holes(rings)
    out = [struct.pack("<BII", 1, 3, len(p)) + b"".join(map(_line, p)) for p in polygons]
    return out[0] if len(out) == 1 else struct.pack("<BII", 1, 6, len(out)) + b"".join(out)


def shapes(path: str):
    with open(path, "rb") as f:
        if struct.unpack(">i", f.read(100)[:4])[0] != 9994:
            raise ValueError(f"{path} is no shapefile")
        while len(head := f.read(8)) == 8:
            yield shape_wkb(f.read(2 * struct.unpack(">ii", head)[1]))


class ShapefileReader(DataSourceReader):
    def __init__(self, path: str, columns: list[tuple[str, str]]):
        self.path, self.columns = path, columns

    def partitions(self) -> list[InputPartition]:
        return [FilePart(f) for f in shape_files(self.path)]

    def read(self, partition):
        own = [(n, column_type(k, w, d)) for n, k, w, d in table_fields(partition.path)]
        at = {n: i for i, (n, _) in enumerate(own)}
        change = {"double": float, "string": str}
        for geom, row in zip(shapes(partition.path), attributes(partition.path), strict=True):
            values = {"file": partition.path, "geom": geom}
            for n, type_ in self.columns:
                if n in at:
                    v = row[at[n]]
                    values[n] = v if v is None or own[at[n]][1] == type_ else change[type_](v)
            yield tuple(values.get(n) for n, _ in self.columns)


class ShapefileSource(DataSource):
    @classmethod
    def name(cls):
        return "shp"

    def schema(self):
        files = shape_files(self.options["path"])
        if not files:
            raise ValueError("no shapefile at " + self.options["path"])
        return ", ".join(["file string", "geom binary", *(f"`{n}` {t}" for n, t in merged_fields(files).items())])

    def reader(self, schema):
        names = {"bigint": "long"}
        return ShapefileReader(self.options["path"], [(f.name, names.get(t := f.dataType.simpleString(), t)) for f in schema.fields])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ShapefileSource)
