"""Raster files by their headers: size, bands, placement and system of each, without reading pixels.

A TIFF (also a big one) is walked by ranges: its first directory, and from there only the values
that are asked for, among them the keys that name the system.  PNG and JPEG files give their
size.  A task takes some files at a time; a file that cannot be read has an ``error``.
"""

from __future__ import annotations

import os
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .gpkg import find_files

#: Tags and keys of the public formats TIFF and GeoTIFF (fixed values).
WIDTH, HEIGHT, BITS, COMPRESSION, BANDS, TILE_WIDTH, FORMAT, SCALE, TIEPOINT, TRANSFORM, KEYS, NODATA = 256, 257, 258, 259, 277, 322, 339, 33550, 33922, 34264, 34735, 42113
GEOGRAPHIC_KEY, PROJECTED_KEY, USER_DEFINED = 2048, 3072, 32767
#: Bytes and letter of each type of value.
KINDS = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "s"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 13: (4, "I"), 16: (8, "Q"), 17: (8, "q"), 18: (8, "Q")}
SUFFIXES = (".tif", ".tiff", ".gtiff", ".png", ".jpg", ".jpeg")
SCHEMA = (
    "file string, format string, bytes long, width long, height long, bands int, bits int, tiled boolean, compression int, srs_id int, "
    "origin_x double, origin_y double, pixel_x double, pixel_y double, nodata string, error string"
)
#: Most values of a tag and entries of a directory that are read.
MOST = 4096


def tiff_tags(f, wanted: set[int]) -> dict[int, tuple]:
    """Values of the wanted tags in a TIFF's first directory; ``f`` is a file that can be sought."""
    head = f.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or len(head) < 8:
        raise ValueError("no TIFF")
    (magic,) = struct.unpack(order + "H", head[2:4])
    if magic not in (42, 43):
        raise ValueError("no TIFF")
    big = magic == 43
    at = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
    f.seek(at)
    count_size, entry, inline = (8, 20, 8) if big else (2, 12, 4)
    raw = f.read(count_size)
    if len(raw) < count_size:
        raise ValueError("its directory lies beyond its end")
    (n,) = struct.unpack(order + ("Q" if big else "H"), raw)
    if n > MOST:
        raise ValueError("its directory is too long")
    entries, out = f.read(n * entry), {}
    for i in range(len(entries) // entry):
        e = entries[i * entry : (i + 1) * entry]
        tag, kind = struct.unpack(order + "HH", e[:4])
        if tag not in wanted or kind not in KINDS:
            continue
        count = struct.unpack(order + ("Q" if big else "I"), e[4 : 4 + (8 if big else 4)])[0]
        size, letter = KINDS[kind]
        if count > MOST:
            count = MOST
        if size * count <= inline:
            data = e[-inline:][: size * count]
        else:
            f.seek(struct.unpack(order + ("Q" if big else "I"), e[-inline:])[0])
            data = f.read(size * count)
        if len(data) < size * count:
            raise ValueError(f"tag {tag} lies beyond its end")
        out[tag] = (data.split(b"\0")[0].decode("latin-1"),) if letter == "s" else struct.unpack(f"{order}{letter * count}", data)
    return out


def geo_code(keys: tuple | None) -> int | None:
    """The code of the system that a key directory names: the projected one before the geographic one."""
    found = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0} if keys and len(keys) >= 4 else {}
    return next((c for k in (PROJECTED_KEY, GEOGRAPHIC_KEY) if 0 < (c := found.get(k, 0)) < USER_DEFINED), None)


def raster_facts(path: str) -> dict:
    from ..functions.binary import image_head

    out = dict.fromkeys(x.split(" ")[0] for x in SCHEMA.split(", ")) | {"file": path}
    try:
        out["bytes"] = os.path.getsize(path)
        with open(path, "rb") as f:
            if f.read(2) not in (b"II", b"MM"):
                f.seek(0)
                kind, size = image_head(f.read(4096))
                if kind == "JPEG" and size is None:
                    f.seek(0)
                    kind, size = image_head(f.read(4 << 20))
                if kind not in ("PNG", "JPEG") or size is None:
                    raise ValueError("no header that is known")
                return out | {"format": kind, "width": size[0], "height": size[1], "tiled": False}
            f.seek(0)
            tags = tiff_tags(f, {WIDTH, HEIGHT, BITS, COMPRESSION, BANDS, TILE_WIDTH, SCALE, TIEPOINT, TRANSFORM, KEYS, NODATA})
    except (ValueError, OSError, struct.error) as e:
        return out | {"error": str(e)}
    first = lambda tag: tags[tag][0] if tags.get(tag) else None
    if first(WIDTH) is None or first(HEIGHT) is None:
        return out | {"format": "TIFF", "error": "no size"}
    out |= {"format": "TIFF", "width": first(WIDTH), "height": first(HEIGHT), "bands": first(BANDS) or 1, "bits": first(BITS) or 1, "tiled": TILE_WIDTH in tags, "compression": first(COMPRESSION), "srs_id": geo_code(tags.get(KEYS)), "nodata": first(NODATA)}
    if len(t := tags.get(TRANSFORM, ())) >= 8:
        out |= {"origin_x": t[3], "origin_y": t[7], "pixel_x": t[0], "pixel_y": abs(t[5])}
    elif len(scale := tags.get(SCALE, ())) >= 2 and len(tie := tags.get(TIEPOINT, ())) >= 6:
        out |= {"origin_x": tie[3] - tie[0] * scale[0], "origin_y": tie[4] + tie[1] * scale[1], "pixel_x": scale[0], "pixel_y": scale[1]}
    return out


def scan_rasters(spark: SparkSession, path: str, *, recursive: bool = False) -> DataFrame:
    """A row for each raster file of a path."""
    files = [f for s in SUFFIXES for f in find_files(path, recursive, s)] if os.path.isdir(path) else find_files(path)
    names = [x.split(" ")[0] for x in SCHEMA.split(", ")]

    def run(batches):
        kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
        types = [kinds[x.split(" ")[1]] for x in SCHEMA.split(", ")]
        for batch in batches:
            rows = [raster_facts(f) for f in batch.column("file").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names)

    rows = spark.createDataFrame([(f,) for f in sorted(set(files))], "file string")
    return rows.repartition(max(1, min(len(files) // 16, 10_000)), F.col("file")).mapInArrow(run, SCHEMA)
