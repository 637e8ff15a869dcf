"""What a path holds, by its first bytes: which reader takes it, or why none does."""

from __future__ import annotations

import os

#: Reader of each kind of vector data, and what its files begin with.
READERS = {"gpkg": (b"SQLite format 3\0",), "shp": (b"\x00\x00\x27\x0a",), "geojson": (b"{",)}
RASTER = {"tiff": (b"II*\0", b"MM\0*", b"II+\0", b"MM\0+"), "png": (b"\x89PNG",), "jpeg": (b"\xff\xd8\xff",), "jp2": (b"\x00\x00\x00\x0cjP  ",)}


def input_formats() -> list[str]:
    return sorted(READERS)


def resolve(path: str) -> str:
    """A folder that wraps one geodatabase folder stands for it; any other path for itself."""
    if os.path.isdir(path) and not path.rstrip("/").endswith(".gdb"):
        inner = sorted(x for x in os.listdir(path) if x.endswith(".gdb"))
        if len(inner) == 1:
            return os.path.join(path, inner[0])
    return path


def kind_of(path: str) -> tuple[str, str]:
    """``("vector", reader)``, ``("raster", format)`` or ``("none", reason)``; a folder counts as vector data.

    SQLite files may hold tiles as well, but are read as vector data.
    """
    path = resolve(path)
    if not os.path.exists(path):
        return "none", "no such path"
    if os.path.isdir(path):
        return ("none", "geodatabase folders need a native library") if path.endswith(".gdb") else ("vector", "gpkg")
    with open(path, "rb") as f:
        head = f.read(64)
    for name, starts in READERS.items():
        if head.lstrip(b"\xef\xbb\xbf \t\r\n").startswith(starts) or head.startswith(starts):
            return "vector", name
    for name, starts in RASTER.items():
        if head.startswith(starts):
            return "raster", name
    return "none", "no reader knows its first bytes"


def output_problem(path: str) -> str | None:
    """Why a folder cannot be written to; null if it can.  A file of a unique name is made and removed."""
    import tempfile

    parent = path if os.path.isdir(path) else os.path.dirname(os.path.abspath(path))
    if os.path.exists(path) and not os.path.isdir(path):
        return "a file stands there"
    if not os.path.isdir(parent):
        return "no such folder"
    try:
        with tempfile.NamedTemporaryFile(dir=parent):
            return None
    except OSError as e:
        return str(e)
