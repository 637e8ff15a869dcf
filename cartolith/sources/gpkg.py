"""GeoPackage files as a Spark data source: ``spark.read.format("gpkg")`` and ``df.write.format("gpkg")``.

Reading catalogs: ``path`` is a file, a folder or a pattern (comma-separated, or a JSON list of
paths taken literally; ``recursive`` descends), ``table`` a catalog table or one of
``__files__``, ``__schema__``, ``__pragma__``, ``__layers__`` (tables with system, geometry, extent,
fields and rows), ``__columns__`` (rows of each attribute and how many say nothing),
``__tiles__``, ``__heads__`` (format and size of each tile's image, without the image),
``__features__``, ``__index__`` (extent and number of entries of each layer's index).
``__all__`` has the rows of all tables that validation needs, tagged by ``source``, from one
opening of each file; what cannot be read of a file is a row of ``source`` ``errors`` there.

Reading layers: ``layer`` is the name of a feature layer or attribute table; its fields come with
their types, the geometry as well-known binary ``geom``.  ``columns`` (comma-separated) or a given
schema reads only these columns from the files; ``box`` (min x, min y, max x, max y) reads the
features whose extent meets it, by the layer's index where there is one; with ``push_filters``
(``read_layer`` sets it) comparisons with constants are made inside SQLite.

A partition is some files, or one of ``ranges`` rowid ranges of the user tables of a file (by
default one for each 128 MB), so blobs of a large file are read by several tasks.  Every
row carries ``file``.  Files that are not GeoPackages give a row in ``__files__`` with the
reason and nothing else; ``damage`` says what SQLite's own check found.  A table that cannot be
read stops the query with its name, and is passed over with ``permissive``; busy files are
waited for.  Small files are read together, up to ``files_per_task`` of them in one partition.
Columns that a file lacks are null; ``__schema__`` tells them from columns that hold nulls.
Text is decoded as UTF-8 with replacement.

Writing: SQLite has one writer a file, so each task writes complete GeoPackages of its rows below
``path`` and renames them into place when done; a retried task replaces its file, other jobs'
files stay in mode append.  With ``file_column`` (rows sorted by it in each partition, as
``write_files`` does) there is one file for each value, whatever the partitions.  A layer's index
is filled in packed order once its features are written.  What a job has written of each layer is
in ``_written-<job>.json`` beside its files.

Paths must be reachable from executors as files (a shared file system on a cluster).
"""

from __future__ import annotations

import glob
import json
import os
import sqlite3
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage,
)

from .. import dims

CATALOG = {
    "gpkg_contents": "table_name string, data_type string, identifier string, description string, last_change string, min_x double, min_y double, max_x double, max_y double, srs_id int",
    "gpkg_spatial_ref_sys": "srs_name string, srs_id int, organization string, organization_coordsys_id int, definition string, description string, definition_12_063 string, epoch double",
    "gpkg_geometry_columns": "table_name string, column_name string, geometry_type_name string, srs_id int, z int, m int",
    "gpkg_tile_matrix_set": "table_name string, srs_id int, min_x double, min_y double, max_x double, max_y double",
    "gpkg_tile_matrix": "table_name string, zoom_level int, matrix_width long, matrix_height long, tile_width int, tile_height int, pixel_x_size double, pixel_y_size double",
    "gpkg_extensions": "table_name string, column_name string, extension_name string, definition string, scope string",
    "gpkg_metadata": "id long, md_scope string, md_standard_uri string, mime_type string, metadata string",
    "gpkg_metadata_reference": "reference_scope string, table_name string, column_name string, row_id_value long, timestamp string, md_file_id long, md_parent_id long",
    "gpkg_2d_gridded_coverage_ancillary": "tile_matrix_set_name string, field_name string, quantity_definition string, grid_cell_encoding string, datatype string",
}
SPECIAL = {
    "__files__": "ok boolean, error string, bytes long, damage string",
    "__schema__": "table_name string, column_name string, type string, pk int",
    "__pragma__": "name string, value string",
    "__layers__": "table_name string, data_type string, identifier string, srs_id long, organization string, code long, geometry_column string, geometry_type string, n long, min_x double, min_y double, max_x double, max_y double, fields array<struct<name:string,type:string>>",
    "__columns__": "table_name string, column_name string, n long, n_empty long",
    "__tiles__": "table_name string, zoom_level int, tile_column long, tile_row long, tile_data binary",
    "__features__": "table_name string, fid long, geom binary",
    "__heads__": "table_name string, zoom_level int, format string, width int, height int",
    "__index__": "table_name string, n long, min_x double, min_y double, max_x double, max_y double",
    "__errors__": "table_name string, error string",
}
#: Tables of ``__all__``, those split by rowid ranges last.
SCANNED = ("__files__", "__schema__", "__pragma__", *CATALOG, "__index__", "__columns__", "__heads__", "__features__", "__errors__")
RANGED = ("__tiles__", "__heads__", "__features__", "__columns__")
#: Bytes of a file that one task reads of tables that can be split, and bytes of a tile that usually hold its size.
RANGE_BYTES, HEAD_BYTES = 128 << 20, 4096
#: Seconds to wait for a file that another program writes to, rows of a batch of ``__all__``, bytes of its blobs.
BUSY_SECONDS, BATCH_ROWS, BATCH_BYTES = 60, 4096, 16 << 20
PRAGMAS = ("application_id", "user_version", "page_size", "encoding", "journal_mode")


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def columns_of(table: str) -> list[tuple[str, str]]:
    """Name and type of each column of a table, beside ``file``."""
    return [(name, "bigint" if type_ == "long" else type_) for name, type_ in (c.split(" ") for c in {**CATALOG, **SPECIAL}[table].split(", "))]


def wide_columns() -> dict[str, str]:
    """Every column of the tables of ``__all__``; one name has one type."""
    out = {"file": "string", "source": "string"}
    for t in SCANNED:
        for name, type_ in columns_of(t):
            if out.setdefault(name, type_) != type_:
                out[name] = max(out[name], type_, key=["int", "bigint", "double", "string", "binary"].index)
    return out


def find_files(path: str, recursive: bool = False, suffix: str = ".gpkg") -> list[str]:
    """Files of a path; a folder means all files of the suffix in it (a repeated suffix is fine).

    A path that exists stands for itself, whatever characters its name has; a JSON list holds such
    paths; otherwise commas part patterns.
    """
    if path.startswith("["):
        try:
            given = json.loads(path)
        except ValueError:
            given = None
        if isinstance(given, list):
            return sorted({os.path.abspath(x) for p in given for x in find_files_in(p, recursive, suffix)})
    if os.path.exists(path):
        return sorted({os.path.abspath(x) for x in find_files_in(path, recursive, suffix)})
    return sorted({os.path.abspath(x) for p in path.split(",") for x in (find_files_in(p.strip(), recursive, suffix) if os.path.exists(p.strip()) else glob.glob(p.strip()))})


def find_files_in(path: str, recursive: bool, suffix: str) -> list[str]:
    if not os.path.isdir(path):
        return [path]
    if recursive:
        return [os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(suffix) and not f.startswith(".")]
    return [e.path for e in os.scandir(path) if e.name.endswith(suffix) and not e.name.startswith(".") and e.is_file()]


def open_readonly(path: str) -> sqlite3.Connection:
    """A connection to a file with the two tables that every GeoPackage has; ValueError otherwise."""
    with open(path, "rb") as f:
        if f.read(16) != b"SQLite format 3\0":
            raise ValueError("not an SQLite file")
    from urllib.parse import quote

    con = sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True, timeout=BUSY_SECONDS)
    con.text_factory = lambda b: b.decode("utf-8", "replace")
    try:
        names = {r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view')")}
    except sqlite3.DatabaseError:
        con.close()
        raise
    if lacking := {"gpkg_contents", "gpkg_spatial_ref_sys"} - names:
        con.close()
        raise ValueError("lacks " + ", ".join(sorted(lacking)))
    return con


def busy(e: Exception) -> bool:
    return "locked" in str(e) or "busy" in str(e)


class FilePart(InputPartition):
    def __init__(self, path: str, part: int = 0, parts: int = 1):
        self.path, self.part, self.parts = path, part, parts


class FileParts(InputPartition):
    def __init__(self, items: list[FilePart]):
        self.items = items


class Container:
    """One open file, or one range of it: an iterator of rows for each table, and what could not be read."""

    def __init__(self, con: sqlite3.Connection, part: FilePart):
        self.con, self.part, self.errors = con, part, []
        self.kinds = {r[0]: (r[1], r[2]) for r in con.execute("SELECT name, type, wr FROM pragma_table_list WHERE schema = 'main'") if r[0] not in ("sqlite_schema", "sqlite_master")}

    def rows(self, table: str) -> Iterator[tuple]:
        name = "_" + table.strip("_")
        if table in CATALOG:
            return self._catalog(table)
        return getattr(self, name)()

    def tried(self, table: str, rows: Iterator[tuple]) -> Iterator[tuple]:
        """The rows of a table up to where it cannot be read, which is kept in ``errors``; a busy file stays an error."""
        try:
            yield from rows
        except sqlite3.DatabaseError as e:
            if busy(e):
                raise
            self.errors.append((table, str(e)))

    def span(self, table: str) -> tuple[str, tuple] | None:
        """A condition for this part's rows of a table and its parameters; None if there are none.  What has no rowid is read by the first part."""
        kind, without = self.kinds[table]
        if kind == "view" or without:
            return None if self.part.part else ("1", ())
        low, high = self.con.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(table)}").fetchone()
        if low is None:
            return None
        step = -(-(high - low + 1) // self.part.parts)
        return "rowid >= ? AND rowid < ?", (low + step * self.part.part, low + step * (self.part.part + 1))

    def key(self, table: str) -> str:
        """The expression for a row's number."""
        kind, without = self.kinds[table]
        if kind != "view" and not without:
            return "rowid"
        whole = [r[1] for r in self.con.execute(f"PRAGMA table_info({quoted(table)})") if r[5] == 1 or r[1].lower() in ("fid", "ogc_fid", "id")]
        return f"CAST({quoted(whole[0])} AS INTEGER)" if whole else "NULL"

    def tables(self, *kinds: str) -> list[str]:
        said = self.con.execute("SELECT table_name, data_type FROM gpkg_contents ORDER BY table_name").fetchall()
        return [t for t, d in said if t in self.kinds and any(k in (d or "").lower() for k in kinds)]

    def geometry_columns(self) -> dict[str, str]:
        return dict(self.con.execute("SELECT table_name, column_name FROM gpkg_geometry_columns").fetchall()) if "gpkg_geometry_columns" in self.kinds else {}

    def fields(self, table: str) -> list[tuple[str, str, int]]:
        """Name, declared type and place in the key of each column."""
        return [(r[1], r[2], r[5]) for r in self.con.execute(f"PRAGMA table_info({quoted(table)})")]

    def _catalog(self, table):
        have = {name for name, _, _ in self.fields(table)}
        if not have:
            return
        cast = {"int": "INTEGER", "bigint": "INTEGER", "double": "REAL", "string": "TEXT"}
        picks = [f"CAST({quoted(n)} AS {cast[t]})" if n in have else "NULL" for n, t in columns_of(table)]
        yield from self.con.execute(f"SELECT {', '.join(picks)} FROM {quoted(table)}")

    def _files(self):
        try:
            said = self.con.execute("PRAGMA quick_check(1)").fetchone()[0]
        except sqlite3.DatabaseError as e:
            if busy(e):
                raise
            said = str(e)
        yield True, None, os.path.getsize(self.part.path), None if said == "ok" else said

    def _schema(self):
        for name in sorted(n for n, (kind, _) in self.kinds.items() if kind in ("table", "view", "virtual", "shadow")):
            for column, type_, pk in self.fields(name):
                yield name, column, type_, pk

    def _pragma(self):
        for p in PRAGMAS:
            yield p, str(self.con.execute(f"PRAGMA {p}").fetchone()[0])

    def _tiles(self):
        for t in self.tables("tiles", "gridded", "coverage"):
            yield from self.tried(t, self._tiles_of(t))

    def _tiles_of(self, t):
        if span := self.span(t):
            yield from ((t, *r) for r in self.con.execute(f"SELECT zoom_level, tile_column, tile_row, tile_data FROM {quoted(t)} WHERE {span[0]}", span[1]))

    def _heads(self):
        for t in self.tables("tiles", "gridded", "coverage"):
            yield from self.tried(t, self._heads_of(t))

    def _heads_of(self, t):
        from ..functions.binary import image_head

        if span := self.span(t):
            whole = self.kinds[t][0] == "view" or self.kinds[t][1]
            head = "tile_data" if whole else f"substr(tile_data, 1, {HEAD_BYTES})"
            for row, zoom, data in self.con.execute(f"SELECT {self.key(t)}, zoom_level, {head} FROM {quoted(t)} WHERE {span[0]} AND tile_data IS NOT NULL", span[1]):
                kind, size = image_head(data)
                if kind in ("JPEG", "TIFF") and size is None and not whole and len(data) == HEAD_BYTES:
                    kind, size = image_head(self.con.execute(f"SELECT tile_data FROM {quoted(t)} WHERE rowid = ?", (row,)).fetchone()[0])
                yield t, zoom, kind, *(size or (None, None))

    def _index(self):
        have = {n.lower(): n for n in self.kinds}
        for t, c in self.geometry_columns().items():
            if name := have.get(f"rtree_{t}_{c}".lower()):
                yield t, *self.con.execute(f"SELECT count(*), min(minx), min(miny), max(maxx), max(maxy) FROM {quoted(name)}").fetchone()

    def _features(self):
        columns = self.geometry_columns()
        for t in self.tables("features"):
            if t in columns:
                yield from self.tried(t, self._features_of(t, columns[t]))

    def _features_of(self, t, column):
        if span := self.span(t):
            yield from ((t, *r) for r in self.con.execute(f"SELECT {self.key(t)}, {quoted(column)} FROM {quoted(t)} WHERE {span[0]}", span[1]))

    def _columns(self):
        """One pass over each feature table; keys and geometries are left out."""
        geometries = self.geometry_columns()
        for t in self.tables("features"):
            names = [n for n, _, pk in self.fields(t) if pk != 1 and n.lower() != geometries.get(t, "").lower()]
            yield from self.tried(t, self._columns_of(t, names))

    def _columns_of(self, t, names):
        if names and (span := self.span(t)):
            said = ", ".join("'" + x.replace("'", "''") + "'" for x in dims.PLACEHOLDERS)
            empty = [f"count(*) FILTER (WHERE {quoted(n)} IS NULL OR lower(trim(CAST({quoted(n)} AS TEXT))) IN ({said}))" for n in names]
            n, *counts = self.con.execute(f"SELECT count(*), {', '.join(empty)} FROM {quoted(t)} WHERE {span[0]}", span[1]).fetchone()
            yield from ((t, name, n, k) for name, k in zip(names, counts))

    def _layers(self):
        geometry = {}
        if "gpkg_geometry_columns" in self.kinds:
            geometry = {r[0]: r[1:] for r in self.con.execute("SELECT table_name, column_name, geometry_type_name FROM gpkg_geometry_columns")}
        systems = {r[0]: r[1:] for r in self.con.execute("SELECT srs_id, organization, organization_coordsys_id FROM gpkg_spatial_ref_sys")}
        for t, kind, identifier, srs, *box in self.con.execute("SELECT table_name, data_type, identifier, srs_id, min_x, min_y, max_x, max_y FROM gpkg_contents ORDER BY table_name").fetchall():
            if t in self.kinds:
                n = self.con.execute(f"SELECT count(*) FROM {quoted(t)}").fetchone()[0]
                column, type_ = geometry.get(t, (None, None))
                yield t, kind, identifier, srs, *systems.get(srs, (None, None)), column, type_, n, *box, [{"name": a, "type": b} for a, b, _ in self.fields(t)]

    def _errors(self):
        """Every table is read to its end; only what fails is told."""
        for t in SCANNED[:-1]:
            for _ in self.tried(t, self.rows(t)):
                pass
        yield from self.errors


class GpkgReader(DataSourceReader):
    def __init__(self, options, table: str):
        self.path, self.table = options.get("path", ""), table
        self.together = int(options.get("files_per_task", "16"))
        self.recursive = flag(options, "recursive")
        self.permissive = flag(options, "permissive")
        self.ranges = int(options.get("ranges", "0")) if table in (*RANGED, "__all__") else 1

    def partitions(self):
        out, held = [], 0
        for f in find_files(self.path, self.recursive):
            size = os.path.getsize(f)
            n = self.ranges or -(-size // RANGE_BYTES) or 1
            if n > 1:
                out += [FileParts([FilePart(f, i, n)]) for i in range(n)]
                held = RANGE_BYTES
                continue
            if not out or held + size > RANGE_BYTES // 8 or len(out[-1].items) >= self.together:
                out.append(FileParts([]))
                held = 0
            out[-1].items.append(FilePart(f))
            held += size
        return out

    def read(self, partition):
        for item in partition.items:
            yield from self._file(item)

    def _file(self, part):
        try:
            con = open_readonly(part.path)
        except (ValueError, sqlite3.DatabaseError, OSError) as e:
            if busy(e):
                raise
            if self.table == "__files__":
                yield part.path, False, str(e), os.path.getsize(part.path), None
            return
        try:
            container = Container(con, part)
            for row in container.tried(self.table, container.rows(self.table)):
                yield (part.path, *row)
            if container.errors and self.table != "__errors__" and not self.permissive:
                raise ValueError(f"{part.path}: " + "; ".join(f"{t}: {e}" for t, e in container.errors) + " (permissive=true passes over it)")
        finally:
            con.close()


class ScanReader(GpkgReader):
    """``__all__``: a file is opened once; batches of one table's rows, null in the columns of the others."""

    def __init__(self, options):
        super().__init__(options, "__all__")
        self.wide = wide_columns()

    def _file(self, part):
        try:
            con = open_readonly(part.path)
        except (ValueError, sqlite3.DatabaseError, OSError) as e:
            if busy(e):
                raise
            if not part.part:
                yield self._batch(part.path, "__files__", [(False, str(e), os.path.getsize(part.path), None)])
            return
        try:
            container = Container(con, part)
            for table in SCANNED[:-1]:
                if table in RANGED or not part.part:
                    yield from self._batches(part.path, table, container.tried(table, container.rows(table)))
            if container.errors:
                yield self._batch(part.path, "__errors__", container.errors)
        finally:
            con.close()

    def _batches(self, path, table, rows):
        held, size = [], 0
        for r in rows:
            held.append(r)
            size += sum(len(x) for x in r if isinstance(x, bytes))
            if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield self._batch(path, table, held)
                held, size = [], 0
        if held:
            yield self._batch(path, table, held)

    def _batch(self, path, table, rows):
        kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
        own = {name: [r[i] for r in rows] for i, (name, _) in enumerate(columns_of(table))} | {"file": [path] * len(rows), "source": [table.strip("_")] * len(rows)}
        arrays = [pa.array(own[n], kinds[t]) if n in own else pa.nulls(len(rows), kinds[t]) for n, t in self.wide.items()]
        return pa.RecordBatch.from_arrays(arrays, list(self.wide))


def flag(options, name: str) -> bool:
    return str(options.get(name, "false")).lower() == "true"


#: Spark types of declared column types, by their first words.
TYPES = {
    "BOOLEAN": "boolean", "TINYINT": "int", "SMALLINT": "int", "MEDIUMINT": "int", "INT": "bigint", "INTEGER": "bigint", "FLOAT": "double", "DOUBLE": "double", "REAL": "double", "NUMERIC": "double",
    "TEXT": "string", "VARCHAR": "string", "CHAR": "string", "DATE": "date", "DATETIME": "timestamp", "TIMESTAMP": "timestamp", "BLOB": "binary", "JSON": "string",
}


def layer_fields(path: str, layer: str) -> list[tuple[str, str]] | None:
    """Name and Spark type of a layer's attributes, in one file; None if it is not there."""
    con = open_readonly(path)
    try:
        c = Container(con, FilePart(path))
        if layer not in c.kinds:
            return None
        geometry = c.geometry_columns().get(layer)
        return [(n, TYPES.get((t or "TEXT").upper().split("(")[0].split(" ")[0], "string")) for n, t, pk in c.fields(layer) if n != geometry and not (pk == 1 and (t or "").upper() == "INTEGER")]
    finally:
        con.close()


def as_type(value, type_: str):
    """A stored value as the column's type; ValueError if it is of another kind, as SQLite allows."""
    import datetime

    if value is None:
        return None
    if type_ == "string":
        return value if isinstance(value, str) else value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)
    if type_ == "binary":
        return value if isinstance(value, bytes) else str(value).encode()
    if type_ in ("int", "bigint") and isinstance(value, int) or type_ == "double" and isinstance(value, float):
        return value
    if type_ == "double" and isinstance(value, int):
        return float(value)
    if type_ in ("int", "bigint") and isinstance(value, float) and value.is_integer():
        return int(value)
    if type_ == "boolean" and value in (0, 1):
        return bool(value)
    if type_ == "date" and isinstance(value, str):
        return datetime.date.fromisoformat(value[:10])
    if type_ == "timestamp" and isinstance(value, str):
        at = datetime.datetime.fromisoformat(value)
        return at if at.tzinfo else at.replace(tzinfo=datetime.timezone.utc)
    raise ValueError(f"{value!r} is no {type_}")


class LayerReader(GpkgReader):
    """Rows of one layer: ``file``, ``fid``, ``geom`` and attributes, as far as the schema asks for them."""

    def __init__(self, options, schema: T.StructType):
        super().__init__(options, "__layer__")
        self.layer = options["layer"]
        self.ranges = int(options.get("ranges", "0"))
        self.schema = [(f.name, f.dataType.simpleString()) for f in schema.fields]
        self.box = [float(x) for x in options["box"].split(",")] if "box" in options else None
        self.conditions: list[tuple[str, list]] = []

    def _file(self, part):
        try:
            con = open_readonly(part.path)
        except (ValueError, sqlite3.DatabaseError, OSError) as e:
            if busy(e) or not self.permissive:
                raise ValueError(f"{part.path}: {e}") from e
            return
        try:
            c = Container(con, part)
            if self.layer in c.kinds:
                yield from self._rows(c, part)
        except sqlite3.DatabaseError as e:
            if busy(e) or not self.permissive:
                raise ValueError(f"{part.path}: {self.layer}: {e}") from e
        finally:
            con.close()

    def statement(self, c: Container) -> tuple[str, list] | None:
        """SQL for this part's rows: only the columns that are asked for, ranges, boxes and pushed filters as conditions."""
        if (span := c.span(self.layer)) is None:
            return None
        have, geometry = {n for n, _, _ in c.fields(self.layer)}, c.geometry_columns().get(self.layer)
        where, given, picks = [span[0]], list(span[1]), []
        for name, _ in self.schema:
            if name == "geom":
                picks.append(quoted(geometry) if geometry else "NULL")
            elif name != "file":
                picks.append(c.key(self.layer) if name == "fid" else quoted(name) if name in have else "NULL")
        if self.box:
            low_x, low_y, high_x, high_y = self.box
            index = {n.lower(): n for n in c.kinds}.get(f"rtree_{self.layer}_{geometry}".lower())
            if index and span[0] != "1":
                where.append(f"rowid IN (SELECT id FROM {quoted(index)} WHERE maxx >= ? AND minx <= ? AND maxy >= ? AND miny <= ?)")
                given += [low_x, high_x, low_y, high_y]
            if "geom" not in [n for n, _ in self.schema]:
                picks.append(quoted(geometry) if geometry else "NULL")
        for condition, values in self.conditions:
            names = condition.split("\0")
            if names[1] in have:
                where.append(names[0] + quoted(names[1]) + names[2])
                given += values
        return f"SELECT {', '.join(picks) or '1'} FROM {quoted(self.layer)} WHERE {' AND '.join(where)}", given

    def _rows(self, c, part):
        if (found := self.statement(c)) is None:
            return
        names = [n for n, _ in self.schema if n != "file"]
        kinds = dict(self.schema)
        for r in c.con.execute(*found):
            values = dict(zip(names, r))
            blob = values["geom"] if "geom" in values else r[-1] if self.box else None
            body = wkb_of(blob)
            if self.box and not _meets(body, self.box):
                continue
            if "geom" in values:
                values["geom"] = body
            out = []
            for n, type_ in self.schema:
                try:
                    out.append(part.path if n == "file" else values[n] if n in ("fid", "geom") else as_type(values[n], kinds[n]))
                except ValueError as e:
                    if not self.permissive:
                        raise ValueError(f"{part.path}: {self.layer}.{n}: {e}") from e
                    out.append(None)
            yield tuple(out)


class PushedLayerReader(LayerReader):
    """Comparisons with constants go into SQLite's statement; Spark repeats them on what comes back."""

    def pushFilters(self, filters):
        signs = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        kinds = dict(self.schema)
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            type_ = kinds.get(name)
            if name in ("file", "fid", "geom") or type_ not in ("string", "int", "bigint", "double"):
                continue
            fits = lambda v, t=type_: isinstance(v, str) if t == "string" else isinstance(v, (int, float)) and not isinstance(v, bool) and v == v
            tail = " COLLATE BINARY" if type_ == "string" else ""
            if type(f) in signs and fits(f.value):
                self.conditions.append((f"\0{name}\0{tail} {signs[type(f)]} ?", [f.value]))
            elif isinstance(f, In) and len(f.value) <= 500 and all(map(fits, f.value)):
                self.conditions.append((f"\0{name}\0{tail} IN ({', '.join('?' * len(f.value))})", list(f.value)))
            elif isinstance(f, StringStartsWith) and f.value and type_ == "string":
                self.conditions.append((f"substr(\0{name}\0, 1, {len(f.value)}) = ? COLLATE BINARY", [f.value]))
        return filters


def wkb_of(blob: bytes | None) -> bytes | None:
    """The well-known binary inside a geometry blob; null without the blob's header."""
    if not isinstance(blob, bytes) or len(blob) < 8 or blob[:2] != b"GP":
        return None
    size = (0, 32, 48, 48, 64)
    kind = blob[3] >> 1 & 7
    return blob[8 + size[kind] :] if kind < len(size) else None


def _meets(wkb: bytes | None, box) -> bool:
    e = None
    if wkb is not None:
        try:
            e = envelope(wkb)
        except (ValueError, IndexError, struct.error):
            e = None
    return e is not None and e[0] <= box[2] and e[2] >= box[0] and e[1] <= box[3] and e[3] >= box[1]


def envelope(wkb: bytes) -> tuple[float, float, float, float] | None:
    from ..functions.geometry import parse

    def points(g):
        kind, _, parts, _ = g
        if kind in (1, 2):
            return [parts]
        return parts if kind == 3 else [p for m in parts for p in points(m)]

    xy = [p[:, :2] for p in points(parse(wkb)) if len(p)]
    if not xy:
        return None
    low, high = min(p[:, 0].min() for p in xy), max(p[:, 0].max() for p in xy)
    return float(low), float(min(p[:, 1].min() for p in xy)), float(high), float(max(p[:, 1].max() for p in xy))


def gp_blob(wkb: bytes, srs_id: int, box) -> bytes:
    if box is None:
        return struct.pack("<2sBBi", b"GP", 0, 0x11, srs_id) + wkb
    return struct.pack("<2sBBi4d", b"GP", 0, 0x03, srs_id, box[0], box[2], box[1], box[3]) + wkb


class Done(WriterCommitMessage):
    """Files that a task has staged, by final name, with rows and geometries of each layer, and rows that could not be written."""

    def __init__(self, files: dict[str, str], counts: dict[str, list[int]], skipped: int):
        self.files, self.counts, self.skipped = files, counts, skipped


def curve_place(x: int, y: int, bits: int = 16) -> int:
    """Place of a cell along a Hilbert curve: cells near each other on it are near each other on the map."""
    place, side = 0, 1 << bits - 1
    while side:
        right, up = int(bool(x & side)), int(bool(y & side))
        place += side * side * (3 * right ^ up)
        if not up:
            if right:
                x, y = ~x, ~y
            x, y = y, x
        side >>= 1
    return place


class GpkgWriter(DataSourceWriter):
    """Options: ``srs_id``, ``wkt2``, ``last_change``, ``file_column`` and either ``layer``, ``geometry_type`` and ``metadata`` (XML), or

    ``layers``, a JSON list of ``name``, ``geometry_type`` and ``columns`` (name and type), for
    rows ``layer``, ``geom`` and ``attributes`` (a JSON object); and ``documents``, a JSON list
    of ``scope``, ``uri``, ``xml`` and, for a layer, ``table`` and ``parent`` (counted from 1).

    The column ``geom`` holds well-known binary (or null); other columns are attributes,
    binary ones are dropped, decimals are texts with all their digits.  Rows that cannot be
    written are counted; if there are any, the job fails at commit and nothing stays of it,
    unless ``skip_invalid`` is true.  Tasks write into a hidden folder of the job, whose files are
    renamed into place when all are done; it goes with the job, failed or not.
    """

    def __init__(self, options, schema, overwrite: bool):
        self.o, self.overwrite = dict(options), overwrite
        self.job = self.o.get("job") or uuid.uuid4().hex
        self.names = [f.name for f in schema.fields]
        self.file_column = self.o.get("file_column")
        own = [(f.name, f.dataType.typeName()) for f in schema.fields if f.name not in ("geom", "fid", self.file_column) and f.dataType.typeName() != "binary"]
        self.many = "layers" in self.o
        self.layers = json.loads(self.o["layers"]) if self.many else [{"name": self.o.get("layer", "layer"), "geometry_type": self.o.get("geometry_type", "GEOMETRY"), "columns": own}]
        self.documents = json.loads(self.o.get("documents", "[]"))
        if not self.documents and self.o.get("metadata"):
            one = {"scope": "dataset", "uri": self.o.get("metadata_uri", "http://www.isotc211.org/2005/gmd"), "xml": self.o["metadata"]}
            self.documents = [one | {"tables": [x["name"] for x in self.layers]}]
        self.staging = os.path.join(self.o["path"], f".staging-{self.job}")

    def write(self, rows):
        from itertools import groupby

        os.makedirs(self.staging, exist_ok=True)
        files, counts, skipped, part = {}, {x["name"]: [0, 0] for x in self.layers}, 0, TaskContext.get().partitionId()
        at = self.names.index(self.file_column) if self.file_column else None
        runs = groupby(rows, lambda r: r[at]) if self.file_column else [(None, rows)]
        for value, some in runs:
            name = f"part-{part:05d}-{self.job}.gpkg" if value is None and at is None else file_name(value)
            if name in files:
                raise ValueError(f"rows of {name} are not together: sort each partition by {self.file_column}")
            staged = os.path.join(self.staging, uuid.uuid4().hex)
            try:
                skipped += self._file(staged, some, counts)
            except BaseException:
                for x in (staged, staged + "-journal"):
                    if os.path.exists(x):
                        os.unlink(x)
                raise
            files[name] = staged
        return Done(files, counts, skipped)

    def _file(self, path: str, rows, counts: dict) -> int:
        con = sqlite3.connect(path)
        con.create_function("curve_place", 2, lambda x, y: curve_place(min(65535, max(0, x)), min(65535, max(0, y))), deterministic=True)
        try:
            self._catalog(con)
            skipped, boxes = self._rows(con, rows, counts)
            stamp, srs = self._stamp(), self._srs()
            for x in self.layers:
                self._index(con, x["name"], boxes.get(x["name"]))
                # An index has short floats, rounded outwards; the declared box is that of its entries, so that none reaches beyond it.
                box = con.execute(f"SELECT min(minx), min(miny), max(maxx), max(maxy) FROM {quoted('rtree_' + x['name'] + '_geom')}").fetchone()
                con.execute("INSERT INTO gpkg_contents VALUES (?, 'features', ?, '', ?, ?, ?, ?, ?, ?)", (x["name"], x["name"], stamp, *box, srs))
            con.commit()
            return skipped
        finally:
            con.close()

    def _index(self, con, layer: str, box) -> None:
        """Fill a layer's index along a curve over its extent, so that each node holds neighbours."""
        if box is None:
            return
        scale = 65535 / (max(box[2] - box[0], box[3] - box[1]) or 1.0)
        con.execute(
            f"""INSERT INTO {quoted('rtree_' + layer + '_geom')} SELECT fid, low_x, high_x, low_y, high_y FROM temp.boxes WHERE layer = ?
            ORDER BY curve_place(CAST(((low_x + high_x) / 2 - ?) * ? AS INTEGER), CAST(((low_y + high_y) / 2 - ?) * ? AS INTEGER)), fid""",
            (layer, box[0], scale, box[1], scale),
        )

    def _srs(self) -> int:
        return int(self.o.get("srs_id", "4326"))

    def _stamp(self) -> str:
        return self.o.get("last_change", "2025-01-01T00:00:00Z")

    def _catalog(self, con) -> None:
        srs, stamp, wkt2 = self._srs(), self._stamp(), self.o.get("wkt2", "undefined")
        con.execute("PRAGMA application_id = 0x47504B47")
        con.execute("PRAGMA user_version = 10400")
        con.executescript(DDL)
        con.execute("INSERT INTO gpkg_spatial_ref_sys VALUES ('Undefined cartesian', -1, 'NONE', -1, 'undefined', NULL, 'undefined'), ('Undefined geographic', 0, 'NONE', 0, 'undefined', NULL, 'undefined')")
        con.execute("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, 'EPSG', ?, ?, ?, ?)", (f"EPSG:{srs}", srs, srs, wkt2, f"EPSG:{srs}", wkt2))
        extensions = [("gpkg_spatial_ref_sys", "definition_12_063", "gpkg_crs_wkt"), ("gpkg_metadata", None, "gpkg_metadata"), ("gpkg_metadata_reference", None, "gpkg_metadata")]
        for x in self.layers:
            kinds = {"long": "INTEGER", "integer": "INTEGER", "short": "INTEGER", "byte": "INTEGER", "boolean": "BOOLEAN", "double": "DOUBLE", "float": "DOUBLE"}
            columns = "".join(f", {quoted(n)} {kinds.get(t, 'TEXT')}" for n, t in x["columns"])
            con.execute(f"CREATE TABLE {quoted(x['name'])} (fid INTEGER PRIMARY KEY AUTOINCREMENT, geom BLOB{columns})")
            con.execute(f"CREATE VIRTUAL TABLE {quoted('rtree_' + x['name'] + '_geom')} USING rtree(id, minx, maxx, miny, maxy)")
            con.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', ?, ?, 0, 0)", (x["name"], x["geometry_type"], srs))
            extensions.append((x["name"], "geom", "gpkg_rtree_index"))
        con.executemany("INSERT INTO gpkg_extensions VALUES (?, ?, ?, 'http://www.geopackage.org/spec', ?)", [(*e, "write-only" if e[2] == "gpkg_rtree_index" else "read-write") for e in extensions])
        for i, d in enumerate(self.documents, 1):
            con.execute("INSERT INTO gpkg_metadata VALUES (?, ?, ?, 'text/xml', ?)", (i, d["scope"], d["uri"], d["xml"]))
            tables = [d["table"]] if "table" in d else [None, *d.get("tables", [])]
            con.executemany("INSERT INTO gpkg_metadata_reference VALUES (?, ?, NULL, NULL, ?, ?, ?)", [("table" if t else "geopackage", t, stamp, i, d.get("parent")) for t in tables])

    def _rows(self, con, rows, counts: dict) -> tuple[int, dict]:
        at, srs, skipped, boxes = {x: i for i, x in enumerate(self.names)}, self._srs(), 0, {}
        inserts = {x["name"]: (f"INSERT INTO {quoted(x['name'])} VALUES (NULL, ?{', ?' * len(x['columns'])})", x["columns"]) for x in self.layers}
        con.execute("CREATE TEMP TABLE boxes (layer TEXT, fid INTEGER, low_x REAL, high_x REAL, low_y REAL, high_y REAL)")
        for r in rows:
            name = r[at["layer"]] if self.many else self.layers[0]["name"]
            insert, columns = inserts[name]
            try:
                wkb = r[at["geom"]]
                e = envelope(bytes(wkb)) if wkb is not None else None
                given = json.loads(r[at["attributes"]], parse_float=str) if self.many else None
                values = [stored(given.get(c) if self.many else r[at[c]], t) for c, t in columns]
                fid = con.execute(insert, (None if wkb is None else gp_blob(bytes(wkb), srs, e), *values)).lastrowid
            except (struct.error, ValueError, IndexError, OverflowError, sqlite3.Error):
                skipped += 1
                continue
            counts[name][0] += 1
            counts[name][1] += wkb is not None
            if e:
                con.execute("INSERT INTO temp.boxes VALUES (?, ?, ?, ?, ?, ?)", (name, fid, e[0], e[2], e[1], e[3]))
                box = boxes.get(name, e)
                boxes[name] = (min(box[0], e[0]), min(box[1], e[1]), max(box[2], e[2]), max(box[3], e[3]))
        return skipped, boxes

    def commit(self, messages):
        import shutil

        done = [m for m in messages if m is not None]
        skipped, staged = sum(m.skipped for m in done), [(name, path) for m in done for name, path in m.files.items()]
        names = [name for name, _ in staged]
        said = f"{skipped} rows cannot be written" if skipped and not flag(self.o, "skip_invalid") else None
        if self.file_column and len(set(names)) < len(names):
            said = f"several tasks hold rows of one file: partition the rows by {self.file_column}"
        if there := [n for n in names if not self.overwrite and os.path.exists(os.path.join(self.o["path"], n))]:
            said = "files stand there: " + ", ".join(there[:5])
        if said:
            self.abort(messages)
            raise ValueError(said)
        for name, path in staged:
            os.replace(path, os.path.join(self.o["path"], name))
        if self.overwrite:
            for f in find_files_in(self.o["path"], False, ".gpkg"):
                if os.path.basename(f) not in set(names):
                    os.remove(f)
        counts = {x["name"]: [sum(m.counts[x["name"]][i] for m in done) for i in (0, 1)] for x in self.layers}
        with open(os.path.join(self.o["path"], f"_written-{self.job}.json"), "w") as f:
            json.dump({"layers": counts, "files": sorted(names), "skipped": skipped}, f)
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages):
        import shutil

        shutil.rmtree(self.staging, ignore_errors=True)


def file_name(value) -> str:
    """The file of a value of ``file_column``."""
    name = str(value)
    if value is None or not name or "/" in name or name.startswith((".", "_")):
        raise ValueError(f"{value!r} is no name for a file")
    return name if name.endswith(".gpkg") else name + ".gpkg"


def stored(value, type_: str):
    """A value as SQLite keeps it: numbers and texts as they are, decimals with all digits, nested values as JSON."""
    if value is None or type_ == "decimal":
        return None if value is None else str(value)
    if type_ in ("double", "float"):
        return float(value)
    if isinstance(value, (int, float, str)):
        return value
    return json.dumps(value) if isinstance(value, (dict, list)) else str(value)


def write_files(rows: DataFrame, path: str, file_column: str, **options) -> None:
    """One GeoPackage for each value of ``file_column``, whatever the partitions of ``rows`` are.

    SQLite has one writer a file: the rows of a file meet in one task, which writes them as they
    come and holds none.
    """
    rows.repartition(F.col(file_column)).sortWithinPartitions(file_column).write.format("gpkg").mode("append").options(path=path, file_column=file_column, **options).save()


#: Catalog of a new file.
DDL = """
CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT, definition_12_063 TEXT NOT NULL DEFAULT 'undefined');
CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT, last_change DATETIME NOT NULL, min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER);
CREATE TABLE gpkg_geometry_columns (table_name TEXT NOT NULL, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL, PRIMARY KEY (table_name, column_name));
CREATE TABLE gpkg_extensions (table_name TEXT, column_name TEXT, extension_name TEXT NOT NULL, definition TEXT NOT NULL, scope TEXT NOT NULL, UNIQUE (table_name, column_name, extension_name));
CREATE TABLE gpkg_metadata (id INTEGER PRIMARY KEY, md_scope TEXT NOT NULL DEFAULT 'dataset', md_standard_uri TEXT NOT NULL, mime_type TEXT NOT NULL DEFAULT 'text/xml', metadata TEXT NOT NULL);
CREATE TABLE gpkg_metadata_reference (reference_scope TEXT NOT NULL, table_name TEXT, column_name TEXT, row_id_value INTEGER, timestamp DATETIME NOT NULL, md_file_id INTEGER NOT NULL, md_parent_id INTEGER);
"""


class GeoPackageSource(DataSource):
    @classmethod
    def name(cls):
        return "gpkg"

    def schema(self):
        if "layer" in self.options:
            return self._layer_schema()
        table = self.options.get("table", "gpkg_contents")
        if table == "__all__":
            return ", ".join(f"`{n}` {t}" for n, t in wide_columns().items())
        if table not in CATALOG and table not in SPECIAL:
            raise ValueError(f"unknown table {table}; one of {', '.join([*CATALOG, *SPECIAL])}")
        return "file string, " + {**CATALOG, **SPECIAL}[table]

    def _layer_schema(self):
        """Fields of the layer in all files: the first file's in order, then what others add; a field of two types is text."""
        layer, fields, found = self.options["layer"], {}, False
        for f in find_files(self.options.get("path", ""), flag(self.options, "recursive")):
            try:
                own = layer_fields(f, layer)
            except (ValueError, sqlite3.DatabaseError, OSError) as e:
                if busy(e) or not flag(self.options, "permissive"):
                    raise ValueError(f"{f}: {e}") from e
                continue
            found |= own is not None
            for name, type_ in own or []:
                known = fields.setdefault(name, type_)
                fields[name] = type_ if known == type_ else "double" if {known, type_} <= {"int", "bigint", "double"} and "double" in (known, type_) else "bigint" if {known, type_} <= {"int", "bigint"} else "string"
        if not found:
            raise ValueError(f"no layer {layer} at {self.options.get('path', '')}")
        all_ = {"file": "string", "fid": "bigint", "geom": "binary"} | fields
        if "columns" in self.options:
            wanted = [c.strip() for c in self.options["columns"].split(",")]
            if lacking := [c for c in wanted if c not in all_]:
                raise ValueError(f"{layer} has no {', '.join(lacking)}")
            all_ = {c: all_[c] for c in wanted}
        return ", ".join(f"`{n}` {t}" for n, t in all_.items())

    def reader(self, schema):
        if "layer" in self.options:
            return (PushedLayerReader if flag(self.options, "push_filters") else LayerReader)(self.options, schema)
        table = self.options.get("table", "gpkg_contents")
        return ScanReader(self.options) if table == "__all__" else GpkgReader(self.options, table)

    def writer(self, schema, overwrite):
        return GpkgWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GeoPackageSource)


def read_table(spark: SparkSession, path: str, table: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("gpkg").options(path=path, table=table, **options).load()


def read_layer(spark: SparkSession, path: str, layer: str, *, columns: list[str] | None = None, box: tuple | None = None, **options) -> DataFrame:
    """A layer of many files with typed attributes; filters on them are made inside the files."""
    register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    if columns is not None:
        options["columns"] = ",".join(columns)
    if box is not None:
        options["box"] = ",".join(map(repr, map(float, box)))
    return spark.read.format("gpkg").options(path=path, layer=layer, push_filters="true", **options).load()


def list_layers(spark: SparkSession, path: str, **options) -> DataFrame:
    """Tables of each file with their kind, system, geometry, extent, fields and number of rows."""
    return read_table(spark, path, "__layers__", **options)


def read_catalog(spark: SparkSession, path: str, **options):
    """All tables that validation needs of the readable files of ``path``, as a ``Catalog``.

    Nothing is read yet.  ``written`` opens each file once and takes all tables from one pass; by
    itself each table is a query of its own.
    """
    from ..plans.validate import Scan, shape_facts

    get = lambda t: read_table(spark, path, t, permissive="true", **options)
    return Scan(
        files=with_errors(get("__files__"), get("__errors__")), schema=get("__schema__"), pragmas=get("__pragma__"), contents=get("gpkg_contents"), srs=get("gpkg_spatial_ref_sys"),
        geometry_columns=get("gpkg_geometry_columns"), sets=get("gpkg_tile_matrix_set"), matrix=get("gpkg_tile_matrix"), extensions=get("gpkg_extensions"),
        metadata=get("gpkg_metadata"), reference=get("gpkg_metadata_reference"), heads=get("__heads__"), shapes=shape_facts(get("__features__")), index=get("__index__"),
        coverage=get("gpkg_2d_gridded_coverage_ancillary").withColumnRenamed("tile_matrix_set_name", "table_name"), columns=get("__columns__"), scan=get("__all__"),
    )


def with_errors(files: DataFrame, errors: DataFrame) -> DataFrame:
    """``file, damage`` of the readable files: SQLite's own finding, or the first table that could not be read to its end."""
    first = errors.groupBy("file").agg(F.min(F.struct("table_name", "error")).alias("e"))
    found = F.coalesce("damage", F.when(F.col("e").isNotNull(), F.concat_ws(": ", "e.table_name", "e.error")))
    return files.filter("ok").select("file", "damage").join(first, "file", "left").select("file", found.alias("damage"))
