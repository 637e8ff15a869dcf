"""Finalise existing GeoPackages: what delivery asks of the catalog is put right in each file.

A task takes one file at a time: a consistent copy beside it is changed and then renamed over it,
so a file is either as it was or finished, whatever happens to the task.  A finished file needs
no change and is not written again, so a run that was cut off is simply repeated.
"""

from __future__ import annotations

import os
import sqlite3
import struct
import uuid

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions import geometry
from ..sources import gpkg
from ..sources.gpkg import quoted

APPLICATION_ID, VERSION = 0x47504B47, 10400


def _has_z(blob) -> int:
    body = gpkg.wkb_of(blob)
    if body is None or len(body) < 5:
        return 0
    code = struct.unpack("<I" if body[0] else ">I", body[1:5])[0]
    return int(code // 1000 in (1, 2, 3) or bool(code & 0xE0000000 & ~0x20000000))


def _flat(blob, srs_id):
    body = geometry.flatten(gpkg.wkb_of(blob))
    return gpkg.gp_blob(body, struct.unpack("<i" if blob[3] & 1 else ">i", blob[4:8])[0] if srs_id is None else srs_id, gpkg.envelope(body))


def _edge(k: int):
    def of(blob):
        body = gpkg.wkb_of(blob)
        box = gpkg.envelope(body) if body else None
        return None if box is None else box[k]

    return of


class Finaliser:
    """One open file and the list of what was changed in it."""

    def __init__(self, con: sqlite3.Connection):
        self.con, self.changes = con, []
        self.tables = {r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view')")}
        con.create_function("has_z", 1, _has_z, deterministic=True)
        con.create_function("flattened", 2, _flat, deterministic=True)
        # Triggers of an index call these for every row that is written.
        con.create_function("ST_IsEmpty", 1, lambda b: int(_edge(0)(b) is None), deterministic=True)
        for name, k in (("ST_MinX", 0), ("ST_MinY", 1), ("ST_MaxX", 2), ("ST_MaxY", 3)):
            con.create_function(name, 1, _edge(k), deterministic=True)

    def do(self, what: str, statement: str, *given) -> None:
        if self.con.execute(statement, given).rowcount > 0:
            self.changes.append(what)

    def run(self) -> list[str]:
        self.systems()
        self.extension()
        self.heights()
        self.boxes()
        self.con.commit()
        self.pragmas()
        return self.changes

    def systems(self) -> None:
        """A column for WKT2, no systems that are neither allowed nor used, known definitions, no empty description."""
        columns = {r[1] for r in self.con.execute("PRAGMA table_info(gpkg_spatial_ref_sys)")}
        if "definition_12_063" not in columns:
            self.con.execute("ALTER TABLE gpkg_spatial_ref_sys ADD COLUMN definition_12_063 TEXT NOT NULL DEFAULT 'undefined'")
            self.changes.append("column definition_12_063")
        users = [t for t in ("gpkg_contents", "gpkg_geometry_columns", "gpkg_tile_matrix_set") if t in self.tables]
        used = " UNION ".join(f"SELECT srs_id FROM {t} WHERE srs_id IS NOT NULL" for t in users)
        self.do("unused systems", f"DELETE FROM gpkg_spatial_ref_sys WHERE srs_id > 0 AND srs_id NOT IN ({', '.join(map(str, dims.APPROVED))}) AND srs_id NOT IN ({used})")
        empty = "(definition_12_063 IS NULL OR trim(definition_12_063) IN ('', 'undefined'))"
        for (srs,) in self.con.execute(f"SELECT srs_id FROM gpkg_spatial_ref_sys WHERE {empty}").fetchall():
            if srs in dims.WKT2:
                self.do(f"definition of {srs}", "UPDATE gpkg_spatial_ref_sys SET definition_12_063 = ? WHERE srs_id = ?", dims.WKT2[srs], srs)
        self.do("undefined definitions", "UPDATE gpkg_spatial_ref_sys SET definition_12_063 = 'undefined' WHERE definition_12_063 IS NULL OR trim(definition_12_063) = ''")
        if "description" in columns:
            self.do("descriptions", "UPDATE gpkg_spatial_ref_sys SET description = srs_name WHERE (description IS NULL OR trim(description) = '') AND srs_name IS NOT NULL")

    def extension(self) -> None:
        if "gpkg_extensions" not in self.tables:
            self.con.execute("CREATE TABLE gpkg_extensions (table_name TEXT, column_name TEXT, extension_name TEXT NOT NULL, definition TEXT NOT NULL, scope TEXT NOT NULL, UNIQUE (table_name, column_name, extension_name))")
            self.changes.append("table gpkg_extensions")
        self.do(
            "extension gpkg_crs_wkt",
            """INSERT INTO gpkg_extensions (table_name, column_name, extension_name, definition, scope) SELECT 'gpkg_spatial_ref_sys', 'definition_12_063', 'gpkg_crs_wkt', 'http://www.geopackage.org/spec/#extension_crs_wkt', 'read-write'
            WHERE NOT EXISTS (SELECT 1 FROM gpkg_extensions WHERE extension_name LIKE 'gpkg_crs_wkt%')""",
        )

    def layers(self) -> list[tuple]:
        if "gpkg_geometry_columns" not in self.tables:
            return []
        return [r for r in self.con.execute("SELECT table_name, column_name, srs_id, z FROM gpkg_geometry_columns").fetchall() if r[0] in self.tables]

    def heights(self) -> None:
        """Layers declared flat lose Z and M; a probe that stops at the first such geometry leaves the others unread."""
        for t, c, srs, z in self.layers():
            if z == 0 and self.con.execute(f"SELECT 1 FROM {quoted(t)} WHERE has_z({quoted(c)}) LIMIT 1").fetchone():
                self.do(f"heights of {t}", f"UPDATE {quoted(t)} SET {quoted(c)} = flattened({quoted(c)}, ?) WHERE has_z({quoted(c)})", srs)

    def boxes(self) -> None:
        """Declared boxes are those of the layers' indexes."""
        for t, c, *_ in self.layers():
            if (index := f"rtree_{t}_{c}") in self.tables:
                box = self.con.execute(f"SELECT min(minx), min(miny), max(maxx), max(maxy) FROM {quoted(index)}").fetchone()
                if box[0] is not None:
                    self.do(f"box of {t}", "UPDATE gpkg_contents SET min_x = ?1, min_y = ?2, max_x = ?3, max_y = ?4 WHERE table_name = ?5 AND NOT (min_x IS ?1 AND min_y IS ?2 AND max_x IS ?3 AND max_y IS ?4)", *box, t)

    def pragmas(self) -> None:
        if str(self.con.execute("PRAGMA journal_mode").fetchone()[0]).lower() == "wal":
            self.con.execute("PRAGMA journal_mode = DELETE")
            self.changes.append("journal")
        for name, value in (("application_id", APPLICATION_ID), ("user_version", VERSION)):
            if self.con.execute(f"PRAGMA {name}").fetchone()[0] != value:
                self.con.execute(f"PRAGMA {name} = {value}")
                self.changes.append(name)


def finalise_file(path: str) -> list[str]:
    """What was changed in a file; an error leaves it as it was."""
    temporary = os.path.join(os.path.dirname(path), f".{uuid.uuid4().hex}")
    source = gpkg.open_readonly(path)
    try:
        con = sqlite3.connect(temporary)
        try:
            source.backup(con)
            changes = Finaliser(con).run()
        finally:
            con.close()
        if changes:
            os.chmod(temporary, os.stat(path).st_mode & 0o7777)
            os.replace(temporary, path)
            for x in ("-wal", "-shm"):  # of the file that was replaced
                if os.path.exists(path + x):
                    os.unlink(path + x)
        return changes
    finally:
        source.close()
        for x in (temporary, temporary + "-journal", temporary + "-wal", temporary + "-shm"):
            if os.path.exists(x):
                os.unlink(x)


def finalise(spark: SparkSession, path: str, *, recursive: bool = False) -> list[dict]:
    """Finalise all files of a path: ``file``, what was changed in it, or the ``error`` that left it as it was.

    Files are dealt to tasks one by one, so a large one delays no other.
    """
    files = gpkg.find_files(path, recursive)
    if not files:
        return []

    def run(batches):
        for batch in batches:
            for f in batch.column("file").to_pylist():
                changes, error = [], None
                try:
                    changes = finalise_file(f)
                except (sqlite3.Error, ValueError, OSError, struct.error, IndexError) as e:
                    error = str(e)
                yield pa.RecordBatch.from_arrays([pa.array([f]), pa.array([changes], pa.list_(pa.string())), pa.array([error], pa.string())], ["file", "changes", "error"])

    rows = spark.createDataFrame([(f,) for f in files], "file string").repartition(min(len(files), 10_000), F.col("file"))
    return [r.asDict() for r in rows.mapInArrow(run, "file string, changes array<string>, error string").collect()]
