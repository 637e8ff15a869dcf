"""GeoPackages for the tests: a sound file of each kind, and the same file with one thing spoiled."""

import sqlite3
import struct
import zlib
from math import pi

GEOGRAPHIC = 'GEOGCRS["WGS 84",ENSEMBLE["World Geodetic System 1984 ensemble",MEMBER["World Geodetic System 1984 (G2139)"]],PRIMEM["Greenwich",0],CS[ellipsoidal,2],AXIS["Lat",NORTH],AXIS["Lon",EAST],ANGLEUNIT["degree",0.0174532925199433],ID["EPSG",4326]]'
MERCATOR = 'PROJCRS["WGS 84 / World Mercator",BASEGEOGCRS["WGS 84",DATUM["World Geodetic System 1984",ELLIPSOID["WGS 84",6378137,298.257223563]],PRIMEM["Greenwich",0,ANGLEUNIT["degree",0.0174532925199433]]],ID["EPSG",3395]]'
CATALOG = """
PRAGMA application_id = 0x47504B47;
PRAGMA user_version = 10300;
CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT, srs_id INTEGER PRIMARY KEY, organization TEXT, organization_coordsys_id INTEGER, definition TEXT, description TEXT, definition_12_063 TEXT, epoch DOUBLE);
CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT, identifier TEXT, description TEXT, last_change DATETIME, min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER);
CREATE TABLE gpkg_extensions (table_name TEXT, column_name TEXT, extension_name TEXT, definition TEXT, scope TEXT);
CREATE TABLE gpkg_metadata (id INTEGER PRIMARY KEY, md_scope TEXT, md_standard_uri TEXT, mime_type TEXT, metadata TEXT);
CREATE TABLE gpkg_metadata_reference (reference_scope TEXT, table_name TEXT, column_name TEXT, row_id_value INTEGER, timestamp DATETIME, md_file_id INTEGER, md_parent_id INTEGER);
"""
TILES = """
CREATE TABLE gpkg_tile_matrix_set (table_name TEXT PRIMARY KEY, srs_id INTEGER, min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE);
CREATE TABLE gpkg_tile_matrix (table_name TEXT, zoom_level INTEGER, matrix_width INTEGER, matrix_height INTEGER, tile_width INTEGER, tile_height INTEGER, pixel_x_size DOUBLE, pixel_y_size DOUBLE);
"""
STAMP = "2024-05-06T07:08:09Z"


def document(scope="dataset", **changes):
    """A metadata document; a change replaces a child element, None leaves it out."""
    parts = {
        "fileIdentifier": "<gco:CharacterString>9f1c0d9e-0000-4000-8000-00000000000a</gco:CharacterString>",
        "language": "<gco:CharacterString>eng</gco:CharacterString>",
        "characterSet": '<gmd:MD_CharacterSetCode codeListValue="utf8"/>',
        "hierarchyLevel": f'<gmd:MD_ScopeCode codeListValue="{scope}"/>',
        "contact": '<gmd:organisationName><gco:CharacterString>Survey office</gco:CharacterString></gmd:organisationName><gmd:CI_RoleCode codeListValue="owner"/>',
        "dateStamp": "<gco:Date>2024-05-06</gco:Date>",
        "identificationInfo": "",
    }
    parts.update(changes)
    body = "".join(f"<gmd:{k}>{v}</gmd:{k}>" for k, v in parts.items() if v is not None)
    return f'<gmd:MD_Metadata xmlns:gmd="http://www.isotc211.org/2005/gmd" xmlns:gco="http://www.isotc211.org/2005/gco">{body}</gmd:MD_Metadata>'


def png(width, height=None):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"\0" * (width + 1) * (height or width)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height or width, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def jpeg(width, height=None, before=0):
    """The headers of a JPEG; ``before`` bytes of remarks stand before the frame."""
    remark = b"".join(b"\xff\xfe" + struct.pack(">H", 2 + n) + b"r" * n for n in [60000] * (before // 60000) + [before % 60000])
    return b"\xff\xd8" + remark + b"\xff\xc0\x00\x11\x08" + struct.pack(">HH", height or width, width) + b"\x03" + b"\0" * 9 + b"\xff\xd9"


def tiff(width, order="<"):
    entries = b"".join(struct.pack(order + "HHI", tag, 4, 1) + struct.pack(order + "I", width) for tag in (256, 257))
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "IH", 8, 2) + entries + b"\0" * 4


def point(x, y):
    return struct.pack("<BI2d", 1, 1, x, y)


def line(*points):
    return struct.pack("<BII", 1, 2, len(points)) + b"".join(struct.pack("<2d", *p) for p in points)


def polygon(*rings):
    """A polygon from rings, or from the points of its only one."""
    rings = rings if isinstance(rings[0][0], (tuple, list)) else [rings]
    return struct.pack("<BII", 1, 3, len(rings)) + b"".join(struct.pack("<I", len(r)) + b"".join(struct.pack("<2d", *p) for p in r) for r in rings)


def many(kind, *members):
    return struct.pack("<BII", 1, kind, len(members)) + b"".join(members)


def blob(wkb, box=None, srs_id=4326):
    head = struct.pack("<2sBBi", b"GP", 0, 1 if box is None else 3, srs_id)
    return head + (b"" if box is None else struct.pack("<4d", box[0], box[2], box[1], box[3])) + wkb


def start(path, *documents):
    con = sqlite3.connect(path)
    con.executescript(CATALOG)
    con.execute("INSERT INTO gpkg_spatial_ref_sys VALUES ('geographic', 4326, 'EPSG', 4326, ?, 'degrees', ?, NULL), ('cartesian', -1, 'NONE', -1, 'undefined', '-', 'undefined', NULL), ('none', 0, 'NONE', 0, 'undefined', '-', 'undefined', NULL)", (GEOGRAPHIC,) * 2)
    con.execute("INSERT INTO gpkg_metadata VALUES (7, 'dataset', 'https://dgiwg.org/std/dmf/2.0', 'text/xml', ?)", (document(),))
    con.execute("INSERT INTO gpkg_metadata_reference VALUES ('geopackage', NULL, NULL, NULL, ?, 7, NULL)", (STAMP,))
    con.execute("INSERT INTO gpkg_extensions VALUES ('gpkg_metadata', NULL, 'gpkg_metadata', '-', 'read-write')")
    for i, (table, scope) in enumerate(documents, 20):
        con.execute("INSERT INTO gpkg_metadata VALUES (?, ?, 'http://www.isotc211.org/2005/gmd', 'text/xml', ?)", (i, scope, document("featureType")))
        con.execute("INSERT INTO gpkg_metadata_reference VALUES ('table', ?, NULL, NULL, ?, ?, 7)", (table, STAMP, i))
    return con


def survey(path):
    """Two feature layers: wells (points) and tracks (lines whose blobs have an envelope)."""
    con = start(path, ("wells", "feature"), ("tracks", "featureType"))
    con.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z TINYINT, m TINYINT)")
    con.execute("INSERT INTO gpkg_extensions VALUES ('gpkg_spatial_ref_sys', 'definition_12_063', 'gpkg_crs_wkt', '-', 'read-write')")
    for table, kind, shapes in (("wells", "POINT", [(point(10 + i, 50), None, (10 + i, 50, 10 + i, 50)) for i in range(4)]), ("tracks", "LINESTRING", [(line((i, 1), (i + 2, 3)), 1, (i, 1, i + 2, 3)) for i in range(3)])):
        con.execute(f"CREATE TABLE {table} (fid INTEGER PRIMARY KEY, geom BLOB, remark TEXT)")
        con.execute(f"CREATE VIRTUAL TABLE rtree_{table}_geom USING rtree(id, minx, maxx, miny, maxy)")
        con.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', ?, 4326, 0, 0)", (table, kind))
        con.execute("INSERT INTO gpkg_contents VALUES (?, 'features', ?, '', ?, -1, 0, 20, 60, 4326)", (table, table, STAMP))
        con.execute("INSERT INTO gpkg_extensions VALUES (?, 'geom', 'gpkg_rtree_index', '-', 'write-only')", (table,))
        for i, (wkb, with_box, box) in enumerate(shapes, 1):
            con.execute(f"INSERT INTO {table} VALUES (?, ?, ?)", (i, blob(wkb, box if with_box else None), f"r{i}"))
            con.execute(f"INSERT INTO rtree_{table}_geom VALUES (?, ?, ?, ?, ?)", (i, box[0], box[2], box[1], box[3]))
    return con


def pyramid(con, table, srs_id, data_type, size, image, levels=3, box=(0.0, 0.0, 1e6, 1e6)):
    con.executescript(TILES)
    con.execute(f"CREATE TABLE {table} (id INTEGER PRIMARY KEY, zoom_level INTEGER, tile_column INTEGER, tile_row INTEGER, tile_data BLOB)")
    con.execute("INSERT INTO gpkg_contents VALUES (?, ?, ?, '', ?, ?, ?, ?, ?, ?)", (table, data_type, table, STAMP, *box, srs_id))
    con.execute("INSERT INTO gpkg_tile_matrix_set VALUES (?, ?, ?, ?, ?, ?)", (table, srs_id, *box))
    for z in range(levels):
        con.execute("INSERT INTO gpkg_tile_matrix VALUES (?, ?, ?, ?, 256, 256, ?, ?)", (table, z, 2**z, 2**z, size / 2**z, size / 2**z))
        con.executemany(f"INSERT INTO {table} VALUES (NULL, ?, ?, 0, ?)", [(z, i, image) for i in range(2**z)])


def imagery(path):
    """A regional JPEG pyramid of World Mercator: its level 0 is level 5 of the well-known grid."""
    con = start(path, ("scene", "tile"))
    con.execute("INSERT INTO gpkg_extensions VALUES ('gpkg_spatial_ref_sys', 'definition_12_063', 'gpkg_crs_wkt', '-', 'read-write')")
    con.execute("INSERT INTO gpkg_spatial_ref_sys VALUES ('World Mercator', 3395, 'EPSG', 3395, ?, 'metres', ?, NULL)", (MERCATOR,) * 2)
    pyramid(con, "scene", 3395, "tiles", 2 * pi * 6378137 / 256 / 2**5, jpeg(256, before=9000))
    return con


def relief(path):
    """A gridded coverage of heights in TIFF tiles."""
    con = start(path, ("ground", "featureType"))
    con.execute("INSERT INTO gpkg_extensions VALUES ('gpkg_spatial_ref_sys', 'definition_12_063', 'gpkg_crs_wkt_1_1', '-', 'read-write'), ('gpkg_2d_gridded_coverage_ancillary', NULL, 'gpkg_2d_gridded_coverage', '-', 'read-write')")
    con.executescript(
        """CREATE TABLE gpkg_2d_gridded_coverage_ancillary (tile_matrix_set_name TEXT, field_name TEXT, quantity_definition TEXT, grid_cell_encoding TEXT, datatype TEXT);
        CREATE TABLE gpkg_2d_gridded_tile_ancillary (id INTEGER);
        INSERT INTO gpkg_2d_gridded_coverage_ancillary VALUES ('ground', 'Height', 'Elevation above ground', 'grid-value-is-center', 'float');"""
    )
    pyramid(con, "ground", 4326, "2d-gridded-coverage", 0.703125, tiff(256), box=(-10.0, 40.0, 10.0, 60.0))
    return con


KINDS = {"survey": survey, "imagery": imagery, "relief": relief}


def make(path, kind, *statements):
    """A file of a kind after statements: SQL, or SQL and its parameters."""
    con = KINDS[kind](path)
    for s in statements:
        con.execute(*(s if isinstance(s, tuple) else (s,)))
    con.commit()
    con.close()
    return path
