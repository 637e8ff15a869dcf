"""A catalog of one file for each customer, with defects by arithmetic on keys, and the SQL of its findings.

Kinds of files by key: features, tiles, a gridded coverage, attributes.  Each defect has its
own divisor, so most rules hold in some files and fail in others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import dims
from .adapters import WKT
from .functions.wkt import registry

AS_OF = "2026-01-01T00:00:00Z"
_K = "c_custkey"
_FILE = f"concat('g', {_K}) AS file"
CODES = (4326, 3857, 32633, 27700, 4979, 9518, 100200)
_CODE = f"CAST(CASE {_K} % 7 " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(CODES[:-1])) + f" ELSE {CODES[-1]} END AS INT)"
_WEST, _SOUTH = f"({_K} * 7919 % 30000 - 15000) / 1e2", f"({_K} * 104729 % 15000 - 7500) / 1e2"
_LON_FIRST = WKT[4326].replace('AXIS["Lat",NORTH],AXIS["Lon",EAST]', 'AXIS["Lon",EAST],AXIS["Lat",NORTH]')
_DEFINITION = (
    f"CASE WHEN {_K} % 29 = 0 THEN '' WHEN {_K} % 77 = 0 THEN '{_LON_FIRST}' WHEN {_K} % 79 = 0 THEN '{WKT[4326].replace('World Geodetic System 1984 ensemble', 'Another Datum')}' "
    + " ".join(f"WHEN {_K} % 7 = {i} THEN '{WKT[c]}'" for i, c in enumerate(CODES))
    + " END"
)
_PX = "CASE k % 7 WHEN 0 THEN 0.703125e0 WHEN 4 THEN 0.703125e0 WHEN 1 THEN 156543.03392804097e0 ELSE 1000e0 END / pow(2e0, z)"
_COLUMNS = {
    "gpkg_spatial_ref_sys": ("srs_id", "definition_12_063"),
    "gpkg_metadata": ("id", "md_scope", "md_standard_uri", "mime_type", "metadata"),
    "gpkg_metadata_reference": ("reference_scope", "table_name", "column_name", "row_id_value", "timestamp", "md_file_id"),
    "gpkg_geometry_columns": ("table_name",),
    "gpkg_tile_matrix_set": ("table_name", "srs_id", "min_x", "min_y", "max_x", "max_y"),
    "gpkg_tile_matrix": ("table_name",),
    "gpkg_2d_gridded_coverage_ancillary": ("tile_matrix_set_name", "field_name", "quantity_definition", "grid_cell_encoding"),
    "gpkg_2d_gridded_tile_ancillary": ("id",),
}
_PAIRS = ", ".join(f"('{t}', '{c}')" for t, cs in _COLUMNS.items() for c in cs)
_LEVELS = f"(SELECT {_K} AS k, z FROM {{customer}} CROSS JOIN (VALUES (0), (1), (2), (3)) AS n(z) WHERE {_K} % 4 IN (1, 2) AND z <= {_K} % 3 + 1 AND NOT ({_K} % 27 = 0 AND z = 1)) AS l"
_ROOT = "concat('<gmd:MD_Metadata xmlns:gmd=\"', CASE WHEN k % 48 = 21 THEN 'http://standards.iso.org/iso/19115/-3/mdb/1.0' ELSE 'http://www.isotc211.org/2005/gmd' END, '\">')"

VIEWS = {
    "files": f"SELECT {_FILE}, CASE WHEN {_K} % 101 = 0 THEN 'page 7 is damaged' END AS damage FROM {{customer}}",
    "pragmas": f"""SELECT {_FILE}, name, CASE name WHEN 'application_id' THEN CASE WHEN {_K} % 11 = 0 THEN '1196437808' ELSE '1196444487' END
        WHEN 'user_version' THEN CASE WHEN {_K} % 23 = 0 THEN '10100' ELSE '10300' END WHEN 'encoding' THEN CASE WHEN {_K} % 61 = 0 THEN 'UTF-16le' ELSE 'UTF-8' END
        ELSE CASE WHEN {_K} % 62 = 0 THEN 'wal' ELSE 'delete' END END AS value
        FROM {{customer}} CROSS JOIN (VALUES ('application_id'), ('user_version'), ('encoding'), ('journal_mode')) AS n(name)""",
    "contents": f"""SELECT {_FILE}, 't' AS table_name, CASE {_K} % 4 WHEN 0 THEN 'features' WHEN 1 THEN 'tiles' WHEN 2 THEN '2d-gridded-coverage' ELSE 'attributes' END AS data_type, {_CODE} AS srs_id,
        CASE WHEN {_K} % 39 <> 0 THEN {_WEST} END AS min_x, {_SOUTH} AS min_y, CASE WHEN {_K} % 21 = 0 THEN 1e9 ELSE {_WEST} + 6 END AS max_x, CASE WHEN {_K} % 25 = 0 THEN {_SOUTH} - 1 ELSE {_SOUTH} + 9 END AS max_y,
        CASE WHEN {_K} % 13 = 0 THEN 'not-a-date' WHEN {_K} % 17 = 0 THEN '2031-01-02T03:04:05Z' WHEN {_K} % 83 = 0 THEN NULL ELSE '2025-01-02T03:04:05.123Z' END AS last_change FROM {{customer}}""",
    "srs": f"""SELECT {_FILE}, {_CODE} AS srs_id, CASE WHEN {_K} % 58 = 3 THEN 'http://example.org/crs/100250' ELSE 'a system' END AS srs_name, {_DEFINITION} AS definition,
        CASE WHEN {_K} % 5 = 0 THEN 'undefined' ELSE {_DEFINITION} END AS definition_12_063, CASE {_K} % 6 WHEN 0 THEN 2010e0 WHEN 1 THEN 2015e0 WHEN 2 THEN -1e0 END AS epoch,
        CASE WHEN {_K} % 15 = 4 THEN 'Esri' ELSE 'EPSG' END AS organization, CASE WHEN {_K} % 14 = 2 THEN ' ' WHEN {_K} % 14 = 3 THEN NULL ELSE 'text' END AS description FROM {{customer}}
        UNION ALL SELECT {_FILE}, CAST(0 AS INT), 'none', 'undefined', 'undefined', NULL, 'NONE', 'none' FROM {{customer}}""",
    "geometry_columns": f"""SELECT {_FILE}, table_name, 'geom' AS column_name, CASE {_K} % 3 WHEN 0 THEN 'POLYGON' WHEN 1 THEN 'MULTIPOLYGONZ' ELSE 'GEOMETRY' END AS geometry_type_name, {_CODE} AS srs_id,
        CAST(CASE {_K} % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS INT) AS z, CAST(0 AS INT) AS m
        FROM {{customer}} CROSS JOIN (VALUES ('t'), ('ghost')) AS n(table_name) WHERE {_K} % 4 = 0 AND (table_name = 't' OR {_K} % 60 = 0)""",
    "sets": f"""SELECT {_FILE}, table_name, {_CODE} AS srs_id, CASE WHEN {_K} % 78 <> 2 THEN {_WEST} END AS min_x, {_SOUTH} AS min_y, CASE WHEN {_K} % 22 = 0 THEN 1e9 ELSE {_WEST} + 6 END AS max_x, {_SOUTH} + 9 AS max_y
        FROM {{customer}} CROSS JOIN (VALUES ('t'), ('ghost')) AS n(table_name) WHERE {_K} % 4 IN (1, 2) AND (table_name = 't' OR {_K} % 37 = 0)""",
    "matrix": f"""SELECT concat('g', k) AS file, 't' AS table_name, CAST(z AS INT) AS zoom_level, CAST(CASE WHEN k % 31 = 0 AND z = 0 THEN 512 ELSE 256 END AS INT) AS tile_width, CAST(256 AS INT) AS tile_height,
        CASE WHEN k % 89 = 0 THEN 0e0 ELSE {_PX} * CASE WHEN k % 17 = 0 AND z > 0 THEN 1.1e0 ELSE 1e0 END END AS pixel_x_size, {_PX} * CASE WHEN k % 41 = 0 AND z > 0 THEN 4.5e0 ELSE 1e0 END AS pixel_y_size FROM {_LEVELS}""",
    "heads": f"""SELECT concat('g', k) AS file, 't' AS table_name, CAST(z AS INT) AS zoom_level, CASE WHEN k % 43 = 0 THEN 'WEBP' WHEN k % 24 = 10 AND z = 0 THEN 'UNKNOWN' WHEN k % 3 = 0 THEN 'JPEG' ELSE 'PNG' END AS format,
        CAST(CASE WHEN k % 43 = 0 OR k % 24 = 10 AND z = 0 THEN NULL WHEN k % 31 = 0 AND z = 0 THEN 512 WHEN k % 47 = 0 THEN 128 ELSE 256 END AS INT) AS width, CAST(256 AS INT) AS height FROM {_LEVELS} WHERE k % 19 <> 0""",
    "extensions": f"""SELECT {_FILE}, CASE WHEN name IN ('gpkg_rtree_index', 'gpkg_webp', 'gpkg_geom_CURVE') OR name = 'gpkg_crs_wkt' AND {_K} % 4 = 2 THEN 't' END AS table_name, CAST(NULL AS STRING) AS column_name, name AS extension_name,
        CASE WHEN {_K} % 82 = 0 THEN 'bogus' WHEN {_K} % 37 = 0 THEN NULL ELSE 'read-write' END AS scope
        FROM {{customer}} CROSS JOIN (VALUES ('gpkg_metadata'), ('gpkg_rtree_index'), ('gpkg_crs_wkt'), ('gpkg_crs_wkt_1_1'), ('gpkg_2d_gridded_coverage'), ('gpkg_webp'), ('gpkg_geom_CURVE'), ('gdal_aspatial'), ('gpkg_schema')) AS n(name)
        WHERE CASE name WHEN 'gpkg_metadata' THEN {_K} % 10 <> 0 WHEN 'gpkg_rtree_index' THEN {_K} % 4 = 0 AND {_K} % 8 <> 0 WHEN 'gpkg_crs_wkt' THEN {_K} % 4 < 2 AND {_K} % 9 <> 1 OR {_K} % 18 = 2 AND {_K} % 4 = 2
        WHEN 'gpkg_crs_wkt_1_1' THEN {_K} % 4 = 2 AND {_K} % 22 <> 6 WHEN 'gpkg_2d_gridded_coverage' THEN {_K} % 4 = 2 AND {_K} % 26 <> 14 WHEN 'gpkg_webp' THEN {_K} % 43 = 0 WHEN 'gpkg_geom_CURVE' THEN {_K} % 64 = 20 WHEN 'gdal_aspatial' THEN {_K} % 16 = 3 ELSE {_K} % 6 = 1 END""",
    "metadata": f"""SELECT concat('g', k) AS file, id, CASE WHEN id = 2 THEN CASE WHEN k % 4 = 0 THEN 'feature' WHEN k % 4 = 1 THEN 'tile' WHEN k % 8 = 2 THEN 'featureType' ELSE 'attribute' END ELSE CASE k % 6 WHEN 0 THEN 'dataset' WHEN 3 THEN 'dataset' WHEN 4 THEN 'bogus' ELSE 'series' END END AS md_scope,
        CASE WHEN id = 2 AND k % 28 = 1 THEN '' WHEN id = 1 AND k % 3 = 0 THEN 'https://www.dgiwg.org/std/dmf/2.0' ELSE 'http://www.isotc211.org/2005/gmd' END AS md_standard_uri,
        CASE WHEN id = 1 AND k % 33 = 0 THEN 'text/plain' WHEN id = 1 AND k % 34 = 0 OR k % 86 = 4 THEN NULL ELSE 'text/xml' END AS mime_type,
        CASE WHEN id = 2 AND k % 38 = 0 THEN '<x/>' WHEN id = 1 AND k % 87 = 0 THEN ' ' ELSE concat({_ROOT},
          CASE WHEN k % 15 = 0 THEN '' ELSE '<gmd:fileIdentifier>f</gmd:fileIdentifier>' END, '<gmd:language>', CASE WHEN k % 36 = 9 THEN 'english' ELSE 'eng' END, '</gmd:language>',
          '<gmd:characterSet><gmd:MD_CharacterSetCode codeListValue="', CASE WHEN k % 30 = 3 THEN 'runes' ELSE 'utf8' END, '"/></gmd:characterSet><gmd:hierarchyLevel><gmd:MD_ScopeCode>', CASE WHEN k % 18 = 6 THEN 'none' ELSE 'dataset' END,
          '</gmd:MD_ScopeCode></gmd:hierarchyLevel><gmd:contact>', CASE WHEN k % 21 = 9 THEN '' ELSE '<gmd:organisationName>o</gmd:organisationName>' END, CASE WHEN k % 45 = 12 THEN '' ELSE '<gmd:CI_RoleCode codeListValue="owner"/>' END,
          '</gmd:contact><gmd:dateStamp>', CASE WHEN k % 24 = 15 THEN 'yesterday' ELSE '2025-01-01' END, '</gmd:dateStamp>', CASE WHEN k % 33 = 15 THEN '' ELSE '<gmd:identificationInfo/>' END, CASE WHEN k % 27 = 12 THEN '<gmd:extra/>' ELSE '' END,
          CASE WHEN k % 54 = 30 THEN '<gmd:dateStamp>2025-01-01</gmd:dateStamp>' ELSE '' END, CASE WHEN k % 42 = 3 AND id = 1 OR k % 46 = 5 AND id = 2 THEN '' ELSE '</gmd:MD_Metadata>' END) END AS metadata
        FROM (SELECT {_K} AS k, CAST(id AS BIGINT) AS id FROM {{customer}} CROSS JOIN (VALUES (1), (2)) AS n(id) WHERE {_K} % 35 <> 0) AS d""",
    "reference": f"""SELECT {_FILE}, scope AS reference_scope, CASE WHEN scope IN ('table', 'row') OR {_K} % 12 = 5 THEN 't' END AS table_name, CAST(NULL AS STRING) AS column_name, CAST(NULL AS BIGINT) AS row_id_value,
        CASE WHEN {_K} % 36 = 11 THEN 'soon' WHEN {_K} % 36 = 13 THEN '' ELSE '2025-01-02T03:04:05Z' END AS timestamp, CAST(CASE scope WHEN 'table' THEN 2 WHEN 'row' THEN 99 ELSE 1 END AS BIGINT) AS md_file_id,
        CAST(CASE WHEN scope = 'table' AND {_K} % 22 <> 8 THEN CASE WHEN {_K} % 23 = 5 THEN 77 ELSE 1 END END AS BIGINT) AS md_parent_id
        FROM {{customer}} CROSS JOIN (VALUES ('geopackage'), ('table'), ('row'), ('planet')) AS n(scope)
        WHERE {_K} % 55 <> 0 AND {_K} % 91 <> 0 AND CASE scope WHEN 'geopackage' THEN {_K} % 20 <> 7 WHEN 'table' THEN {_K} % 14 <> 9 WHEN 'row' THEN {_K} % 49 = 0 ELSE {_K} % 40 = 3 END""",
    "shapes": f"""SELECT {_FILE}, 't' AS table_name, {_K} % 52 = 0 AND i = 0 AS empty, ({_K} % 5 = 0 OR {_K} % 5 = 1 AND i = 1) <> ({_K} % 44 = 0 AND i = 1) AS has_z, {_K} % 84 = 0 AND i = 3 AS has_m,
        CASE WHEN {_K} % 64 = 0 AND i = 2 THEN 'POINT' WHEN {_K} % 68 = 0 AND i = 3 THEN 'MULTIPOLYGON' ELSE CASE {_K} % 3 WHEN 1 THEN 'MULTIPOLYGON' ELSE 'POLYGON' END END AS geometry_type,
        CASE WHEN {_K} % 56 = 0 AND i = 1 THEN 'self-intersection' END AS problem FROM {{customer}} CROSS JOIN (VALUES (0), (1), (2), (3)) AS n(i) WHERE {_K} % 4 = 0""",
    "indexes": f"""SELECT {_FILE}, 't' AS table_name, CAST(CASE WHEN {_K} % 52 = 0 THEN 3 ELSE 4 END + CASE WHEN {_K} % 16 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n, {_WEST} AS min_x, {_SOUTH} AS min_y,
        {_WEST} + CASE WHEN {_K} % 32 = 4 THEN 7 ELSE 5 END AS max_x, {_SOUTH} + 5 AS max_y FROM {{customer}} WHERE {_K} % 4 = 0 AND {_K} % 92 <> 0""",
    "coverage": f"""SELECT {_FILE}, 't' AS table_name, CASE WHEN {_K} % 5 = 0 THEN 'rainfall' WHEN {_K} % 5 = 1 THEN NULL ELSE 'Elevation of ground' END AS quantity_definition,
        CASE WHEN {_K} % 3 = 0 THEN 'Height' WHEN {_K} % 11 = 0 THEN NULL ELSE 'depth' END AS field_name, CASE WHEN {_K} % 7 = 0 THEN 'grid-value-is-corner' WHEN {_K} % 13 = 0 THEN NULL ELSE 'grid-value-is-center' END AS grid_cell_encoding
        FROM {{customer}} WHERE {_K} % 4 = 2""",
    "schema": f"""SELECT {_FILE}, 't' AS table_name, 'fid' AS column_name, CASE WHEN {_K} % 67 = 0 THEN 'TEXT' ELSE 'INTEGER' END AS type, CAST(CASE WHEN {_K} % 53 = 0 THEN 0 ELSE 1 END AS INT) AS pk FROM {{customer}} WHERE {_K} % 71 <> 0
        UNION ALL SELECT {_FILE}, 't', 'fid2', 'INTEGER', CAST(2 AS INT) FROM {{customer}} WHERE {_K} % 73 = 0
        UNION ALL SELECT {_FILE}, CASE WHEN {_K} % 2 = 0 THEN 'gpkg_ogr_contents' ELSE 'gdb_items' END, 'id', 'INTEGER', CAST(1 AS INT) FROM {{customer}} WHERE {_K} % 9 < 2
        UNION ALL SELECT {_FILE}, t, c, 'TEXT', CAST(0 AS INT) FROM {{customer}} CROSS JOIN (VALUES {_PAIRS}) AS n(t, c)
        WHERE CASE t WHEN 'gpkg_spatial_ref_sys' THEN c = 'srs_id' OR {_K} % 8 <> 6 WHEN 'gpkg_metadata' THEN {_K} % 35 <> 0 AND (c <> 'mime_type' OR {_K} % 45 <> 0) WHEN 'gpkg_metadata_reference' THEN {_K} % 55 <> 0 AND (c <> 'timestamp' OR {_K} % 51 <> 0)
        WHEN 'gpkg_geometry_columns' THEN {_K} % 4 = 0 AND {_K} % 76 <> 0 WHEN 'gpkg_tile_matrix_set' THEN {_K} % 4 IN (1, 2) AND {_K} % 65 <> 0 AND (c <> 'max_y' OR {_K} % 63 <> 0) WHEN 'gpkg_tile_matrix' THEN {_K} % 4 IN (1, 2) AND {_K} % 75 <> 0
        WHEN 'gpkg_2d_gridded_coverage_ancillary' THEN {_K} % 4 = 2 AND {_K} % 94 <> 2 AND (c <> 'field_name' OR {_K} % 26 <> 0) ELSE {_K} % 4 = 2 AND {_K} % 30 <> 0 END""",
}


def spread(customer: DataFrame) -> DataFrame:
    """The customers dealt over all cores: a table of few bytes is read by one task or two, but each row makes some fifty rows and two documents to parse."""
    return customer.repartition(2 * max(4, customer.sparkSession.sparkContext.defaultParallelism))


def catalog_of(spark: SparkSession, sf_dir: str):
    """The views over a folder's customers as a ``Catalog``."""
    from .plans.validate import Catalog

    customer = spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/customer.parquet"))
    get = {name: spark.sql(body, customer=customer) for name, body in VIEWS.items()}
    return Catalog(**{("index" if name == "indexes" else name): df for name, df in get.items()})


def _in(values) -> str:
    return "(" + ", ".join(map(repr, values)) + ")"


#: Facts of the allowed systems, for SQL.
REGISTRY = "(VALUES " + ", ".join(f"({c}, '{f['kind']}', {f['axis_count']}, '{','.join(f['axes'])}', {repr(f['method']) if f['method'] else 'NULL'})" for c, f in registry().items()) + ") AS g(srs_id, kind, n, axes, method)"


_ALLOWED = {k: _in(v) for k, v in dims.VALIDATE.items()}
_CATS = "CASE data_type WHEN 'features' THEN 'features' WHEN 'tiles' THEN 'tiles' WHEN '2d-gridded-coverage' THEN 'gridded' END"
_RULES = "(VALUES " + ", ".join(f"('{e}', '{c}', '{u}')" for e, uses in dims.EXTENSIONS.items() for c, u in zip(dims.CATEGORIES, uses)) + ") AS r(rule, category, use)"
_SCOPES = "(VALUES " + ", ".join(f"('{r}', '{m}')" for r, ms in dims.SCOPES.items() for m in ms) + ") AS p(reference_scope, md_scope)"
_EXTENT = "(VALUES " + ", ".join(f"({k}, {', '.join(f'{x!r}::DOUBLE' for x in v)})" for k, v in dims.EXTENT.items()) + ") AS e(srs_id, a, b, c, d)"
_PZ = "(VALUES " + ", ".join(f"({k}, {v!r}::DOUBLE)" for k, v in dims.PIXEL_Z0.items()) + ") AS p(srs_id, pz0)"
_COMPOUND = "(upper({0}) LIKE '%COMPOUNDCRS%' OR upper({0}) LIKE '%COMPD_CS%')"
_KNOWN = "nullif(nullif(trim({0}), ''), 'undefined')"
_OUT = "(s.min_x < a - (c - a) * 0.001 OR s.min_y < b - (d - b) * 0.001 OR s.max_x > c + (c - a) * 0.001 OR s.max_y > d + (d - b) * 0.001)"
_HAS = "(SELECT DISTINCT file FROM schema WHERE table_name = '{0}')"
_MISSING = "SELECT h.file FROM (SELECT DISTINCT file FROM schema WHERE table_name = '{0}') h CROSS JOIN (VALUES {1}) n(c) WHERE NOT EXISTS (SELECT 1 FROM schema x WHERE x.file = h.file AND x.table_name = '{0}' AND x.column_name = n.c)"


def _missing(table: str, columns) -> str:
    return _MISSING.format(table, ", ".join(f"('{c}')" for c in columns))


_LEVEL = "CASE WHEN {0} THEN 2 ELSE 0 END"
#: Requirement: selects of ``file, level``.
_EVIDENCE = {
    3: [
        "SELECT file, CASE WHEN max(value) FILTER (name = 'application_id') IN ('1196437810', '1196437811', '1196437812') OR max(value) FILTER (name = 'application_id') = '1196444487' AND max(value::BIGINT) FILTER (name = 'user_version') >= 10200 THEN 0 ELSE 2 END FROM pragmas WHERE name IN ('application_id', 'user_version') GROUP BY file",
        "SELECT file, 2 FROM pragmas WHERE name = 'encoding' AND value <> 'UTF-8' OR name = 'journal_mode' AND value = 'wal'",
        r"SELECT file, 2 FROM contents WHERE last_change IS NULL OR NOT regexp_matches(last_change, '^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z$')",
        f"SELECT c.file, 2 FROM cats c JOIN {_RULES} ON r.category = c.category AND use = 'M' WHERE NOT EXISTS (SELECT 1 FROM extensions e WHERE e.file = c.file AND e.extension_name = rule)",
        "SELECT file, 2 FROM extensions WHERE scope NOT IN ('read-write', 'write-only')",
    ],
    4: ["SELECT file, 0 FROM cats", f"SELECT e.file, 1 FROM extensions e JOIN cats c ON c.file = e.file JOIN {_RULES} ON r.category = c.category AND use = 'O' AND rule = extension_name"],
    5: [
        "SELECT file, 0 FROM cats", "SELECT file, 2 FROM heads WHERE format = 'WEBP'",
        f"SELECT e.file, 2 FROM extensions e JOIN cats c ON c.file = e.file JOIN {_RULES} ON r.category = c.category AND use = 'N' AND (rule = extension_name OR rule = 'gpkg_geom_' AND extension_name LIKE 'gpkg~_geom~_%' ESCAPE '~')",
    ],
    7: [
        f"""SELECT file, CASE WHEN bool_or(state IN ('system', 'size')) THEN 2 WHEN bool_or(state = 'skip') AND NOT bool_or(state = 'good') THEN 1 ELSE 0 END FROM (
            SELECT s.file, CASE WHEN s.srs_id NOT IN {_ALLOWED['raster']} THEN CASE WHEN regexp_matches(upper(replace(concat_ws(' ', definition, definition_12_063), '_', ' ')), 'LAMBERT (CONFORMAL CONIC|CONIC CONFORMAL)') THEN 'skip' ELSE 'system' END
              WHEN o.wrong THEN 'size' WHEN o.wrong IS NULL THEN 'skip' ELSE 'good' END AS state
            FROM sets s JOIN contents c USING (file, table_name) LEFT JOIN srs d ON d.file = s.file AND d.srs_id = s.srs_id LEFT JOIN offs o ON o.file = s.file AND o.table_name = s.table_name WHERE data_type = 'tiles') GROUP BY file""",
    ],
    8: [f"SELECT s.file, {_LEVEL.format('tile_width <> 256 OR tile_height <> 256')} FROM sets s JOIN contents c USING (file, table_name) LEFT JOIN matrix m USING (file, table_name) WHERE data_type = 'tiles'"],
    9: [f"SELECT file, {_LEVEL.format('srs_id <> 4326')} FROM geometry_columns WHERE z = 0"],
    10: [f"SELECT file, {_LEVEL.format('srs_id NOT IN (4979, 9518)')} FROM geometry_columns WHERE z <> 0"],
    11: [f"SELECT s.file, CASE WHEN s.srs_id NOT IN {_ALLOWED['gridded_2d']} OR coalesce({_OUT}, false) AND s.min_x IS NOT NULL THEN 2 ELSE 0 END FROM grids s LEFT JOIN {_EXTENT} ON e.srs_id = s.srs_id WHERE NOT three"],
    12: [f"SELECT file, {_LEVEL.format(f'srs_id NOT IN {_ALLOWED["gridded_3d"]} AND NOT ' + _COMPOUND.format('definition'))} FROM grids WHERE three"],
    13: [
        f"SELECT file, {_LEVEL.format('srs_id NOT IN ' + _in(sorted({x for v in dims.VALIDATE.values() for x in v} | {4978})) + " AND NOT srs_id BETWEEN 100100 AND 100399 AND srs_name NOT LIKE '%/100250'")} FROM used",
        r"""SELECT file, CASE WHEN wkt IS NULL OR regexp_matches(upper(wkt), '(GEOGCS|PROJCS|COMPD_CS)\[') OR upper(wkt) LIKE '%PRIMEM%' AND upper(wkt) NOT LIKE '%GREENWICH%' OR upper(wkt) LIKE '%ANGLEUNIT%' AND upper(wkt) NOT LIKE '%DEGREE%'
            OR regexp_matches(upper(wkt), '(GEOGCRS|GEOGCS|GEODCRS|GEODETICCRS)\[') AND list_transform(regexp_extract_all(wkt, 'AXIS\["[^"]*",\s*([A-Za-z]+)\]', 1), lambda x: upper(x))[1:2] = ['EAST', 'NORTH']
            OR datum IS NULL OR upper(replace(datum, '_', ' ')) NOT IN """ + _in(dims.WGS84_NAMES) + """ AND NOT srs_id BETWEEN 100100 AND 100399 AND srs_name NOT LIKE '%/100250' THEN 2 ELSE 0 END
            FROM (SELECT *, coalesce(nullif(regexp_extract(wkt, 'DATUM\\["([^"]+)"', 1), ''), nullif(regexp_extract(wkt, 'ENSEMBLE\\["([^"]+)"', 1), '')) AS datum FROM used)""",
        rf"""SELECT file, CASE WHEN kind IS NOT NULL AND (k <> kind OR m <> n) THEN 2 ELSE 0 END
            FROM (SELECT file, kind, k, n, coalesce(nullif(greatest(len(ax), coalesce(cs, 0)), 0), CASE k WHEN 'compound' THEN 3 ELSE 2 END) AS m
            FROM (SELECT file, srs_id, CASE WHEN wkt LIKE 'GEOGC%' THEN 'geographic' WHEN wkt LIKE 'PROJC%' THEN 'projected' WHEN wkt LIKE 'COMP%' THEN 'compound' END AS k,
            regexp_extract_all(wkt, 'AXIS\["[^"]*",\s*([A-Za-z]+)\]', 1) AS ax, TRY_CAST(nullif(regexp_extract(wkt, ',CS\[\w+,(\d)\]', 1), '') AS INTEGER) AS cs
            FROM used WHERE wkt IS NOT NULL) LEFT JOIN {REGISTRY} USING (srs_id))""",
    ],
    14: ["SELECT file, 0 FROM files", f"SELECT g.file, 2 FROM geometry_columns g JOIN srs d USING (file, srs_id) WHERE z = 0 AND {_COMPOUND.format('definition')}"],
    15: [f"SELECT file, {_LEVEL.format('broken')} FROM compounds u WHERE EXISTS (SELECT 1 FROM geometry_columns g WHERE g.file = u.file AND g.srs_id = u.srs_id AND z <> 0)"],
    16: [f"""SELECT file, CASE WHEN broken OR NOT EXISTS (SELECT 1 FROM schema x WHERE x.file = u.file AND x.table_name = 'gpkg_spatial_ref_sys' AND x.column_name = 'definition_12_063') THEN 2 ELSE 0 END
        FROM compounds u WHERE EXISTS (SELECT 1 FROM sets s JOIN coverage v USING (file, table_name) WHERE s.file = u.file AND s.srs_id = u.srs_id)"""],
    17: [r"SELECT file, CASE WHEN round(TRY_CAST(regexp_extract(wkt, '(?i)DYNAMIC\s*\[\s*FRAMEEPOCH\s*\[\s*([0-9.]+)', 1) AS DOUBLE), 1) = round(epoch, 1) THEN 0 ELSE 2 END FROM used WHERE epoch <> 0"],
    18: [
        "SELECT f.file, 2 FROM files f WHERE NOT EXISTS (SELECT 1 FROM metadata m WHERE m.file = f.file)",
        "SELECT file, CASE WHEN bool_or(dmf AND NOT later) THEN 0 ELSE 1 END FROM docs GROUP BY file",
        r"""SELECT file, CASE WHEN malformed OR metadata NOT LIKE '%fileIdentifier%' OR metadata NOT LIKE '%>eng<%' OR metadata NOT LIKE '%"utf8"%' OR metadata NOT LIKE '%>dataset<%' OR metadata NOT LIKE '%organisationName%' OR metadata NOT LIKE '%RoleCode%'
            OR NOT regexp_matches(metadata, '<gmd:dateStamp>\d{4}-\d\d-\d\d<') OR metadata NOT LIKE '%identificationInfo%' OR metadata LIKE '%gmd:extra%' OR len(regexp_extract_all(metadata, '<gmd:dateStamp>')) > 1 THEN 2 ELSE 0 END FROM docs WHERE dmf AND NOT later""",
    ],
    19: [
        f"SELECT file, 2 FROM files WHERE file NOT IN {_HAS.format('gpkg_metadata_reference')} OR file NOT IN {_HAS.format('gpkg_metadata')}",
        f"SELECT file, {_LEVEL.format("malformed OR coalesce(mime_type <> 'text/xml', false)")} FROM docs",
        f"SELECT f.file, {_LEVEL.format('NOT anchored')} FROM anchored f", f"SELECT file, {_LEVEL.format('NOT fine')} FROM linked",
    ],
    20: [f"SELECT file, CASE WHEN file IN {_HAS.format('gpkg_metadata')} THEN 0 ELSE 2 END FROM files", "SELECT file, 2 FROM (" + _missing("gpkg_metadata", _COLUMNS["gpkg_metadata"]) + ")"],
    21: [
        f"SELECT file, 2 FROM files WHERE file NOT IN {_HAS.format('gpkg_metadata_reference')}", "SELECT file, 2 FROM (" + _missing("gpkg_metadata_reference", _COLUMNS["gpkg_metadata_reference"]) + ")",
        f"SELECT file, 1 FROM {_HAS.format('gpkg_metadata_reference')} WHERE file NOT IN (SELECT file FROM reference)", "SELECT file, 2 FROM orphans", f"SELECT file, {_LEVEL.format("NOT fine OR timestamp = 'soon'")} FROM linked",
    ],
    22: ["SELECT file, 2 FROM files WHERE file NOT IN (SELECT file FROM metadata WHERE md_scope IN ('series', 'dataset'))", f"SELECT file, {_LEVEL.format("barren OR coalesce(mime_type <> 'text/xml', false)")} FROM docs WHERE md_scope IN ('series', 'dataset')"],
    23: [f"SELECT file, {_LEVEL.format('NOT anchored')} FROM anchored"],
    24: [
        "SELECT file, 0 FROM files", "SELECT file, 2 FROM orphans",
        "SELECT c.file, 2 FROM contents c WHERE NOT EXISTS (SELECT 1 FROM schema x WHERE x.file = c.file AND x.table_name = c.table_name)",
        f"SELECT file, 2 FROM cats WHERE category = 'features' AND file NOT IN {_HAS.format('gpkg_geometry_columns')} OR category <> 'features' AND (file NOT IN {_HAS.format('gpkg_tile_matrix_set')} OR file NOT IN {_HAS.format('gpkg_tile_matrix')})",
        "SELECT file, 2 FROM (SELECT file, table_name FROM geometry_columns UNION SELECT file, table_name FROM sets UNION SELECT file, table_name FROM matrix) WHERE table_name = 'ghost'",
        "SELECT g.file, 2 FROM geometry_columns g JOIN schema x ON x.file = g.file AND x.table_name = g.table_name GROUP BY g.file, g.table_name HAVING count(*) FILTER (pk > 0) <> 1 OR max(upper(type)) FILTER (pk > 0) <> 'INTEGER'",
        """SELECT g.file, 2 FROM geometry_columns g LEFT JOIN indexes i USING (file, table_name) LEFT JOIN contents c USING (file, table_name)
           WHERE i.n IS NULL OR i.n <> (SELECT count(*) FROM shapes s WHERE s.file = g.file AND s.table_name = g.table_name AND NOT empty) OR i.min_x < c.min_x - 1e-6 OR i.min_y < c.min_y - 1e-6 OR i.max_x > c.max_x + 1e-6 OR i.max_y > c.max_y + 1e-6""",
        """SELECT s.file, 2 FROM shapes s JOIN geometry_columns g USING (file, table_name) WHERE empty OR problem IS NOT NULL OR z = 1 AND NOT has_z OR z = 0 AND has_z OR m = 1 AND NOT has_m OR m = 0 AND has_m
           OR geometry_type_name <> 'GEOMETRY' AND geometry_type <> rtrim(geometry_type_name, 'ZM')""",
    ],
    25: [
        "SELECT file, 0 FROM tiled", f"SELECT file, 2 FROM tiled WHERE file NOT IN {_HAS.format('gpkg_tile_matrix_set')}", "SELECT file, 2 FROM (" + _missing("gpkg_tile_matrix_set", _COLUMNS["gpkg_tile_matrix_set"]) + ") WHERE file IN (SELECT file FROM tiled)",
        "SELECT file, 2 FROM matrix GROUP BY file, table_name HAVING max(zoom_level) - min(zoom_level) + 1 > count(DISTINCT zoom_level)",
    ],
    26: [
        "SELECT s.file, 2 FROM sets s WHERE NOT EXISTS (SELECT 1 FROM schema x WHERE x.file = s.file AND x.table_name = s.table_name)", "SELECT file, 1 FROM sets WHERE file NOT IN (SELECT file FROM heads)",
        f"SELECT h.file, {_LEVEL.format("format IN ('WEBP', 'UNKNOWN') OR width <> 256 OR height <> 256 OR width <> tile_width OR height <> tile_height")} FROM heads h LEFT JOIN matrix m USING (file, table_name, zoom_level)",
    ],
    27: [f"SELECT file, {_LEVEL.format('abs(pixel_x_size / px - 0.5) > 1e-4')} FROM steps WHERE px <> 0"],
    28: [f"SELECT file, {_LEVEL.format('pixel_x_size >= px OR pixel_y_size >= py')} FROM steps"],
    29: ["SELECT file, CASE WHEN count(DISTINCT (tile_width, tile_height)) > 1 THEN 2 ELSE 0 END FROM matrix GROUP BY file, table_name"],
    30: [f"""SELECT t.file, CASE WHEN s.min_x IS NULL OR s.min_y IS NULL OR s.max_x IS NULL OR s.max_y IS NULL OR s.min_x >= s.max_x OR s.min_y >= s.max_y OR coalesce({_OUT}, false) THEN 2 ELSE 0 END
        FROM sets t JOIN contents s USING (file, table_name) LEFT JOIN {_EXTENT} ON e.srs_id = t.srs_id"""],
    **{
        req: [
            f"SELECT file, 2 FROM files WHERE file NOT IN {_HAS.format('gpkg_metadata_reference')}",
            f"SELECT file, 2 FROM contents c WHERE data_type = '{kind}' AND file IN {_HAS.format('gpkg_metadata_reference')} AND NOT EXISTS (SELECT 1 FROM reference r WHERE r.file = c.file AND r.table_name = c.table_name AND reference_scope = 'table')",
            f"SELECT f.file, 1 FROM files f WHERE NOT EXISTS (SELECT 1 FROM linked l WHERE l.file = f.file AND md_scope IN {scopes})", f"SELECT file, {_LEVEL.format(bad)} FROM linked WHERE md_scope IN {scopes}", *more,
        ]
        for req, kind, scopes, bad, more in (
            (31, "tiles", "('model', 'tile')", "NOT fine OR barren OR md_standard_uri = ''", []),
            (32, "features", "('featureType', 'feature')", "NOT fine OR barren", [f"SELECT file, 2 FROM {_HAS.format('gpkg_metadata')} WHERE file NOT IN (SELECT file FROM metadata WHERE mime_type = 'text/xml')"]),
        )
    },
    33: [
        f"SELECT file, CASE WHEN file IN (SELECT file FROM extensions WHERE extension_name = 'gpkg_2d_gridded_coverage') AND file IN {_HAS.format('gpkg_2d_gridded_tile_ancillary')} THEN 0 ELSE 2 END FROM {_HAS.format('gpkg_2d_gridded_coverage_ancillary')}",
        "SELECT file, 2 FROM (" + _missing("gpkg_2d_gridded_coverage_ancillary", _COLUMNS["gpkg_2d_gridded_coverage_ancillary"]) + ")",
    ],
    34: ["SELECT file, CASE WHEN coalesce(lower(field_name) IN ('height', 'elevation'), false) THEN 0 ELSE 2 END FROM coverage WHERE lower(quantity_definition) LIKE '%elevation%' OR lower(quantity_definition) LIKE '%height%'"],
    35: ["SELECT file, CASE WHEN coalesce(grid_cell_encoding = 'grid-value-is-center', false) THEN 0 ELSE 2 END FROM coverage WHERE lower(quantity_definition) LIKE '%elevation%' OR lower(quantity_definition) LIKE '%height%'"],
    36: [
        "SELECT file, 0 FROM coverage",
        f"SELECT file, {_LEVEL.format('abs(CASE WHEN pixel_x_size = 0 THEN 0 ELSE px / pixel_x_size END - 2) > 0.01 OR abs(CASE WHEN pixel_y_size = 0 THEN 0 ELSE py / pixel_y_size END - 2) > 0.01')} FROM steps JOIN coverage USING (file, table_name)",
    ],
    37: [f"SELECT l.file, {_LEVEL.format('NOT fine OR barren')} FROM linked l WHERE file IN (SELECT file FROM coverage) AND (reference_scope = 'geopackage' OR EXISTS (SELECT 1 FROM coverage v WHERE v.file = l.file AND v.table_name = l.table_name))"],
}

_SHARED = f"""
cats AS (SELECT DISTINCT file, {_CATS} AS category FROM contents WHERE data_type <> 'attributes'),
tiled AS (SELECT DISTINCT file FROM cats WHERE category IN ('tiles', 'gridded')),
used AS (SELECT *, coalesce({_KNOWN.format('definition_12_063')}, {_KNOWN.format('definition')}) AS wkt FROM srs WHERE srs_id > 0),
compounds AS (SELECT *, upper(wkt) NOT LIKE '%COMPOUNDCRS[%' OR NOT (upper(wkt) LIKE '%GEOGCRS[%' OR upper(wkt) LIKE '%PROJCRS[%') OR upper(wkt) NOT LIKE '%VERTCRS[%VDATUM[%' OR regexp_matches(wkt, '^\\s*(GEOGCS|PROJCS|VERT_CS|COMPD_CS|GEOCCS)\\[') AS broken
              FROM used WHERE {_COMPOUND.format('wkt')}),
grids AS (SELECT s.*, definition, s.srs_id = 4979 OR coalesce({_COMPOUND.format('definition')}, false) AS three FROM sets s JOIN contents c USING (file, table_name) LEFT JOIN srs d ON d.file = s.file AND d.srs_id = s.srs_id WHERE data_type = '2d-gridded-coverage'),
steps AS (SELECT * FROM (SELECT *, lag(pixel_x_size) OVER w AS px, lag(pixel_y_size) OVER w AS py, lag(zoom_level) OVER w AS zb FROM matrix WINDOW w AS (PARTITION BY file, table_name ORDER BY zoom_level)) WHERE zb IS NOT NULL),
firsts AS (SELECT file, table_name, srs_id, pz0, arg_min(pixel_x_size, zoom_level) AS fp, min(zoom_level) AS fz FROM matrix JOIN sets USING (file, table_name) JOIN {_PZ} USING (srs_id) GROUP BY file, table_name, srs_id, pz0),
nearest AS (SELECT file, table_name, arg_min(z, e) AS zz, min(e) AS e FROM (SELECT *, abs(fp - pz0 / pow(2.0, z)) / (pz0 / pow(2.0, z)) AS e FROM firsts, generate_series(0, 29) g(z)) GROUP BY file, table_name),
offs AS (SELECT file, table_name, bool_or(e > 0.5 OR abs(pixel_x_size - ex) / ex > 1e-4 OR srs_id <> 4326 AND abs(pixel_y_size - ex) / ex > 1e-4) AS wrong
         FROM (SELECT m.*, f.srs_id, e, pz0 / pow(2.0, zoom_level - fz + zz) AS ex FROM matrix m JOIN firsts f USING (file, table_name) JOIN nearest USING (file, table_name)) GROUP BY file, table_name),
docs AS (SELECT *, md_standard_uri LIKE '%dgiwg%dmf%' AS dmf, metadata LIKE '%/-3/%' AND metadata LIKE '%</gmd:MD_Metadata>' AS later, metadata <> '<x/>' AND metadata NOT LIKE '%</gmd:MD_Metadata>' AS malformed, metadata NOT LIKE '%</gmd:MD_Metadata>' AS barren FROM metadata),
linked AS (SELECT r.file, r.reference_scope, r.table_name, r.timestamp, d.md_scope, d.md_standard_uri, d.barren, p.md_scope IS NOT NULL AS fine
           FROM reference r JOIN docs d ON d.file = r.file AND d.id = r.md_file_id LEFT JOIN {_SCOPES} ON p.reference_scope = r.reference_scope AND p.md_scope = d.md_scope),
orphans AS (SELECT file FROM reference r WHERE NOT EXISTS (SELECT 1 FROM metadata m WHERE m.file = r.file AND m.id = r.md_file_id)),
anchored AS (SELECT file, EXISTS (SELECT 1 FROM reference r WHERE r.file = f.file AND reference_scope = 'geopackage' AND table_name IS NULL AND column_name IS NULL AND row_id_value IS NULL) AS anchored FROM files f),
"""


def sql(body: str) -> str:
    """DuckDB SQL over the views and the tables that rules share."""
    views = ",\n".join(f"{name} AS ({text.format(customer='customer').replace(' AS STRING', ' AS VARCHAR')})" for name, text in VIEWS.items())
    return f"WITH {views},{_SHARED.rstrip().rstrip(',')}\n{body}"


def findings_sql() -> str:
    """DuckDB SQL of the status of every file and requirement, from the same views."""
    rows = "\nUNION ALL ".join(f"SELECT file, {req} AS req, level FROM ({select}) AS e(file, level)" + (" WHERE file IN (SELECT file FROM cats)" if req in (3, 4, 5) else "") for req, selects in _EVIDENCE.items() for select in selects)
    return sql(f""", evidence AS ({rows}),
worst AS (SELECT file, req, max(level) AS level FROM evidence GROUP BY file, req)
SELECT f.file, g.req::INT AS req, CASE WHEN damage IS NOT NULL AND g.req NOT IN (1, 2, 6) THEN 'ERROR' WHEN level = 2 THEN 'FAIL' WHEN level = 1 THEN 'PASS*' WHEN level = 0 THEN CASE WHEN g.req IN {_in(dims.BEST_IS_PARTIAL)} THEN 'PASS*' ELSE 'PASS' END ELSE 'SKIPPED' END AS status
FROM files f CROSS JOIN generate_series(1, 37) g(req) LEFT JOIN worst w ON w.file = f.file AND w.req = g.req""")
