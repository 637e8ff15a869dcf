"""The library's queries and their DuckDB SQL, over catalog-shaped views of the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dims, validation_views
from .adapters import WKT, Views, sql
from .functions import binary, crs, text, wkt
from .operators import catalog, maintenance, scorers, scoring, zoom

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        _QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if oracle:
            _SQL[name] = sql(oracle)
        return f

    return add


def findings_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of all requirements of every file of the validation views."""
    from .plans.validate import findings, scratch_folder

    folder = scratch_folder(spark, "findings")
    catalog = validation_views.catalog_of(spark, sf_dir).written(f"{folder}/catalog")
    return findings(catalog, validation_views.AS_OF, folder=f"{folder}/evidence").select("file", "req", "status")


_QUERIES["findings"], _SQL["findings"] = findings_of, validation_views.findings_sql()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _in(codes) -> str:
    return "(" + ", ".join(map(str, codes)) + ")"


_W = "PARTITION BY file, table_name ORDER BY zoom_level"
_PZ = "(VALUES " + ", ".join(f"({k}, {v!r}::DOUBLE)" for k, v in dims.PIXEL_Z0.items()) + ") AS p(srs_id, pz0)"
_EXT = "(VALUES " + ", ".join(f"({k}, {', '.join(f'{x!r}::DOUBLE' for x in v)})" for k, v in dims.EXTENT.items()) + ") AS e(srs_id, a, b, c, d)"
_RULES = "(VALUES " + ", ".join(f"('{e}', '{c}', '{u}')" for e, uses in dims.EXTENSIONS.items() for c, u in zip(dims.CATEGORIES, uses)) + ") AS r(rule, category, use)"
_PAIRS = "(VALUES " + ", ".join(f"('{r}', '{m}')" for r, ms in dims.SCOPES.items() for m in ms) + ") AS p(reference_scope, md_scope)"
_CAT = "CASE WHEN lower(data_type) = 'features' THEN 'features' WHEN lower(data_type) = 'tiles' THEN 'tiles' WHEN lower(data_type) LIKE '%gridded%' OR lower(data_type) LIKE '%coverage%' THEN 'gridded' END"
_LCC = "regexp_matches(upper(translate(coalesce(definition, ''), '_', ' ')), 'LAMBERT (CONFORMAL CONIC|CONIC CONFORMAL)')"


# Tile pyramids


@query("zoom_factor", f"""WITH s AS (SELECT *, lag(pixel_x_size) OVER ({_W}) AS b FROM matrix), r AS (SELECT *, CASE WHEN b <> 0 THEN pixel_x_size / b END AS ratio FROM s)
SELECT file, table_name, count(ratio) AS n_steps, count(*) FILTER (abs(ratio - 0.5) > 1e-4) AS n_bad,
CASE WHEN count(*) FILTER (abs(ratio - 0.5) > 1e-4) > 0 THEN 'FAIL' WHEN count(ratio) > 0 THEN 'PASS' ELSE 'SKIPPED' END AS status FROM r GROUP BY file, table_name""")  # fmt: skip
def _(v):
    return zoom.zoom_factor(v.matrix)


@query("zoom_factor_gridded", f"""WITH s AS (SELECT *, lag(pixel_x_size) OVER ({_W}) AS b, lag(zoom_level) OVER ({_W}) AS z FROM matrix),
r AS (SELECT *, round(CASE WHEN pixel_x_size = 0 THEN 0 ELSE b / pixel_x_size END, 4) AS factor FROM s WHERE z IS NOT NULL)
SELECT file, table_name, count(*) AS n_steps, count(*) FILTER (abs(factor - 2) <= 0.01) AS confirmed, min(factor) AS min_factor, max(factor) AS max_factor FROM r GROUP BY file, table_name""")  # fmt: skip
def _(v):
    return zoom.gridded_zoom_factor(v.matrix)


@query("zoom_monotone", f"""WITH s AS (SELECT *, lag(pixel_x_size) OVER ({_W}) AS bx, lag(pixel_y_size) OVER ({_W}) AS by_ FROM matrix),
r AS (SELECT file, table_name, count(*) AS n_levels, count(*) FILTER (pixel_x_size >= bx OR pixel_y_size >= by_) AS n_wrong FROM s GROUP BY file, table_name HAVING count(*) > 1)
SELECT *, CASE WHEN n_wrong > 0 THEN 'FAIL' ELSE 'PASS*' END AS status FROM r""")  # fmt: skip
def _(v):
    return zoom.zoom_monotone(v.matrix)


@query("zoom_gaps", """WITH r AS (SELECT file, table_name, min(zoom_level) AS low, max(zoom_level) AS high, list(DISTINCT zoom_level) AS z FROM matrix GROUP BY file, table_name),
g AS (SELECT *, list_filter(generate_series(low, high), lambda x: NOT list_contains(z, x)) AS gap FROM r)
SELECT file, table_name, low, high, len(gap)::BIGINT AS n_gaps, array_to_string(gap, ',') AS gaps FROM g""")  # fmt: skip
def _(v):
    return zoom.zoom_gaps(v.matrix)


@query("zoom_offset_match", f"""WITH j AS (SELECT m.*, s.srs_id, pz0, first_value(pixel_x_size) OVER (PARTITION BY m.file, m.table_name ORDER BY zoom_level) AS fp, first_value(zoom_level) OVER (PARTITION BY m.file, m.table_name ORDER BY zoom_level) AS fz
 FROM matrix m JOIN sets s USING (file, table_name) JOIN {_PZ} USING (srs_id)),
f AS (SELECT DISTINCT file, table_name, fp, pz0 FROM j),
o AS (SELECT file, table_name, arg_min(z, e ORDER BY e, z) AS zz, min(e) AS e FROM (SELECT *, abs(fp - pz0 / pow(2.0, z)) / (pz0 / pow(2.0, z)) AS e FROM f, generate_series(0, 29) g(z)) GROUP BY file, table_name),
x AS (SELECT j.*, o.zz, o.e, pz0 / pow(2.0, zoom_level - fz + zz) AS ex FROM j JOIN o USING (file, table_name))
SELECT file, table_name, srs_id, min(zz)::INT AS "offset", count(*) AS n_levels, count(*) FILTER (e > 0.5 OR abs(pixel_x_size - ex) / ex > 1e-4 OR (srs_id <> 4326 AND abs(pixel_y_size - ex) / ex > 1e-4)) AS n_wrong FROM x GROUP BY file, table_name, srs_id""".replace(", e ORDER BY e, z)", ", e)"))  # fmt: skip
def _(v):
    return zoom.zoom_offset(v.matrix, v.sets)


@query("grid_alignment", f"""WITH j AS (SELECT m.*, pz0 FROM matrix m JOIN sets s USING (file, table_name) JOIN {_PZ} USING (srs_id)),
r AS (SELECT file, table_name, zoom_level, bool_or(abs(pixel_x_size - pz0 / pow(2.0, z)) / (pz0 / pow(2.0, z)) <= 1e-4) AS near FROM j, generate_series(0, 24) g(z) GROUP BY file, table_name, zoom_level)
SELECT file, table_name, count(*) AS total, count(*) FILTER (near) AS confirmed, bool_and(near) AS aligned FROM r GROUP BY file, table_name""")  # fmt: skip
def _(v):
    return zoom.grid_aligned(v.matrix, v.sets)


@query("tile_size", """WITH r AS (SELECT file, table_name, count(*) AS n_levels, count(*) FILTER (tile_width <> 256 OR tile_height <> 256) AS n_odd, count(DISTINCT (tile_width, tile_height)) AS n_sizes FROM matrix GROUP BY file, table_name)
SELECT *, CASE WHEN n_sizes > 1 THEN 'FAIL' ELSE 'PASS*' END AS uniform FROM r""")  # fmt: skip
def _(v):
    return zoom.tile_size(v.matrix)


@query("tile_density", """WITH r AS (SELECT file, table_name, zoom_level, count(*) AS n_tiles FROM tiles GROUP BY file, table_name, zoom_level), p AS (SELECT *, round(100 * n_tiles / pow(4.0, zoom_level), 6) AS percent FROM r)
SELECT *, percent < 1 AS sparse FROM p""")  # fmt: skip
def _(v):
    return zoom.tile_density(v.tiles)


@query("empty_zooms", "SELECT file, table_name, zoom_level FROM matrix m WHERE NOT EXISTS (SELECT 1 FROM tiles t WHERE t.file = m.file AND t.table_name = m.table_name AND t.zoom_level = m.zoom_level)")
def _(v):
    return zoom.empty_zooms(v.matrix, v.tiles)


@query("several_zooms", "SELECT file, table_name, count(DISTINCT zoom_level) AS n_zooms, min(zoom_level) AS low, max(zoom_level) AS high, count(*) AS n_tiles FROM tiles GROUP BY file, table_name HAVING count(DISTINCT zoom_level) >= 2")
def _(v):
    return zoom.several_zooms(v.tiles)


@query("bbox_in_crs_extent", f"""SELECT s.file, s.table_name, s.srs_id, CASE WHEN c.min_x IS NULL OR c.min_y IS NULL OR c.max_x IS NULL OR c.max_y IS NULL THEN 'null' WHEN c.min_x >= c.max_x OR c.min_y >= c.max_y THEN 'order' WHEN a IS NULL THEN 'unknown system'
 WHEN c.min_x < a - abs(e.c - a) * 0.001 OR c.max_x > e.c + abs(e.c - a) * 0.001 OR c.min_y < b - abs(d - b) * 0.001 OR c.max_y > d + abs(d - b) * 0.001 THEN 'outside' ELSE 'ok' END AS problem
FROM sets s JOIN contents c USING (file, table_name) LEFT JOIN {_EXT} ON e.srs_id = s.srs_id""")  # fmt: skip
def _(v):
    return zoom.bbox_in_extent(v.contents, v.sets)


@query("bbox_within_matrix_set", "SELECT file, count(*) AS total, count(*) FILTER (c.min_x >= s.min_x AND c.min_y >= s.min_y AND c.max_x <= s.max_x AND c.max_y <= s.max_y) AS confirmed FROM contents c JOIN sets s USING (file, table_name) GROUP BY file")
def _(v):
    return zoom.bbox_within_set(v.contents, v.sets)


@query("overview_levels", """SELECT p_partkey, array_to_string(CASE WHEN len(f) > 0 THEN f ELSE [2] END, ',') AS factors FROM
(SELECT p_partkey, list_filter([2, 4, 8, 16, 32, 64, 128, 256], lambda x: greatest(p_size * 300, p_partkey) // x > 256) AS f FROM part)""")  # fmt: skip
def _(v):
    return v.part.select("p_partkey", F.array_join(zoom.overview_levels(F.col("p_size") * 300, F.col("p_partkey")).cast("array<string>"), ",").alias("factors"))


# Coordinate systems


def _vector_sql(z: bool, kind: str) -> str:
    bad = f"srs_id NOT IN {_in(dims.VALIDATE[kind])}"
    return f"""WITH l AS (SELECT * FROM geometry_columns WHERE {'z <> 0' if z else 'z = 0'}), r AS (SELECT file, count(*) AS n_layers, count(*) FILTER ({bad}) AS n_bad, list_sort(list(DISTINCT srs_id) FILTER ({bad})) AS b FROM l GROUP BY file)
SELECT file, n_layers, n_bad, coalesce(array_to_string(b[1:5], ','), '') AS bad_systems, CASE WHEN n_bad > 0 THEN 'FAIL' ELSE 'PASS*' END AS status FROM r"""


@query("vector_crs_2d", _vector_sql(False, "vector_2d"))
def _(v):
    return catalog.vector_crs(v.geometry_columns, v.srs, z=False)


@query("vector_crs_3d", _vector_sql(True, "vector_3d"))
def _(v):
    return catalog.vector_crs(v.geometry_columns, v.srs, z=True)


@query("raster_crs", f"""WITH r AS (SELECT s.file, s.srs_id IN {_in(dims.VALIDATE['raster'])} OR {_LCC} AS ok FROM sets s JOIN contents c USING (file, table_name) LEFT JOIN srs d ON d.file = s.file AND d.srs_id = s.srs_id WHERE c.data_type = 'tiles')
SELECT file, count(*) AS n_tables, count(*) FILTER (NOT ok) AS n_bad, CASE WHEN count(*) FILTER (NOT ok) > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM r GROUP BY file""")  # fmt: skip
def _(v):
    return catalog.raster_crs(v.sets, v.contents, v.srs)


_THREE = "s.srs_id = 4979 OR coalesce(regexp_matches(upper(definition), 'COMPOUNDCRS|COMPD_CS'), false)"


@query(
    "gridded_crs",
    f"""WITH r AS (SELECT s.file, s.srs_id, {_THREE} AS three
      FROM sets s JOIN contents c USING (file, table_name) LEFT JOIN srs d ON d.file = s.file AND d.srs_id = s.srs_id WHERE ({_CAT}) = 'gridded')
    SELECT file, CASE WHEN three THEN 3 ELSE 2 END AS dimension, count(*) AS n_tables, count(*) FILTER (NOT three AND srs_id NOT IN {_in(dims.VALIDATE['gridded_2d'])}) AS n_bad FROM r GROUP BY file, three""",
)
def _(v):
    return catalog.gridded_crs(v.sets, v.contents, v.srs)


_EPSG_OF = r"""TRY_CAST(list_concat(regexp_extract_all({0}, 'AUTHORITY\["EPSG",\s*"?(\d+)"?\]', 1), regexp_extract_all({0}, 'ID\["EPSG",\s*(\d+)\]', 1))[-1] AS INT)"""
_DATUM_OF = r"""coalesce(nullif(regexp_extract({0}, '(?i)DATUM\["([^"]+)"', 1), ''), nullif(regexp_extract({0}, '(?i)ENSEMBLE\["([^"]+)"', 1), ''))"""
_AXES_OF = r"""array_to_string(list_transform(regexp_extract_all({0}, 'AXIS\["[^"]*",\s*([A-Za-z]+)\]', 1), lambda x: upper(x)), ',')"""


@query(
    "definition_facts",
    rf"""SELECT file, srs_id, {_EPSG_OF.format('definition')} AS epsg, {_AXES_OF.format('definition')} AS axes, {_DATUM_OF.format('definition')} AS datum,
      TRY_CAST(nullif(regexp_extract(definition, '(?i)dynamic *\[ *frameepoch *\[ *([0-9.]+)', 1), '') AS DOUBLE) AS epoch, regexp_matches(definition, '^\s*(GEOGCS|PROJCS|VERT_CS|COMPD_CS|GEOCCS)\[') AS wkt1 FROM srs""",
)
def _(v):
    d = F.col("definition")
    return v.srs.select("file", "srs_id", text.last_epsg(d).alias("epsg"), text.axis_directions(d).alias("axes"), text.datum_name(d).alias("datum"), text.frame_epoch(d).alias("epoch"), text.is_wkt1(d).alias("wkt1"))


_WKT1 = r"regexp_matches(definition, '^\s*(GEOGCS|PROJCS|VERT_CS|COMPD_CS|GEOCCS)\[')"


@query(
    "definition_problems",
    rf"""WITH d AS (SELECT file, srs_id, definition AS w, upper(definition) AS u, {_DATUM_OF.format('definition')} AS datum, {_AXES_OF.format('definition')} AS axes FROM srs WHERE srs_id > 0)
    SELECT file, srs_id, array_to_string(list_filter([CASE WHEN w IN ('', 'undefined') THEN 'no definition' END, CASE WHEN regexp_matches(u, '(GEOGCS|PROJCS|COMPD_CS)\[') THEN 'WKT1' END,
      CASE WHEN u LIKE '%PRIMEM%' AND u NOT LIKE '%GREENWICH%' THEN 'prime meridian' END, CASE WHEN u LIKE '%ANGLEUNIT%' AND u NOT LIKE '%DEGREE%' THEN 'no degree unit' END,
      CASE WHEN regexp_matches(u, '(GEOGCRS|GEOGCS|GEODCRS|GEODETICCRS)\[') AND axes LIKE 'EAST,NORTH%' THEN 'axis order' END, CASE WHEN w <> '' AND datum IS NULL THEN 'no datum' END,
      CASE WHEN upper(replace(datum, '_', ' ')) NOT IN {_in(map(repr, dims.WGS84_NAMES))} AND srs_id NOT BETWEEN 100100 AND 100399 THEN 'other datum' END], lambda x: x IS NOT NULL), ',') AS problems FROM d""",
)
def _(v):
    return v.srs.filter("srs_id > 0").select("file", "srs_id", text.definition_problems(F.col("definition"), F.col("srs_id")).alias("problems"))


@query("compound_structure", rf"""SELECT file, srs_id, array_to_string(list_filter([CASE WHEN NOT contains(upper(definition), 'COMPOUNDCRS[') THEN 'not compound' END, CASE WHEN NOT (contains(upper(definition), 'GEOGCRS[') OR contains(upper(definition), 'PROJCRS[')) THEN 'no horizontal part' END,
CASE WHEN NOT contains(upper(definition), 'VERTCRS[') THEN 'no vertical part' END, CASE WHEN NOT regexp_matches(upper(definition), '(?s)VERTCRS\[.*VDATUM\[') THEN 'no vertical datum' END, CASE WHEN {_WKT1} THEN 'WKT1' END], lambda x: x IS NOT NULL), ',') AS problems FROM srs WHERE regexp_matches(upper(definition), 'COMPOUNDCRS|COMPD_CS')""")  # fmt: skip
def _(v):
    return v.srs.filter(F.upper("definition").rlike("COMPOUNDCRS|COMPD_CS")).select("file", "srs_id", text.compound_problems(F.col("definition")).alias("problems"))


@query(
    "definition_structure",
    rf"""WITH d AS (SELECT file, srs_id, definition AS w, CASE WHEN regexp_matches(definition, '^GEOGC') THEN 'geographic' WHEN regexp_matches(definition, '^PROJC') THEN 'projected' WHEN regexp_matches(definition, '^COMP') THEN 'compound' END AS k,
      list_transform(regexp_extract_all(definition, 'AXIS\["[^"]*",\s*([A-Za-z]+)\]', 1), lambda x: lower(x)) AS ax, TRY_CAST(nullif(regexp_extract(definition, ',CS\[\w+,(\d)\]', 1), '') AS INTEGER) AS cs,
      TRY_CAST(nullif(regexp_extract(definition, '(ID|AUTHORITY)\["EPSG",\s*"?(\d+)"?\]\]$', 2), '') AS INTEGER) AS code, contains(definition, 'METHOD[') OR contains(definition, 'PROJECTION[') AS how FROM srs WHERE srs_id > 0),
    e AS (SELECT *, coalesce(nullif(greatest(len(ax), coalesce(cs, 0)), 0), CASE k WHEN 'compound' THEN 3 ELSE 2 END) AS m FROM d LEFT JOIN {validation_views.REGISTRY} USING (srs_id))
    SELECT file, srs_id, CASE WHEN kind IS NOT NULL AND w NOT IN ('', 'undefined') THEN array_to_string(list_filter([CASE WHEN code <> srs_id THEN 'code' END, CASE WHEN k <> kind THEN 'kind' END, CASE WHEN m <> n THEN 'axes' END,
      CASE WHEN m = n AND len(ax) > 0 AND array_to_string(ax, ',') <> axes THEN 'axis order' END, CASE WHEN method IS NOT NULL AND NOT how THEN 'method' END], lambda x: x IS NOT NULL), ',') END AS problems FROM e""",
)
def _(v):
    return v.srs.filter("srs_id > 0").select("file", "srs_id", wkt.structure_problems(F.col("definition"), F.col("srs_id")).alias("problems"))


_LON, _LAT = "lon", "lat"


@query("project_mercator", f"SELECT fid, round(radians(lon) * {dims.WGS84_A}, 3) AS x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * {dims.WGS84_A}, 3) AS y FROM features")
def _(v):
    x, y = crs.mercator(F.col("lon"), F.col("lat"))
    return v.features.select("fid", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query("unproject_mercator", f"SELECT fid, round(degrees(lon * 1e5 / {dims.WGS84_A}), 6) AS lon, round(degrees(2 * atan(exp(lat * 1e5 / {dims.WGS84_A})) - pi() / 2), 6) AS lat FROM features")
def _(v):
    lon, lat = crs.mercator_inverse(F.col("lon") * 1e5, F.col("lat") * 1e5)
    return v.features.select("fid", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query("project_world_mercator", f"SELECT fid, round(radians(lon) * {dims.WGS84_A}, 3) AS x, round((ln(tan(pi() / 4 + radians(lat) / 2)) - {crs.E!r} / 2 * ln((1 + {crs.E!r} * sin(radians(lat))) / (1 - {crs.E!r} * sin(radians(lat))))) * {dims.WGS84_A}, 3) AS y FROM features")
def _(v):
    x, y = crs.world_mercator(F.col("lon"), F.col("lat"))
    return v.features.select("fid", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


_SERIES_X = " + ".join(f"{a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(crs.ALPHA, 1))
_SERIES_Y = " + ".join(f"{a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(crs.ALPHA, 1))


@query("project_utm", f"""WITH p AS (SELECT fid, lat, radians(lat) AS phi, least(60, floor((lon + 180) / 6)::INT + 1) AS zone, lon FROM features),
t AS (SELECT fid, lat, zone, radians(lon - (zone * 6 - 183)) AS dl, sinh(atanh(sin(phi)) - {crs.E!r} * atanh({crs.E!r} * sin(phi))) AS t FROM p),
s AS (SELECT fid, lat, zone, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta FROM t)
SELECT fid, zone, round({crs.UTM_SCALE * crs.RADIUS!r} * (eta + {_SERIES_X}) + 500000, 3) AS x, round({crs.UTM_SCALE * crs.RADIUS!r} * (xi + {_SERIES_Y}) + CASE WHEN lat < 0 THEN 10000000 ELSE 0 END, 3) AS y FROM s""")  # fmt: skip
def _(v):
    zone = crs.utm_zone(F.col("lon"))
    x, y = crs.utm(F.col("lon"), F.col("lat"), F.col("zone"), F.col("lat") < 0)
    return v.features.withColumn("zone", zone).select("fid", "zone", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


_UPS = 2 * crs.A * crs.UPS_SCALE / ((1 + crs.E) ** (1 + crs.E) * (1 - crs.E) ** (1 - crs.E)) ** 0.5


@query("project_ups", f"""WITH p AS (SELECT fid, lat, radians(lon) AS lam, radians(abs(lat)) AS phi FROM features WHERE abs(lat) > 60),
r AS (SELECT *, {_UPS!r} * tan(pi() / 4 - phi / 2) / pow((1 - {crs.E!r} * sin(phi)) / (1 + {crs.E!r} * sin(phi)), {crs.E / 2!r}) AS rho FROM p)
SELECT fid, round(sin(lam) * rho + 2000000, 3) AS x, round(CASE WHEN lat < 0 THEN cos(lam) * rho ELSE -cos(lam) * rho END + 2000000, 3) AS y FROM r""")  # fmt: skip
def _(v):
    x, y = crs.ups(F.col("lon"), F.col("lat"), F.col("lat") < 0)
    return v.features.filter("abs(lat) > 60").select("fid", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


# Extensions, references, validity


@query("missing_extensions", f"""WITH c AS (SELECT DISTINCT file, {_CAT} AS category FROM contents), n AS (SELECT DISTINCT file, rule AS extension_name FROM c JOIN {_RULES} USING (category) WHERE use = 'M')
SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM extensions x WHERE x.file = n.file AND x.extension_name = n.extension_name)""")  # fmt: skip
def _(v):
    return catalog.missing_extensions(v.contents, v.extensions)


def _use_sql(use: str) -> str:
    return f"""WITH c AS (SELECT DISTINCT file, {_CAT} AS category FROM contents)
SELECT DISTINCT x.file, x.extension_name, c.category FROM extensions x JOIN {_RULES} ON x.extension_name = rule OR (rule LIKE '%\\_' ESCAPE '\\' AND starts_with(x.extension_name, rule)) JOIN c ON c.file = x.file AND c.category = r.category WHERE use = '{use}'"""


@query("extensions_not_allowed", _use_sql("N"))
def _(v):
    return catalog.registered_with_use(v.contents, v.extensions, "N")


@query("extensions_optional", _use_sql("O"))
def _(v):
    return catalog.registered_with_use(v.contents, v.extensions, "O")


@query("extension_scopes", "SELECT file, count(*) AS n_bad FROM extensions WHERE scope NOT IN ('read-write', 'write-only') GROUP BY file")
def _(v):
    return catalog.bad_scopes(v.extensions)


@query("last_change", r"""SELECT file, table_name, CASE WHEN last_change IS NULL OR NOT regexp_matches(last_change, '^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$') THEN 'malformed' WHEN last_change > '2026-01-01T00:00:00Z' THEN 'future' ELSE 'ok' END AS problem FROM contents""")
def _(v):
    return v.contents.select("file", "table_name", catalog.timestamp_problem(F.col("last_change"), "2026-01-01T00:00:00Z").alias("problem"))


@query("undeclared_tables", "SELECT DISTINCT file, table_name FROM schema s WHERE NOT regexp_matches(lower(table_name), '^(gpkg_|rtree_|sqlite_)') AND NOT EXISTS (SELECT 1 FROM contents c WHERE c.file = s.file AND c.table_name = s.table_name)")
def _(v):
    return catalog.undeclared_tables(v.schema, v.contents)


@query("orphan_references", "SELECT file, count(*) AS n_orphans FROM reference r WHERE NOT EXISTS (SELECT 1 FROM metadata m WHERE m.file = r.file AND m.id = r.md_file_id) GROUP BY file")
def _(v):
    return catalog.orphan_references(v.reference, v.metadata)


@query("unreferenced_metadata", "SELECT file, id FROM metadata m WHERE NOT EXISTS (SELECT 1 FROM reference r WHERE r.file = m.file AND r.md_file_id = m.id)")
def _(v):
    return catalog.unreferenced_metadata(v.metadata, v.reference)


@query("parents_resolve", "SELECT r.file, count(*) AS total, count(m.id) AS confirmed FROM reference r LEFT JOIN metadata m ON m.file = r.file AND m.id = r.md_parent_id WHERE md_parent_id IS NOT NULL GROUP BY r.file")
def _(v):
    return catalog.parents_resolve(v.reference, v.metadata)


@query("scope_violations", f"""SELECT r.file, r.reference_scope, m.md_scope, count(*) AS n_bad FROM reference r JOIN metadata m ON m.file = r.file AND m.id = r.md_file_id
LEFT JOIN {_PAIRS} ON p.reference_scope = r.reference_scope AND p.md_scope = m.md_scope WHERE p.md_scope IS NULL GROUP BY 1, 2, 3""")  # fmt: skip
def _(v):
    return catalog.scope_violations(v.reference, v.metadata)


@query("unlinked_tile_layers", "SELECT file, table_name FROM contents c WHERE data_type = 'tiles' AND NOT EXISTS (SELECT 1 FROM reference r WHERE r.file = c.file AND r.table_name = c.table_name AND r.reference_scope = 'table')")
def _(v):
    return catalog.unlinked_layers(v.contents, v.reference, "tiles")


@query("unlinked_feature_layers", "SELECT file, table_name FROM contents c WHERE data_type = 'features' AND NOT EXISTS (SELECT 1 FROM reference r WHERE r.file = c.file AND r.table_name = c.table_name AND r.reference_scope = 'table')")
def _(v):
    return catalog.unlinked_layers(v.contents, v.reference, "features")


@query("anchors", """WITH r AS (SELECT file, count(*) FILTER (reference_scope = 'geopackage' AND table_name IS NULL AND column_name IS NULL AND row_id_value IS NULL) AS n_anchors FROM reference GROUP BY file)
SELECT *, CASE WHEN n_anchors > 0 THEN 'PASS*' ELSE 'FAIL' END AS status FROM r""")  # fmt: skip
def _(v):
    return catalog.anchors(v.reference)


_ROW_COLUMNS = ["reference_scope", "table_name", "md_file_id", "md_parent_id"]


@query("row_metadata_columns", f"""WITH n AS (SELECT DISTINCT file, c AS column_name FROM schema, (VALUES {', '.join(f"('{c}')" for c in _ROW_COLUMNS)}) AS x(c) WHERE table_name = 'gpkg_metadata_reference')
SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM schema s WHERE s.file = n.file AND s.table_name = 'gpkg_metadata_reference' AND s.column_name = n.column_name)""")  # fmt: skip
def _(v):
    return catalog.missing_columns(v.schema, "gpkg_metadata_reference", _ROW_COLUMNS)


@query("index_health", """WITH a AS (SELECT file, table_name, count(geom) AS g FROM features GROUP BY file, table_name), b AS (SELECT file, table_name, count(*) AS e FROM entries GROUP BY file, table_name),
j AS (SELECT file, table_name, coalesce(g, 0) AS n_geometries, coalesce(e, 0) AS n_entries FROM a FULL JOIN b USING (file, table_name))
SELECT *, n_entries - n_geometries AS diff, CASE WHEN n_entries > n_geometries THEN 'zombie' WHEN n_entries < n_geometries THEN 'missing' ELSE 'ok' END AS health FROM j""")  # fmt: skip
def _(v):
    return catalog.index_health(v.features, v.entries)


@query("layer_extent", "SELECT file, table_name, min(minx) AS min_x, min(miny) AS min_y, max(maxx) AS max_x, max(maxy) AS max_y, count(*) AS n FROM entries GROUP BY file, table_name")
def _(v):
    return catalog.layer_extent(v.entries)


@query("extent_mismatch", """WITH e AS (SELECT file, table_name, min(minx) AS a, min(miny) AS b, max(maxx) AS c, max(maxy) AS d FROM entries GROUP BY file, table_name)
SELECT file, table_name FROM layers JOIN e USING (file, table_name) WHERE a < min_x - 1e-6 OR b < min_y - 1e-6 OR c > max_x + 1e-6 OR d > max_y + 1e-6""")  # fmt: skip
def _(v):
    return catalog.extent_mismatch(v.layers, v.entries)


@query("placeholder_profile", """WITH l AS (SELECT file, table_name, 'note' AS column_name, note AS x FROM features UNION ALL SELECT file, table_name, 'status', status FROM features),
r AS (SELECT file, table_name, column_name, count(*) FILTER (x IS NULL) AS n_null, count(*) FILTER (lower(trim(x)) IN ('', 'tbd', 'tbc', 'n/a', 'na', 'none', 'unknown', 'null', '?')) AS n_placeholder, count(*) AS n FROM l GROUP BY 1, 2, 3)
SELECT *, n_null + n_placeholder = n AS "empty" FROM r""")  # fmt: skip
def _(v):
    return catalog.placeholder_profile(v.features, ["note", "status"], ["file", "table_name"])


@query("gridded_elevation", """WITH r AS (SELECT *, coalesce(regexp_matches(lower(quantity_definition), 'elevation|height'), false) AS h FROM coverage)
SELECT file, table_name, CASE WHEN NOT h THEN 'SKIPPED' WHEN lower(field_name) IN ('height', 'elevation') THEN 'PASS' ELSE 'FAIL' END AS field_status, CASE WHEN NOT h THEN 'SKIPPED' WHEN grid_cell_encoding = 'grid-value-is-center' THEN 'PASS' ELSE 'FAIL' END AS centre_status FROM r""")  # fmt: skip
def _(v):
    return catalog.gridded_elevation(v.coverage)


@query("geometry_type_widening", """SELECT file, table_name, CASE WHEN count(DISTINCT geometry_type) = 1 THEN min(geometry_type) ELSE 'GEOMETRY' END AS geometry_type, count(geometry_type) AS n FROM features GROUP BY file, table_name""")
def _(v):
    return maintenance.widened_type(v.features, by=["file", "table_name"])


_ELEMENTS = " + ".join(rf"CASE WHEN regexp_matches(metadata, '<(?:[A-Za-z0-9_]+:)?{e}[\s/>]') THEN 1 ELSE 0 END" for e in dims.MANDATORY_ELEMENTS)


@query("metadata_elements", rf"""SELECT file, id, {_ELEMENTS} AS n_elements, coalesce(nullif(regexp_extract(metadata, '<(?:\w+:)?MD_ScopeCode[^>]*codeListValue="([^"]*)"', 1), ''), nullif(trim(regexp_extract(metadata, '<(?:\w+:)?MD_ScopeCode[^>]*>([^<]*)<', 1)), '')) AS scope_code FROM metadata""")
def _(v):
    m = F.col("metadata")
    return v.metadata.select("file", "id", text.elements_present(m).alias("n_elements"), text.scope_code(m).alias("scope_code"))


@query("metadata_wellformed")
def _(v):
    from .functions.xml import well_formed

    pages = v.pages.select(F.concat(F.lit("p"), "page_id").alias("id"), F.col("html").alias("xml"))
    return v.metadata.select(F.concat(F.lit("m"), "id").alias("id"), F.col("metadata").alias("xml")).unionByName(pages).select("id", well_formed(F.col("xml")).alias("ok"))


@query("stamps_and_ids", r"""SELECT table_name, coalesce(regexp_matches(last_change, '^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?)?$'), false) AS stamp, regexp_matches(u, '^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$') AS uuid FROM
(SELECT table_name, last_change, CASE WHEN min_y < 0 THEN table_name ELSE regexp_replace(md5(table_name), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5') END AS u FROM contents)""")  # fmt: skip
def _(v):
    uuid = F.when(F.col("min_y") < 0, F.col("table_name")).otherwise(F.regexp_replace(F.md5("table_name"), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))
    return v.contents.select("table_name", text.is_stamp(F.col("last_change")).alias("stamp"), text.is_uuid(uuid).alias("uuid"))


@query("input_validation", """SELECT c_custkey, array_to_string(list_filter([CASE WHEN length(trim(substr(c_name, 10, 3 + c_custkey % 6))) < 5 THEN 'title' END, CASE WHEN length(trim(substr(c_name, 1, 5 + c_custkey % 9))) < 10 THEN 'abstract' END,
CASE WHEN NOT (CASE c_custkey % 3 WHEN 0 THEN 'SECRET' WHEN 1 THEN 'secret' ELSE 'UNCLASSIFIED' END IN ('UNCLASSIFIED', 'RESTRICTED', 'CONFIDENTIAL', 'SECRET', 'TOP SECRET')) THEN 'security' END,
CASE WHEN NOT (CASE c_custkey % 4 WHEN 0 THEN 'ENG' WHEN 1 THEN 'fra' ELSE 'xx' END IN ('ENG', 'fra')) THEN 'language' END, CASE WHEN NOT (upper(CASE WHEN c_custkey % 5 = 0 THEN 'usa' ELSE 'zz' END) IN ('USA', 'KOR')) THEN 'nation' END], lambda x: x IS NOT NULL), ',') AS errors FROM customer""")  # fmt: skip
def _(v):
    k = F.col("c_custkey")
    pick = lambda n, *xs: F.element_at(F.array(*map(F.lit, xs)), (k % n).cast("int") + 1)
    errors = text.input_errors(F.col("c_name").substr(F.lit(10), (3 + k % 6).cast("int")), F.col("c_name").substr(F.lit(1), (5 + k % 9).cast("int")), pick(3, "SECRET", "secret", "UNCLASSIFIED"), pick(4, "ENG", "fra", "xx", "xx"), pick(5, "usa", "zz", "zz", "zz", "zz"), ["eng", "fra"], ["USA", "KOR"])
    return v.customer.select("c_custkey", errors.alias("errors"))


# Blobs


def _blobs(v):
    """Geometry blobs with an XY envelope or none, and PNG or WEBP headers, built from points."""
    k = F.col("fid")
    pad = lambda x, n: F.lpad(F.hex(x), n, "0")
    srs = F.lit("E6100000")  # 4326, little endian
    header = F.when(k % 3 == 0, F.concat(F.lit("47500003"), srs, F.repeat(F.lit("00"), 32))).when(k % 7 == 0, F.concat(F.lit("47510001"), srs)).otherwise(F.concat(F.lit("47500001"), srs))
    kind = F.when(k % 2 == 0, F.lit("0101000000")).otherwise(F.lit("00000003E9"))
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), pad(F.when(k % 5 == 0, 512).otherwise(256), 8), pad(F.lit(256), 8))
    image = F.when(k % 4 == 0, F.lit("5249464600000000574542505650")).when(k % 11 == 0, F.lit("FFD8FFE0")).otherwise(png)
    return v.features.select("fid", F.unhex(F.concat(header, kind, F.repeat(F.lit("00"), 16))).alias("geom"), F.unhex(image).alias("image"))


@query("geometry_headers", """SELECT fid, CASE WHEN NOT w THEN 4326 END::BIGINT AS srs_id, CASE WHEN NOT w THEN e END::BIGINT AS envelope, CASE WHEN NOT w THEN e = 1 END AS has_z, CASE WHEN NOT w THEN false END AS has_m, CASE WHEN NOT w THEN 8 + 32 * e END::INT AS wkb_offset, CASE WHEN NOT w THEN CASE WHEN fid % 2 = 0 THEN 1 ELSE 1001 END END::BIGINT AS wkb_type
FROM (SELECT fid, CASE WHEN fid % 3 = 0 THEN 1 ELSE 0 END AS e, fid % 3 <> 0 AND fid % 7 = 0 AS w FROM features)""")  # fmt: skip
def _(v):
    h = _blobs(v).select("fid", binary.gp_header(F.col("geom")).alias("h"))
    return h.select("fid", *[F.col(f"h.{c}") for c in ("srs_id", "envelope", "has_z", "has_m", "wkb_offset", "wkb_type")])


@query("image_headers", """SELECT fid, CASE WHEN fid % 4 = 0 THEN 'WEBP' WHEN fid % 11 = 0 THEN 'JPEG' ELSE 'PNG' END AS format, CASE WHEN fid % 4 <> 0 AND fid % 11 <> 0 THEN CASE WHEN fid % 5 = 0 THEN 512 ELSE 256 END END::BIGINT AS width,
CASE WHEN fid % 4 <> 0 AND fid % 11 <> 0 THEN 256 END::BIGINT AS height FROM features""")  # fmt: skip
def _(v):
    b = _blobs(v).select("fid", binary.image_format(F.col("image")).alias("format"), binary.png_size(F.col("image")).alias("s"))
    return b.select("fid", "format", "s.width", "s.height")


@query("polygon_validity", "SELECT fid, CASE WHEN fid % 5 = 0 THEN 'self-intersection' WHEN fid % 7 = 0 THEN 'ring not closed' END AS problem FROM features")
def _(v):
    from .functions.geometry import polygon_wkb, validity

    x, y, k = F.col("lon"), F.col("lat"), F.col("fid")
    points = lambda *p: F.array(*[F.array(x + a, y + b) for a, b in p])
    square, bow, open_ring = points((0, 0), (1, 0), (1, 1), (0, 1), (0, 0)), points((0, 0), (2, 2), (2, 0), (0, 2), (0, 0)), points((0, 0), (1, 0), (1, 1), (0, 1), (0, 0.5))
    rows = v.features.select("fid", polygon_wkb(F.when(k % 5 == 0, bow).when(k % 7 == 0, open_ring).otherwise(square)).alias("wkb"))
    return rows.select("fid", validity(F.col("wkb")).alias("problem"))


# Scores and roll-ups

_VERDICT = "CASE WHEN n_error > 0 THEN 'VALIDATION ERROR' WHEN n_fail > 0 THEN 'NON-CONFORMANT' WHEN n_pass_star > 0 THEN 'LIKELY CONFORMANT' WHEN n_skipped > 0 THEN 'AUTOMATED CHECKS CONFORMANT' ELSE 'CONFORMANT' END"
_ROLLUP = """SELECT req, count(*) FILTER (status NOT IN ('SKIPPED', 'N/A')) AS applicable, count(*) FILTER (status IN ('FAIL', 'ERROR')) AS disputes, count(*) FILTER (status = 'PASS*') AS pass_star,
count(*) FILTER (status = 'PASS*' AND total_n > 0 AND confirmed = total_n) AS star_confirmed, coalesce(array_to_string(list_sort(list(DISTINCT software) FILTER (status IN ('FAIL', 'ERROR'))), ','), '') AS fail_software FROM facts GROUP BY req"""


@query("file_verdicts", f"WITH r AS (SELECT file, {', '.join(f'''count(*) FILTER (status = '{s}') AS {n}''' for s, n in scoring.NAMES.items())}, count(*) AS total FROM facts GROUP BY file) SELECT *, {_VERDICT} AS verdict FROM r")
def _(v):
    return scoring.file_verdicts(v.facts)


@query("gate", f"SELECT file, count(*) FILTER (status = 'FAIL' AND req IN {_in(dims.MANDATORY)}) = 0 AS conformant, max(CASE WHEN status IN ('FAIL', 'ERROR') THEN 1 ELSE 0 END) AS exit_code FROM facts GROUP BY file")
def _(v):
    return scoring.gate(v.facts)


@query("requirement_rollup", f"WITH r AS ({_ROLLUP}) SELECT *, CASE WHEN applicable > 0 THEN round_even(100.0::DOUBLE * disputes / applicable, 0) ELSE 0 END::BIGINT AS rate FROM r")
def _(v):
    return scoring.requirement_rollup(v.facts)


@query("rollup_confidence", f"WITH r AS ({_ROLLUP}) SELECT req, CASE WHEN applicable = 0 OR (pass_star > 0 AND star_confirmed = 0) THEN 'Low' WHEN pass_star > 0 AND star_confirmed / pass_star < 0.5 THEN 'Medium' ELSE 'High' END AS confidence FROM r")
def _(v):
    return scoring.confidence(scoring.requirement_rollup(v.facts))


@query("status_matrix", "SELECT file, " + ", ".join(f"max(status) FILTER (req = {r}) AS r{r}" for r in range(3, 38)) + " FROM facts GROUP BY file")
def _(v):
    return scoring.status_matrix(v.facts, [*range(3, 38)])


@query("cascades", f"""SELECT file, count(*) AS n, array_to_string(list_sort(list(DISTINCT req)), ',') AS reqs FROM facts WHERE status = 'FAIL' AND req IN {_in(dims.METADATA_REQUIREMENTS)} AND file IN (SELECT file FROM facts WHERE req = 3 AND status <> 'PASS') GROUP BY file HAVING count(*) >= 2""")
def _(v):
    return scoring.cascades(v.facts, v.facts.filter("req = 3 AND status <> 'PASS'"))


@query("software_vote", """WITH r AS (SELECT file, count(*) FILTER (gdal) AS n_gdal, count(*) FILTER (arcgis) AS n_arcgis FROM signals GROUP BY file)
SELECT *, CASE WHEN n_gdal = 0 AND n_arcgis = 0 THEN 'UNKNOWN' WHEN n_gdal > n_arcgis THEN 'GDAL' ELSE 'ARCGIS' END AS software, CASE WHEN (n_gdal > 0) = (n_arcgis > 0) THEN 'Low' WHEN greatest(n_gdal, n_arcgis) >= 2 THEN 'High' ELSE 'Medium' END AS confidence FROM r""")  # fmt: skip
def _(v):
    return scoring.software_vote(v.signals)


# Maintenance and sampling


@query("orphan_systems_removed", f"SELECT file, srs_id, srs_name FROM srs s WHERE srs_id <= 0 OR srs_id IN {_in(dims.APPROVED)} OR EXISTS (SELECT 1 FROM contents c WHERE c.file = s.file AND c.srs_id = s.srs_id AND c.data_type = 'features')")
def _(v):
    return maintenance.drop_orphan_systems(v.srs, v.contents.filter("data_type = 'features'")).select("file", "srs_id", "srs_name")


@query("extension_upsert", """SELECT file, table_name, extension_name, scope FROM extensions UNION ALL
SELECT * FROM (SELECT DISTINCT file, NULL AS table_name, 'gpkg_metadata' AS extension_name, 'read-write' AS scope FROM srs) n WHERE NOT EXISTS (SELECT 1 FROM extensions x WHERE x.file = n.file AND x.table_name IS NULL AND x.extension_name = n.extension_name)""")  # fmt: skip
def _(v):
    new = v.srs.select("file").distinct().select("file", F.lit(None).cast("string").alias("table_name"), F.lit(None).cast("string").alias("column_name"), F.lit("gpkg_metadata").alias("extension_name"), F.lit("read-write").alias("scope"))
    return maintenance.upsert_extensions(v.extensions, new).select("file", "table_name", "extension_name", "scope")


@query("definitions_filled", "SELECT file, srs_id, coalesce(nullif(nullif(trim(definition_12_063), ''), 'undefined'), w, 'undefined') AS definition_12_063, coalesce(nullif(trim(description), ''), srs_name) AS description FROM srs LEFT JOIN (VALUES " + ", ".join(f"({k}, '{w}')" for k, w in WKT.items() if k < 9000) + ") AS k(id, w) ON id = srs_id")
def _(v):
    known = v.spark.createDataFrame([(k, w) for k, w in WKT.items() if k < 9000], "srs_id int, wkt2 string")
    # An emptied description counts as missing; others stay as they are.
    return maintenance.fill_definitions(v.srs, known).select("file", "srs_id", "definition_12_063", "description")


@query("metadata_ids", """WITH d AS (SELECT file, id AS position, CASE WHEN id < 25 THEN 'package' ELSE 'layer' END AS kind FROM metadata), r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY position) AS id FROM d),
p AS (SELECT file, min(id) AS package_id FROM r WHERE kind = 'package' GROUP BY file) SELECT r.file, position, kind, r.id, CASE WHEN kind = 'layer' THEN package_id END AS md_parent_id FROM r LEFT JOIN p USING (file)""")  # fmt: skip
def _(v):
    docs = v.metadata.select("file", F.col("id").alias("position"), F.when(F.col("id") < 25, "package").otherwise("layer").alias("kind"))
    return maintenance.metadata_ids(docs)


@query("stratified_sample", """WITH s AS (SELECT file, table_name, min(fid) AS lo, greatest(1, (max(fid) - min(fid)) // 5) AS step FROM features GROUP BY file, table_name), t AS (SELECT *, lo + i * step AS th FROM s, generate_series(0, 4) g(i))
SELECT DISTINCT file, table_name, fid FROM (SELECT t.file, t.table_name, th, min(fid) AS fid FROM t JOIN features f ON f.file = t.file AND f.table_name = t.table_name AND fid >= th GROUP BY 1, 2, 3)""")  # fmt: skip
def _(v):
    return maintenance.stratified_sample(v.features, 5, by=["file", "table_name"])


@query("first_tiles_per_zoom", "SELECT * FROM tiles QUALIFY row_number() OVER (PARTITION BY file, table_name, zoom_level ORDER BY tile_column, tile_row) <= 5")
def _(v):
    return maintenance.first_per_zoom(v.tiles, 5)


@query("hash_sample", "SELECT file, table_name, fid FROM features QUALIFY row_number() OVER (PARTITION BY file, table_name ORDER BY md5(fid::VARCHAR), fid) <= 7")
def _(v):
    return maintenance.hash_sample(v.features, 7, by=["file", "table_name"], key="fid").select("file", "table_name", "fid")


@query("report_names", """WITH f AS (SELECT s_suppkey, concat('f', s_suppkey) AS file, concat('stem', s_nationkey) AS stem, CASE WHEN s_suppkey % 3 = 0 THEN 'GDAL' ELSE 'ARCGIS' END AS tag FROM supplier), r AS (SELECT *, row_number() OVER (PARTITION BY stem, tag ORDER BY file) AS k FROM f)
SELECT file, concat(stem, '_', tag, CASE WHEN k > 1 THEN concat('_', k) ELSE '' END) AS report FROM r""")  # fmt: skip
def _(v):
    files = v.supplier.select(F.concat(F.lit("f"), "s_suppkey").alias("file"), F.concat(F.lit("stem"), "s_nationkey").alias("stem"), F.when(F.col("s_suppkey") % 3 == 0, "GDAL").otherwise("ARCGIS").alias("tag"))
    return maintenance.report_names(files).select("file", "report")


@query("props_profile", "SELECT table_name, count(*) AS n, count(k) AS n_k, min(k) AS low, max(k) AS high, sum(k)::BIGINT AS total FROM (SELECT table_name, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM features) GROUP BY table_name")
def _(v):
    k = F.from_json("props", "k long")["k"]
    return v.features.select("table_name", k.alias("k")).groupBy("table_name").agg(F.count("*").alias("n"), F.count("k").alias("n_k"), F.min("k").alias("low"), F.max("k").alias("high"), F.sum("k").alias("total"))


@query("systems_in_use", """SELECT file, srs_id, 'both' AS side FROM (SELECT file, srs_id FROM contents INTERSECT SELECT file, srs_id FROM geometry_columns WHERE z = 0) UNION ALL
SELECT file, srs_id, 'contents' FROM (SELECT file, srs_id FROM contents EXCEPT SELECT file, srs_id FROM geometry_columns WHERE z = 0)""")  # fmt: skip
def _(v):
    a, b = v.contents.select("file", "srs_id"), v.geometry_columns.filter("z = 0").select("file", "srs_id")
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.exceptAll(b).distinct().join(b, ["file", "srs_id"], "left_anti").withColumn("side", F.lit("contents")))


@query("file_profile", f"""WITH m AS (SELECT file, min(zoom_level) AS low, max(zoom_level) AS high, count(*) AS n_levels FROM matrix GROUP BY file)
SELECT file, count(*) AS n_tables, array_to_string(list_sort(list(DISTINCT {_CAT})), ',') AS categories, array_to_string(list_sort(list(DISTINCT srs_id)), ',') AS systems, any_value(low) AS low, any_value(high) AS high, any_value(n_levels) AS n_levels FROM contents LEFT JOIN m USING (file) GROUP BY file""")  # fmt: skip
def _(v):
    from .plans.validate import file_profile

    return file_profile(v.contents, v.matrix)


# Second looks and audits

_DEF = "coalesce(definition_12_063, definition, '')"
_EPSG = _EPSG_OF.format("wkt")


def _score(req: int, ok: str, rows: str) -> str:
    return f"SELECT file, {req} AS req, count(*) FILTER ({ok}) AS confirmed, count(*) AS total FROM {rows} GROUP BY file"


_SCORERS = {
    "score_3_mandatory_extensions": (
        lambda v: scorers.mandatory_extensions(v.contents, v.extensions),
        f"""WITH n AS (SELECT DISTINCT file, rule AS extension_name, category FROM (SELECT DISTINCT file, {_CAT} AS category FROM contents) c JOIN {_RULES} USING (category) WHERE use = 'M'),
        h AS (SELECT file, extension_name, bool_or(coalesce(trim(table_name) <> '', false)) AS named FROM extensions GROUP BY 1, 2) """ + _score(3, "named", "n LEFT JOIN h USING (file, extension_name)"),
    ),
    "score_4_named_extensions": (lambda v: scorers.named_extensions(v.extensions), _score(4, "trim(table_name) <> ''", "extensions")),
    "score_7_tile_systems": (
        lambda v: scorers.tile_systems(v.sets, v.srs),
        f"WITH r AS (SELECT s.file, s.srs_id, srs_name, {_DEF} AS wkt FROM sets s LEFT JOIN srs d ON d.file = s.file AND d.srs_id = s.srs_id), c AS (SELECT *, {_EPSG} AS code FROM r) " + _score(7, "trim(srs_name) <> '' AND (code IS NULL OR code = srs_id)", "c"),
    ),
    "score_9_vector_2d": (lambda v: scorers.vector_systems(v.geometry_columns, z=False), _score(9, "srs_id = 4326", "geometry_columns WHERE z = 0")),
    "score_10_vector_3d": (lambda v: scorers.vector_systems(v.geometry_columns, z=True), _score(10, "srs_id IN (4979, 9518)", "geometry_columns WHERE z <> 0")),
    "score_13_definitions": (lambda v: scorers.long_definitions(v.srs), f"WITH r AS (SELECT *, {_DEF} AS wkt FROM srs WHERE srs_id > 0), c AS (SELECT *, {_EPSG} AS code FROM r) " + _score(13, "length(wkt) > 20 AND code = srs_id", "c")),
    "score_14_compound": (
        lambda v: scorers.compound_only_in_3d(v.geometry_columns, v.srs),
        f"WITH r AS (SELECT g.file, z FROM geometry_columns g JOIN srs d ON d.file = g.file AND d.srs_id = g.srs_id WHERE contains(upper({_DEF}), 'COMPOUND')) " + _score(14, "z <> 0", "r"),
    ),
    "score_18_complete_metadata": (lambda v: scorers.complete_metadata(v.metadata), _score(18, f"({_ELEMENTS}) = 7", "metadata WHERE regexp_matches(lower(md_standard_uri), 'dgiwg|dmf')")),
    "score_20_whole_file": (lambda v: scorers.whole_file_references(v.reference), "SELECT file, 20 AS req, least(1, count(*) FILTER (reference_scope = 'geopackage'))::BIGINT AS confirmed, 1::BIGINT AS total FROM reference GROUP BY file"),
    "score_21_partial_references": (
        lambda v: scorers.partial_references(v.reference, v.metadata),
        f"WITH r AS (SELECT r.file, p.md_scope IS NOT NULL AS fine FROM reference r LEFT JOIN metadata m ON m.file = r.file AND m.id = r.md_file_id LEFT JOIN {_PAIRS} ON p.reference_scope = r.reference_scope AND p.md_scope = m.md_scope WHERE r.reference_scope <> 'geopackage') " + _score(21, "fine", "r"),
    ),
    "score_22_series": (lambda v: scorers.series_documents(v.metadata), _score(22, "length(md_standard_uri) > 5", "metadata WHERE md_scope = 'series'")),
    "score_23_parents": (lambda v: scorers.parents(v.reference, v.metadata), "SELECT r.file, 23 AS req, count(m.id) AS confirmed, count(*) AS total FROM reference r LEFT JOIN metadata m ON m.file = r.file AND m.id = r.md_parent_id WHERE md_parent_id IS NOT NULL GROUP BY r.file"),
    "score_25_square_levels": (lambda v: scorers.square_levels(v.matrix), _score(25, "tile_width = 256 AND tile_height = 256", "matrix")),
    "score_28_populated_levels": (
        lambda v: scorers.populated_levels(v.matrix, v.tiles),
        "WITH h AS (SELECT DISTINCT file, table_name, zoom_level, 1 AS there FROM tiles), r AS (SELECT file, table_name, count(*) AS n, count(there) AS k FROM matrix LEFT JOIN h USING (file, table_name, zoom_level) GROUP BY 1, 2 HAVING count(*) > 1) " + _score(28, "n = k", "r"),
    ),
    "score_29_single_levels": (lambda v: scorers.single_levels(v.matrix), "WITH r AS (SELECT file, table_name, bool_and(tile_width = 256 AND tile_height = 256) AS sq FROM matrix GROUP BY 1, 2 HAVING count(*) = 1) " + _score(29, "sq", "r")),
    "score_31_tile_layers": (
        lambda v: scorers.linked_layers(v.contents, v.reference, "tiles"),
        "WITH n AS (SELECT DISTINCT file, table_name, 1 AS linked FROM reference WHERE reference_scope = 'table') " + _score(31, "linked = 1", "contents LEFT JOIN n USING (file, table_name) WHERE data_type = 'tiles'"),
    ),
    "score_32_feature_layers": (
        lambda v: scorers.linked_layers(v.contents, v.reference, "features"),
        "WITH n AS (SELECT DISTINCT file, table_name, 1 AS linked FROM reference WHERE reference_scope = 'table') " + _score(32, "linked = 1", "contents LEFT JOIN n USING (file, table_name) WHERE data_type = 'features'"),
    ),
    "score_33_coverages": (lambda v: scorers.complete_coverages(v.coverage), _score(33, "trim(quantity_definition) <> '' AND trim(field_name) <> '' AND trim(grid_cell_encoding) <> ''", "coverage")),
    "audit_extensions": (
        lambda v: scorers.extension_audit(v.extensions),
        "WITH r AS (SELECT file, extension_name, CASE WHEN extension_name IN (" + ", ".join(f"'{e}'" for e in dims.EXTENSIONS if not e.endswith("_")) + ") OR starts_with(extension_name, 'gpkg_geom_') THEN 'known' WHEN starts_with(extension_name, 'gdal') THEN 'gdal' ELSE 'unknown' END AS kind FROM extensions) SELECT file, kind, count(*) AS n, count(DISTINCT extension_name) AS n_names FROM r GROUP BY file, kind",
    ),
    "audit_definitions": (
        lambda v: scorers.definition_audit(v.srs),
        f"""WITH r AS (SELECT file, definition, CASE WHEN regexp_matches(upper(definition), '^\\s*({"|".join(text.WKT2_ROOTS)})\\[') THEN 'WKT2' WHEN {_WKT1} THEN 'WKT1' ELSE 'none' END AS start FROM srs WHERE srs_id > 0) SELECT file, start, count(*) AS n, count(*) FILTER (contains(definition, 'AUTHORITY["ESRI"')) AS n_esri FROM r GROUP BY file, start""",
    ),
    "audit_references": (lambda v: scorers.reference_audit(v.reference), "SELECT file, count(*) AS n, count(*) FILTER (table_name IS NOT NULL OR column_name IS NOT NULL OR row_id_value IS NOT NULL) AS n_named FROM reference WHERE reference_scope = 'geopackage' GROUP BY file"),
}
for _name, (_f, _body) in _SCORERS.items():
    query(_name, _body)(_f)

@query(
    "file_counts",
    """SELECT file, count(*) FILTER (status = 'PASS*') AS pass_star, count(*) FILTER (status = 'PASS*' AND total_n > 0 AND confirmed = total_n) AS star_confirmed,
      count(*) FILTER (status = 'PASS*' AND confirmed BETWEEN 1 AND total_n - 1) AS star_partial, count(*) FILTER (status = 'PASS*' AND confirmed = 0) AS star_open FROM facts GROUP BY file""",
)
def _(v):
    return scoring.file_counts(v.facts)


@query(
    "zoom_step_messages",
    f"""WITH s AS (SELECT file, table_name, zoom_level, pixel_x_size, lag(pixel_x_size) OVER ({_W}) AS px, lag(zoom_level) OVER ({_W}) AS zb FROM matrix)
    SELECT file, table_name, count(*) FILTER (bad) AS n_bad, coalesce(string_agg(zb || ' to ' || zoom_level, '; ' ORDER BY zoom_level) FILTER (bad), '') AS steps
    FROM (SELECT *, zb IS NOT NULL AND (pixel_x_size <= 0 OR abs(px / pixel_x_size - 2) > 1e-6) AS bad FROM s) GROUP BY file, table_name""",
)
def _(v):
    return zoom.step_messages(v.matrix)


#: Scorers and audits over the validation views.
_WHOLE = {
    "score_11_gridded_2d": (lambda c: scorers.gridded_systems(c.sets, c.contents, c.srs, three=False), _score(11, f"srs_id IN {_in(dims.VALIDATE['gridded_2d'])}", "grids WHERE NOT three")),
    "score_12_gridded_3d": (lambda c: scorers.gridded_systems(c.sets, c.contents, c.srs, three=True), _score(12, "true", "grids WHERE three")),
    "score_15_compound": (
        lambda c: scorers.compound_definitions(c.srs),
        f", d AS (SELECT *, {_DEF} AS w FROM srs WHERE srs_id > 0), e AS (SELECT file, upper(w) AS u FROM d) " + _score(15, "u LIKE 'COMPOUNDCRS[%' AND u LIKE '%GEOGCRS[%' AND u LIKE '%VERTCRS[%VDATUM[%'", "e WHERE regexp_matches(u, 'COMPOUNDCRS|COMPD_CS')"),
    ),
    "score_16_compound_grids": (
        lambda c: scorers.compound_definitions(c.srs, c.sets.join(c.coverage.select("file", "table_name").distinct(), ["file", "table_name"], "left_semi")),
        f", d AS (SELECT *, {_DEF} AS w FROM srs WHERE srs_id > 0), e AS (SELECT d.file, upper(w) AS u FROM d WHERE EXISTS (SELECT 1 FROM sets s JOIN coverage USING (file, table_name) WHERE s.file = d.file AND s.srs_id = d.srs_id)) "
        + _score(16, "u LIKE 'COMPOUNDCRS[%' AND u LIKE '%GEOGCRS[%' AND u LIKE '%VERTCRS[%VDATUM[%'", "e WHERE regexp_matches(u, 'COMPOUNDCRS|COMPD_CS')"),
    ),
    "score_17_epochs": (lambda c: scorers.epochs(c.srs), _score(17, "epoch > 0", "srs WHERE epoch <> 0")),
    "score_19_documents": (lambda c: scorers.whole_documents(c.metadata), _score(19, "mime_type = 'text/xml' AND metadata LIKE '%</gmd:MD_Metadata>'", "metadata")),
    "score_24_systems": (lambda c: scorers.described_systems(c.srs), _score(24, "organization = 'EPSG' AND trim(description) <> ''", "srs WHERE srs_id > 0")),
    "score_26_images": (
        lambda c: scorers.sound_images(c.matrix, c.heads, c.contents),
        """, h AS (SELECT file, table_name, zoom_level, bool_and(coalesce(format IN ('PNG', CASE data_type WHEN 'tiles' THEN 'JPEG' ELSE 'TIFF' END) AND width = 256 AND height = 256, false)) AS ok
          FROM heads JOIN contents USING (file, table_name) GROUP BY ALL) """ + _score(26, "ok", "matrix LEFT JOIN h USING (file, table_name, zoom_level)"),
    ),
    "score_37_scopes": (lambda c: scorers.known_scopes(c.metadata), _score(37, "md_scope <> 'bogus'", "metadata")),
    "audit_raster_systems": (
        lambda c: scorers.raster_audit(c.sets, c.srs),
        f"""SELECT s.file, CASE WHEN s.srs_id IN {_in(dims.VALIDATE['raster'])} THEN 'listed' WHEN upper(replace(concat_ws(' ', definition, definition_12_063), '_', ' ')) LIKE '%LAMBERT CONFORMAL CONIC%' THEN 'cone' WHEN s.srs_id > 100000 THEN 'own' ELSE 'other' END AS kind, count(*) AS n
        FROM sets s LEFT JOIN srs d USING (file, srs_id) GROUP BY ALL""",
    ),
    "audit_layers": (lambda c: scorers.layer_audit(c.geometry_columns), "SELECT file, count(*) AS n, count(*) FILTER (srs_id <> 4326) AS n_other FROM geometry_columns GROUP BY file"),
    "audit_documents": (
        lambda c: scorers.document_audit(c.metadata),
        """SELECT file, CASE WHEN md_standard_uri = '' THEN 'none' WHEN md_standard_uri LIKE '%dgiwg%' THEN 'profile' ELSE 'iso' END AS kind, count(*) AS n, count(*) FILTER (mime_type IS DISTINCT FROM 'text/xml') AS n_other_type, count(*) FILTER (malformed) AS n_malformed,
        count(*) FILTER (NOT malformed AND (metadata NOT LIKE '%fileIdentifier%' OR metadata NOT LIKE '%identificationInfo%')) AS n_incomplete, 0::BIGINT AS n_paths FROM docs GROUP BY ALL""",
    ),
    "audit_products": (
        lambda c: scorers.product_audit(c.metadata),
        "SELECT file, count(*) FILTER (md_scope = 'series') AS n_series, count(*) FILTER (md_scope = 'dataset') AS n_dataset, CASE WHEN bool_or(md_scope = 'series') THEN 'series' WHEN bool_or(md_scope = 'dataset') THEN 'dataset' END AS product FROM metadata GROUP BY file",
    ),
    "software_of_files": (
        lambda c: scoring.software_vote(scorers.software_signals(c)),
        """, s AS (SELECT DISTINCT file, 'gdal' AS side, 1 AS k FROM schema WHERE table_name = 'gpkg_ogr_contents' UNION SELECT file, 'gdal', 2 FROM extensions WHERE extension_name = 'gdal_aspatial'
          UNION SELECT file, 'arcgis', 5 FROM srs WHERE srs_id > 100000 UNION SELECT file, 'arcgis', 6 FROM srs WHERE organization = 'Esri' UNION SELECT file, 'arcgis', 8 FROM schema WHERE table_name = 'gdb_items'
          UNION SELECT file, 'arcgis', 9 FROM srs WHERE definition LIKE '%AUTHORITY["ESRI"%'),
        n AS (SELECT f.file, count(k) FILTER (side = 'gdal') AS n_gdal, count(k) FILTER (side = 'arcgis') AS n_arcgis FROM files f LEFT JOIN s ON s.file = f.file GROUP BY f.file)
        SELECT *, CASE WHEN n_gdal + n_arcgis = 0 THEN 'UNKNOWN' WHEN n_gdal > n_arcgis THEN 'GDAL' ELSE 'ARCGIS' END AS software,
          CASE WHEN n_gdal + n_arcgis = 0 OR n_gdal > 0 AND n_arcgis > 0 THEN 'Low' WHEN n_gdal + n_arcgis >= 2 THEN 'High' ELSE 'Medium' END AS confidence FROM n""",
    ),
}


def _over_files(f):
    return lambda spark, sf_dir: f(validation_views.catalog_of(spark, sf_dir))


for _name, (_f, _body) in _WHOLE.items():
    _QUERIES[_name], _SQL[_name] = _over_files(_f), validation_views.sql(_body)


def rollup_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roll-up's nine columns from findings, second looks and writing software of every file of the validation views."""
    from .plans.report import rollup_table
    from .plans.rollup import file_facts
    from .plans.validate import scratch_folder

    folder = scratch_folder(spark, "rollup")
    catalog = validation_views.catalog_of(spark, sf_dir).written(f"{folder}/catalog")
    file_facts(catalog, validation_views.AS_OF, folder=f"{folder}/parts").write.parquet(f"{folder}/facts")  # the roll-up reads them twice
    return rollup_table(spark.read.parquet(f"{folder}/facts"))


def _rollup_of_files_sql() -> str:
    nested = lambda body: "WITH" + body[1:] if body.startswith(",") else body
    looks = [body for name, (_, body) in (_SCORERS | _WHOLE).items() if name.startswith("score_")]
    looks += [
        f"""WITH j AS (SELECT m.*, pz0 FROM matrix m JOIN sets s USING (file, table_name) JOIN {_PZ} USING (srs_id)),
        r AS (SELECT file, table_name, zoom_level, bool_or(abs(pixel_x_size - pz0 / pow(2.0, z)) / (pz0 / pow(2.0, z)) <= 1e-4) AS near FROM j, generate_series(0, 24) g(z) GROUP BY file, table_name, zoom_level),
        t AS (SELECT file, bool_and(near) AS aligned FROM r GROUP BY file, table_name) """ + _score(8, "aligned", "t"),
        "SELECT file, 30 AS req, count(*) FILTER (c.min_x >= s.min_x AND c.min_y >= s.min_y AND c.max_x <= s.max_x AND c.max_y <= s.max_y) AS confirmed, count(*) AS total FROM contents c JOIN sets s USING (file, table_name) GROUP BY file",
    ]
    union = "\nUNION ALL ".join(f"SELECT file, req, confirmed, total FROM ({nested(body)})" for body in looks)
    head, facts = validation_views.findings_sql().split("\nSELECT f.file, g.req", 1)
    names = ", ".join(f"'{n}'" for n in dims.NAMES)
    return f"""{head}, facts AS (SELECT f.file, g.req{facts}), tiles AS (SELECT file, table_name, zoom_level FROM heads), looks AS ({union}), writers AS ({nested(_WHOLE['software_of_files'][1])}),
whole AS (SELECT q.file, q.req, status, coalesce(confirmed, 0) AS confirmed, coalesce(total, 0) AS total_n, software FROM facts q LEFT JOIN looks USING (file, req) LEFT JOIN writers USING (file)),
r AS (SELECT req, count(*) FILTER (status <> 'SKIPPED') AS applicable, count(*) FILTER (status IN ('FAIL', 'ERROR')) AS disputes, count(*) FILTER (req IN {_in(dims.SECOND_LOOK)} AND status IN ('FAIL', 'PASS*')) AS again,
  count(*) FILTER (status = 'PASS*') AS stars, count(*) FILTER (status = 'PASS*' AND total_n > 0 AND confirmed = total_n) AS confirmed FROM whole GROUP BY req)
SELECT req AS "Req", [{names}][req] AS "Requirement", CASE WHEN req IN {_in(dims.MANDATORY)} THEN 'M' ELSE 'C' END AS "Compliance Type", applicable AS "Applicable GPKGs", disputes AS "Validator Disputes",
  again AS "Auditor Disputes", stars AS "PASS* Count", confirmed AS "PASS* Manual Confirmed", CASE WHEN applicable > 0 THEN round_even(100.0::DOUBLE * disputes / applicable, 0) ELSE 0 END::BIGINT AS "Dispute Rate %" FROM r"""


_QUERIES["rollup_of_files"], _SQL["rollup_of_files"] = rollup_of_files, _rollup_of_files_sql()


def content_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each metadata document of the validation views with its violations of the schema's order and numbers."""
    from .functions import schema

    documents = validation_views.catalog_of(spark, sf_dir).metadata
    return documents.select("file", "id", F.array_join(schema.content_problems(schema.sequences(F.col("metadata"))), "; ").alias("problems"))


def _content_models_sql() -> str:
    from .functions.schema import MODELS

    model = ", ".join(f"({i}, '{n}', {least}, {most})" for i, (n, least, most) in enumerate(MODELS["MD_Metadata"], 1))
    nested = "'MD_Metadata', 'MD_CharacterSetCode', 'MD_ScopeCode', 'organisationName', 'CI_RoleCode'"
    return validation_views.sql(f""", model(p, name, least, most) AS (VALUES {model}),
    d AS (SELECT file, id, metadata, trim(metadata) LIKE '%</gmd:MD_Metadata>' AS whole, list_filter(regexp_extract_all(metadata, '<gmd:(\\w+)', 1), lambda x: x NOT IN ({nested})) AS children FROM metadata),
    c AS (SELECT file, id, i, name, coalesce(p, 0) AS p, most, coalesce(max(coalesce(p, 0)) OVER (PARTITION BY file, id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS state
      FROM (SELECT file, id, unnest(children) AS name, generate_subscripts(children, 1) AS i FROM d WHERE whole) LEFT JOIN model USING (name)),
    w AS (SELECT file, id, i, 'MD_Metadata: ' || CASE WHEN p = 0 THEN 'unknown ' WHEN p < state THEN 'order ' ELSE 'repeated ' END || name AS said FROM c WHERE p = 0 OR p < state OR p = state AND most = 1
      UNION ALL SELECT file, id, 1000 + p, 'MD_Metadata: missing ' || name FROM d, model WHERE whole AND least > 0 AND NOT list_contains(children, name)),
    s AS (SELECT file, id, string_agg(said, '; ' ORDER BY i) AS said FROM w GROUP BY file, id)
    SELECT file, id, CASE WHEN whole THEN coalesce(said, '') WHEN metadata = '<x/>' THEN 'x: no such root' END AS problems FROM d LEFT JOIN s USING (file, id)""")


_QUERIES["content_models"], _SQL["content_models"] = content_models, _content_models_sql()
