"""Catalog-shaped views over the driver's tables, as SQL that Spark and DuckDB both run.

The driver's tables are clean, so views inject defects (nulls, orphans, bad stamps) by
arithmetic on keys; operators get them as they would get tables read from container files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "conversations", "pages")

WKT = {
    4326: 'GEOGCRS["WGS 84",ENSEMBLE["World Geodetic System 1984 ensemble",MEMBER["x"]],PRIMEM["Greenwich",0],CS[ellipsoidal,2],AXIS["Lat",NORTH],AXIS["Lon",EAST],ANGLEUNIT["degree",0.0174532925199433],ID["EPSG", 4326]]',
    3857: 'PROJCRS["Pseudo-Mercator",BASEGEOGCRS["WGS 84",ENSEMBLE["not this name"],DATUM["World Geodetic System 1984"]],PRIMEM["Greenwich",0],AXIS["X",EAST],AXIS["Y",NORTH],ID["EPSG",3857]]',
    32633: 'PROJCS["WGS 84 / UTM zone 33N",GEOGCS["WGS 84",DATUM["WGS_1984"],PRIMEM["Greenwich",0],AUTHORITY["EPSG","4326"]],AXIS["E",EAST],AUTHORITY["EPSG","32633"]]',
    27700: 'PROJCS["National Grid",PROJECTION["Lambert_Conformal_Conic_2SP"],PRIMEM["Paris",2.33],AUTHORITY["ESRI","27700"]]',
    4979: 'GEOGCRS["WGS 84 3D",Dynamic [ FrameEpoch [ 2010.0]],DATUM["World Geodetic System 1984"],PRIMEM["Greenwich",0],ID["EPSG",4979]]',
    9518: 'COMPOUNDCRS["WGS 84 + EGM2008",GEOGCRS["WGS 84",DATUM["World Geodetic System 1984"]],VERTCRS["EGM2008 height",VDATUM["EGM2008 geoid"]],ID["EPSG",9518]]',
    100200: 'COMPD_CS["old compound",GEOGCS["WGS 84",DATUM["WGS_1984"]],VERT_CS["height"]]',
}
_CODES = "CASE c_custkey % 7 WHEN 0 THEN 4326 WHEN 1 THEN 3857 WHEN 2 THEN 32633 WHEN 3 THEN 27700 WHEN 4 THEN 4979 WHEN 5 THEN 9518 ELSE 100200 END"
_CUSTOMER = "concat('f', c_nationkey) AS file, concat('t', c_custkey) AS table_name"

VIEWS = {
    "contents": f"""SELECT {_CUSTOMER},
        CASE c_custkey % 4 WHEN 0 THEN 'features' WHEN 1 THEN 'tiles' WHEN 2 THEN '2d-gridded-coverage' ELSE 'attributes' END AS data_type,
        CAST({_CODES} AS INT) AS srs_id,
        CASE WHEN c_custkey % 23 <> 0 THEN (c_custkey * 7919 % 36000 - 18000) / 1e2 END AS min_x, (c_custkey * 104729 % 17000 - 8500) / 1e2 AS min_y,
        (c_custkey * 7919 % 36000 - 18000) / 1e2 + c_custkey % 9 - 1 AS max_x, (c_custkey * 104729 % 17000 - 8500) / 1e2 + c_custkey % 11 AS max_y,
        CASE WHEN c_custkey % 13 = 0 THEN 'not-a-date' WHEN c_custkey % 17 = 0 THEN '2031-01-02T03:04:05Z' WHEN c_custkey % 19 = 0 THEN NULL ELSE '2025-01-02T03:04:05.123Z' END AS last_change
        FROM {{customer}}""",
    "sets": f"""SELECT {_CUSTOMER}, CAST({_CODES} AS INT) AS srs_id,
        (c_custkey * 7919 % 36000 - 18000) / 1e2 AS min_x, (c_custkey * 104729 % 17000 - 8500) / 1e2 - c_custkey % 3 AS min_y,
        (c_custkey * 7919 % 36000 - 18000) / 1e2 + 6 AS max_x, (c_custkey * 104729 % 17000 - 8500) / 1e2 + 9 AS max_y
        FROM {{customer}} WHERE c_custkey % 4 IN (1, 2)""",
    "geometry_columns": f"""SELECT {_CUSTOMER}, 'geom' AS column_name, CAST({_CODES} AS INT) AS srs_id, CAST(c_custkey % 3 AS INT) AS z FROM {{customer}} WHERE c_custkey % 4 = 0""",
    "srs": "SELECT concat('f', n_nationkey) AS file, srs_id, concat('system ', srs_id) AS srs_name, CASE WHEN n_nationkey % 6 = srs_id % 6 THEN '' ELSE definition END AS definition, CASE WHEN n_nationkey % 5 = 0 THEN 'undefined' ELSE definition END AS definition_12_063, CASE WHEN n_nationkey % 4 = 0 THEN ' ' ELSE 'text' END AS description FROM {nation} CROSS JOIN (SELECT CAST(0 AS INT) AS srs_id, 'undefined' AS definition UNION ALL "
    + " UNION ALL ".join(f"SELECT CAST({k} AS INT), '{v}'" for k, v in WKT.items())
    + ") AS s",
    "matrix": """SELECT file, table_name, zoom_level, CAST(CASE WHEN k % 31 = 0 THEN 512 ELSE 256 END AS INT) AS tile_width, CAST(256 AS INT) AS tile_height,
        CASE WHEN k % 97 = 0 THEN 0e0 ELSE 156543.03392804097e0 / pow(2e0, zoom_level) * (CASE WHEN k % 17 = 0 THEN 1.1e0 ELSE 1e0 END) END AS pixel_x_size,
        156543.03392804097e0 / pow(2e0, zoom_level) * (CASE WHEN k % 41 = 0 THEN 4.5e0 ELSE 1e0 END) AS pixel_y_size
        FROM (SELECT concat('f', c_nationkey) AS file, concat('t', c_custkey) AS table_name, CAST(o_orderkey % 9 AS INT) AS zoom_level, min(o_orderkey) AS k
              FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY c_nationkey, c_custkey, o_orderkey % 9) AS m""",
    "tiles": """SELECT DISTINCT concat('f', c_nationkey) AS file, concat('t', c_custkey) AS table_name, CAST(l_linenumber AS INT) AS zoom_level,
        l_partkey % CAST(pow(2e0, l_linenumber) AS BIGINT) AS tile_column, l_suppkey % CAST(pow(2e0, l_linenumber) AS BIGINT) AS tile_row
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey""",
    "extensions": """SELECT DISTINCT concat('f', o_custkey % 25) AS file, CASE WHEN o_orderkey % 3 = 0 THEN concat('t', o_custkey % 50) END AS table_name, CAST(NULL AS STRING) AS column_name,
        CASE (o_orderkey * 7 + o_custkey % 25) % 211 WHEN 1 THEN 'gpkg_rtree_index' WHEN 2 THEN 'gpkg_metadata' WHEN 3 THEN 'gpkg_crs_wkt' WHEN 4 THEN 'gpkg_schema' WHEN 5 THEN 'related_tables' WHEN 6 THEN 'gpkg_geom_CURVE' WHEN 7 THEN 'gpkg_webp' WHEN 8 THEN 'gpkg_zoom_other' WHEN 9 THEN 'gpkg_crs_wkt_1_1' WHEN 10 THEN 'gpkg_2d_gridded_coverage' ELSE 'gdal_aspatial' END AS extension_name,
        CASE WHEN o_orderkey % 37 = 0 THEN 'bogus' WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'read-write' END AS scope FROM {orders}""",
    "metadata": """SELECT concat('f', doc_id % 25) AS file, doc_id AS id, CASE lang WHEN 'en' THEN 'dataset' WHEN 'de' THEN 'series' WHEN 'fr' THEN 'featureType' ELSE 'bogus' END AS md_scope,
        CASE WHEN doc_id % 3 = 0 THEN 'https://example.org/dmf/2.0' ELSE 'http://www.isotc211.org/2005/gmd' END AS md_standard_uri,
        concat('<gmd:MD_Metadata>', CASE WHEN doc_id % 2 = 0 THEN '<gmd:fileIdentifier>x</gmd:fileIdentifier>' ELSE '' END, CASE WHEN doc_id % 5 <> 0 THEN '<gmd:language>eng</gmd:language><gmd:characterSet/>' ELSE '' END,
          CASE WHEN doc_id % 7 = 0 THEN '<gmd:hierarchyLevel><gmd:MD_ScopeCode codeListValue="dataset">d</gmd:MD_ScopeCode></gmd:hierarchyLevel>' ELSE '<hierarchyLevel><MD_ScopeCode>series</MD_ScopeCode></hierarchyLevel>' END,
          '<gmd:contact/><gmd:dateStamp>2025-01-01</gmd:dateStamp><gmd:identificationInfo/></gmd:MD_Metadata>') AS metadata FROM {documents}""",
    "reference": """SELECT concat('f', doc_id % 25) AS file, CASE doc_id % 5 WHEN 0 THEN 'geopackage' WHEN 1 THEN 'table' WHEN 2 THEN 'column' WHEN 3 THEN 'row/col' ELSE 'row' END AS reference_scope,
        CASE WHEN doc_id % 10 <> 0 THEN concat('t', doc_id) END AS table_name, CASE WHEN doc_id % 5 = 2 THEN 'c' END AS column_name, CASE WHEN doc_id % 5 > 2 THEN doc_id END AS row_id_value,
        doc_id + CASE WHEN doc_id % 19 = 0 THEN 1000000 ELSE 0 END AS md_file_id, CASE WHEN doc_id % 3 = 0 THEN doc_id - CASE WHEN doc_id % 2 = 0 THEN 25 ELSE 1 END END AS md_parent_id FROM {labels}
        UNION ALL SELECT concat('f', c_nationkey), 'table', concat('t', c_custkey), NULL, NULL, c_custkey, NULL FROM {customer} WHERE c_custkey % 3 <> 0""",
    "features": """SELECT concat('f', user_id % 25) AS file, concat('layer_', event_type) AS table_name, event_id AS fid,
        ((event_id * 7919) % 36000 - 18000) / 1e2 AS lon, ((event_id * 104729) % 16000 - 8000) / 1e2 AS lat, CASE WHEN event_id % 13 <> 0 THEN 1 END AS geom,
        CASE WHEN event_id % 13 = 0 THEN ' TBD ' WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS note, CASE WHEN user_id % 2 = 0 THEN NULL ELSE 'n/a' END AS status, props,
        CASE WHEN event_id % 10 < 8 THEN 'POINT' WHEN event_type = 'view' THEN 'POINT' ELSE 'MULTIPOINT' END AS geometry_type FROM {events}""",
    "entries": """SELECT concat('f', user_id % 25) AS file, concat('layer_', event_type) AS table_name, event_id AS id, ((event_id * 7919) % 36000 - 18000) / 1e2 AS minx, ((event_id * 104729) % 16000 - 8000) / 1e2 AS miny,
        ((event_id * 7919) % 36000 - 18000) / 1e2 + value / 1e3 AS maxx, ((event_id * 104729) % 16000 - 8000) / 1e2 + 1 AS maxy FROM {events} WHERE event_id % 13 <> 0 OR user_id % 25 < 5""",
    "layers": """SELECT DISTINCT concat('f', user_id % 25) AS file, concat('layer_', event_type) AS table_name, -179e0 AS min_x, -80e0 AS min_y, 180e0 + user_id % 25 AS max_x, 81e0 AS max_y FROM {events}""",
    "schema": """SELECT concat('f', c_nationkey) AS file, concat('t', c_custkey + CASE WHEN c_custkey % 29 = 0 THEN 1000000 ELSE 0 END) AS table_name, 'fid' AS column_name FROM {customer}
        UNION ALL SELECT concat('f', n_nationkey), 'gpkg_metadata_reference', c FROM {nation} CROSS JOIN (SELECT 'reference_scope' AS c UNION ALL SELECT 'md_file_id' UNION ALL SELECT 'md_parent_id') AS s WHERE n_nationkey % 4 <> 0 OR c <> 'md_parent_id'""",
    "coverage": f"""SELECT {_CUSTOMER}, CASE WHEN c_custkey % 5 = 0 THEN 'rainfall' WHEN c_custkey % 5 = 1 THEN NULL ELSE 'Elevation of ground' END AS quantity_definition, CASE WHEN c_custkey % 3 = 0 THEN 'Height' WHEN c_custkey % 11 = 0 THEN NULL ELSE 'depth' END AS field_name,
        CASE WHEN c_custkey % 7 = 0 THEN 'grid-value-is-corner' WHEN c_custkey % 13 = 0 THEN NULL ELSE 'grid-value-is-center' END AS grid_cell_encoding FROM {{customer}} WHERE c_custkey % 4 = 2""",
    "facts": """SELECT concat('f', s) AS file, CASE WHEN s % 3 = 0 THEN 'GDAL' ELSE 'ARCGIS' END AS software, CAST(r AS INT) AS req, CASE WHEN s % 9 = 0 AND k % 2 = 0 THEN 'PASS' WHEN s % 4 = 1 THEN CASE WHEN k % 3 = 0 THEN 'PASS*' ELSE 'PASS' END
        ELSE CASE k % 8 WHEN 0 THEN 'PASS' WHEN 1 THEN 'PASS*' WHEN 2 THEN 'FAIL' WHEN 3 THEN 'SKIPPED' WHEN 4 THEN CASE WHEN s % 5 = 0 THEN 'ERROR' ELSE 'PASS' END WHEN 5 THEN 'N/A' WHEN 6 THEN 'PASS*' ELSE 'PASS' END END AS status, k % 4 AS confirmed, k % 4 + (k % 3) AS total_n
        FROM (SELECT l_suppkey AS s, l_partkey % 37 + 1 AS r, min(l_orderkey * 3 + l_linenumber) AS k FROM {lineitem} GROUP BY l_suppkey, l_partkey % 37 + 1) AS f""",
    "signals": """SELECT concat('f', l_suppkey) AS file, l_linenumber AS signal, sum(l_partkey) % 5 = 0 AS gdal, sum(l_orderkey) % 4 = 0 AS arcgis FROM {lineitem} WHERE l_linenumber <= 5 GROUP BY l_suppkey, l_linenumber""",
}


class Views:
    """The views of one folder of tables as DataFrames: ``Views(spark, dir).contents``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        if name not in VIEWS:
            raise AttributeError(name)
        text = VIEWS[name]
        return self.spark.sql(text, **{t: self.table(t) for t in TABLES if f"{{{t}}}" in text})


def sql(body: str) -> str:
    """DuckDB SQL: ``body`` with the views that it names as common table expressions."""
    import re

    used = [v for v in VIEWS if re.search(rf"\b{v}\b", body)]
    recursive = "RECURSIVE " if "RECURSIVE" in body else ""
    ctes = [f"{v} AS ({VIEWS[v].format(**{t: t for t in TABLES}).replace(' AS STRING', ' AS VARCHAR')})" for v in used]
    body = body.replace("RECURSIVE", "").strip()
    if body.startswith("WITH "):
        return f"WITH {recursive}{', '.join([*ctes, ''])}{body[5:]}"
    return f"WITH {recursive}{', '.join(ctes)} {body}" if ctes else body
