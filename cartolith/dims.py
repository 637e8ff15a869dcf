"""Constant tables of the profile and of the public OGC and EPSG registries (fixed values)."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame, SparkSession

WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563

UTM = [*range(32601, 32661), *range(32701, 32761)]
#: Codes that a data type may use, as the validating side has them.
VALIDATE = {
    "raster": [3395, 3857, 4326, 4979, 5041, 5042, *UTM],
    "gridded_2d": [3395, 3857, 4326, 5041, 5042, *UTM],
    "gridded_3d": [4979, *range(100100, 100400)],
    "vector_2d": [4326],
    "vector_3d": [4979, 9518],
}
#: The same as the converting side has them; the two differ on purpose.
CONVERT = {
    "vector_2d": [4326],
    "vector_3d": [4978, 4979, 9518],
    "raster_tiles": [3395, 3857, 4326, 4979, 5041, 5042],
    "gridded_2d": [3395, 3857, 4326, 5041, 5042, *UTM],
    "gridded_3d": [4979, 9518],
}
APPROVED = sorted({c for codes in CONVERT.values() for c in codes})

#: Pixel size at zoom 0 of the well-known tile matrix sets.
PIXEL_Z0 = {
    3857: 2 * pi * WGS84_A / 256,
    3395: 2 * pi * WGS84_A / 256,
    4326: 360.0 / 512,
    4979: 360.0 / 512,
    5041: 28881518.7 / 256,
    5042: 28881518.7 / 256,
}
PIXEL_TOLERANCE = 1e-4

#: Valid area of each code: min_x, min_y, max_x, max_y.
EXTENT = {
    3857: (-20037508.3428, -20037508.3428, 20037508.3428, 20037508.3428),
    3395: (-20037508.3428, -15496570.7397, 20037508.3428, 18764656.2314),
    4326: (-180.0, -90.0, 180.0, 90.0),
    4979: (-180.0, -90.0, 180.0, 90.0),
    5041: (-14440759.35, -14440759.35, 14440759.35, 14440759.35),
    5042: (-14440759.35, -14440759.35, 14440759.35, 14440759.35),
    **{32600 + z: (100000.0, 0.0, 900000.0, 9329005.0) for z in range(1, 61)},
    **{32700 + z: (100000.0, 1116915.0, 900000.0, 10000000.0) for z in range(1, 61)},
}

#: Settings of conversion by purpose (fixed values).
PROFILES = {
    "default": {"security": "UNCLASSIFIED", "language": "eng", "topic": "location"},
    "civilian": {"security": "UNCLASSIFIED", "language": "eng", "topic": "environment"},
    "military": {"security": "CONFIDENTIAL", "language": "eng", "topic": "intelligenceMilitary"},
    "high_security": {"security": "SECRET", "language": "eng", "topic": "intelligenceMilitary"},
}
#: Standard that documents of the metadata profile name.
PROFILE_URI = "https://dgiwg.org/std/dmf/2.0"
#: Definitions to write, by code.
_BASE = '"WGS 84",ENSEMBLE["World Geodetic System 1984 ensemble",MEMBER["World Geodetic System 1984 (G2139)"],ELLIPSOID["WGS 84",6378137,298.257223563],ENSEMBLEACCURACY[2.0]],PRIMEM["Greenwich",0,ANGLEUNIT["degree",0.0174532925199433]]'
WKT2 = {
    4326: f'GEOGCRS[{_BASE},CS[ellipsoidal,2],AXIS["Lat",north],AXIS["Lon",east],ANGLEUNIT["degree",0.0174532925199433],ID["EPSG",4326]]',
    **{
        code: f'PROJCRS["{name}",BASEGEOGCRS[{_BASE}],CONVERSION["{name}",METHOD["{method}"]],CS[Cartesian,2],AXIS["x",east],AXIS["y",north],LENGTHUNIT["metre",1],ID["EPSG",{code}]]'
        for code, name, method in [
            (3857, "WGS 84 / Pseudo-Mercator", "Popular Visualisation Pseudo Mercator"), (3395, "WGS 84 / World Mercator", "Mercator (variant A)"),
            (5041, "WGS 84 / UPS North (E,N)", "Polar Stereographic (variant A)"), (5042, "WGS 84 / UPS South (E,N)", "Polar Stereographic (variant A)"),
            *[(32600 + z, f"WGS 84 / UTM zone {z}N", "Transverse Mercator") for z in range(1, 61)], *[(32700 + z, f"WGS 84 / UTM zone {z}S", "Transverse Mercator") for z in range(1, 61)],
        ]
    },
}

#: Extension: use with features, tiles and gridded data (M, O, N or NA).
EXTENSIONS = {
    "gpkg_rtree_index": ("M", "NA", "NA"),
    "gpkg_metadata": ("M", "M", "M"),
    "gpkg_crs_wkt": ("M", "M", "N"),
    "gpkg_crs_wkt_1_1": ("O", "O", "M"),
    "gpkg_schema": ("O", "O", "O"),
    "related_tables": ("O", "O", "O"),
    "gpkg_2d_gridded_coverage": ("NA", "NA", "M"),
    "gpkg_geom_": ("N", "NA", "NA"),
    "gpkg_zoom_other": ("NA", "N", "NA"),
    "gpkg_webp": ("NA", "N", "NA"),
}
CATEGORIES = ("features", "tiles", "gridded")

#: Reference scope: metadata scopes it may point to.
SCOPES = {
    "geopackage": ["undefined", "dataset", "series", "featureType", "model", "tile", "attribute", "attributeType", "collectionHardware", "collectionSession", "nonGeographicDataset", "fieldSession", "software", "service", "dimensionGroup"],
    "table": ["dataset", "featureType", "feature", "tile", "model", "series", "software", "service"],
    "column": ["featureType", "attribute", "attributeType"],
    "row/col": ["feature"],
    "row": ["feature", "tile", "model"],
}
MANDATORY_ELEMENTS = ["fileIdentifier", "language", "characterSet", "hierarchyLevel", "contact", "dateStamp", "identificationInfo"]
#: Children that a document of the metadata profile may have besides.
OPTIONAL_ELEMENTS = ["referenceSystemInfo", "distributionInfo", "dataQualityInfo", "metadataConstraints", "spatialRepresentationInfo"]
#: Code lists MD_CharacterSetCode and MD_ScopeCode of the public metadata standard ISO 19115 (fixed values).
CHARSETS = [
    "ucs2", "ucs4", "utf7", "utf8", "utf16", "8859part1", "8859part2", "8859part3", "8859part4", "8859part5", "8859part6", "8859part7", "8859part8", "8859part9", "8859part10", "8859part11",
    "8859part13", "8859part14", "8859part15", "8859part16", "jis932", "shiftJIS", "eucJP", "usAscii", "ebcdic", "eucKR", "big5", "GB2312",
]
SCOPE_CODES = [
    "attribute", "attributeType", "collectionHardware", "collectionSession", "dataset", "series", "nonGeographicDataset", "dimensionGroup", "feature", "featureType", "propertyType",
    "fieldSession", "software", "service", "model", "tile", "metadata", "initiative", "sample", "document", "repository", "aggregate", "product", "collection", "coverage", "application",
]
#: Requirements whose best status is PASS*, as a part of them cannot be checked here.
BEST_IS_PARTIAL = [5, 9, 10, 12, 13, 14, 20, 23, 28, 29, 33]
#: Spellings of the datum that all allowed codes have.
WGS84_NAMES = ["WGS 84", "WGS84", "WORLD GEODETIC SYSTEM 1984", "WORLD GEODETIC SYSTEM 1984 ENSEMBLE", "WORLD GEODETIC SYSTEM (WGS 1984)"]
#: Codes beside the policies that a file may list.
LISTED = [4978]
#: Requirements by obligation: mandatory and conditional.
MANDATORY = [1, 2, 3, 5, 7, 8, 9, 10, 11, 12, 13, 15, 18, 19, 20, 24, 25, 26, 27, 30]
CONDITIONAL = [4, 6, 14, 16, 17, 21, 22, 23, 28, 29, 31, 32, 33, 34, 35, 36, 37]
#: Requirements whose findings a person looks at again unless they pass (fixed values).
SECOND_LOOK = [3, 5, 11, 12, 14, 22, 24, 25, 32]
#: Short names of the requirements, 1 to 37.
NAMES = (
    "base format", "options", "mandatory extensions", "optional extensions", "extensions not allowed", "conditional extensions", "raster systems", "tile matrix dimensions", "flat vector systems",
    "solid vector systems", "flat gridded systems", "solid gridded systems", "definitions of systems", "use of compound systems", "compound definitions of vectors", "compound definitions of grids", "epochs",
    "documents of the profile", "metadata documents", "columns of metadata", "references to metadata", "metadata of the product", "partial metadata of the product", "data validity", "tile matrix columns",
    "tile images", "zoom factor", "order of zoom levels", "uniform tiles", "extent of tiles", "metadata of tile layers", "metadata of feature layers", "gridded core", "gridded field name",
    "gridded cell value", "gridded zoom factor", "metadata of grids",
)
PLACEHOLDERS = ("", "tbd", "tbc", "n/a", "na", "none", "unknown", "null", "?")
TILE_SIZE = 256
METADATA_REQUIREMENTS = [18, 19, 20, 21, 22, 23, 31, 32]


def extents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in EXTENT.items()], "srs_id int, e_min_x double, e_min_y double, e_max_x double, e_max_y double")


def pixel_sizes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*PIXEL_Z0.items()], "srs_id int, pz0 double")


def extension_rules(spark: SparkSession) -> DataFrame:
    """One row for each extension and data category."""
    return spark.createDataFrame([(e, c, u) for e, uses in EXTENSIONS.items() for c, u in zip(CATEGORIES, uses)], "extension_name string, category string, use string")


def scope_pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, m) for r, allowed in SCOPES.items() for m in allowed], "reference_scope string, md_scope string")


def obligations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, "M") for r in MANDATORY] + [(r, "C") for r in CONDITIONAL], "req int, obligation string")
