"""Second looks at partial passes: how many rows of a file confirm a requirement, of how many.

Each scorer returns ``file, req, confirmed, total``; a file without rows to look at has no
row.  Scorers are grouped sums of one boolean, so they combine before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import text
from . import catalog, zoom


def score(rows: DataFrame, req: int, ok: Column) -> DataFrame:
    return rows.groupBy("file").agg(F.lit(req).alias("req"), F.count_if(F.coalesce(ok, F.lit(False))).alias("confirmed"), F.count("*").alias("total"))


def filled(c: Column) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def definition(srs: DataFrame) -> Column:
    return F.coalesce(F.col("definition_12_063"), F.col("definition"), F.lit(""))


def mandatory_extensions(contents: DataFrame, extensions: DataFrame) -> DataFrame:
    """Requirement 3: mandatory (extension, category) pairs registered with a table name."""
    rules = F.broadcast(dims.extension_rules(contents.sparkSession).filter("use = 'M'"))
    need = catalog.categories(contents).join(rules, "category").select("file", "category", "extension_name")
    have = extensions.groupBy("file", "extension_name").agg(F.max(filled(F.col("table_name"))).alias("named"))
    return score(need.join(have, ["file", "extension_name"], "left"), 3, F.col("named"))


def named_extensions(extensions: DataFrame) -> DataFrame:
    return score(extensions, 4, filled(F.col("table_name")))


def tile_systems(sets: DataFrame, srs: DataFrame) -> DataFrame:
    """Requirement 7: a name, and no other EPSG code in the definition than the system's own."""
    rows = sets.select("file", "table_name", "srs_id").join(srs.select("file", "srs_id", "srs_name", definition(srs).alias("wkt")), ["file", "srs_id"], "left")
    code = text.last_epsg(F.coalesce("wkt", F.lit("")))
    return score(rows, 7, filled(F.col("srs_name")) & (code.isNull() | (code == F.col("srs_id"))))


def aligned_sets(matrix: DataFrame, sets: DataFrame) -> DataFrame:
    return score(zoom.grid_aligned(matrix, sets), 8, F.col("aligned"))


def vector_systems(geometry_columns: DataFrame, *, z: bool) -> DataFrame:
    rows = geometry_columns.filter("z <> 0" if z else "z = 0")
    return score(rows, 10 if z else 9, catalog.allowed(F.col("srs_id"), "vector_3d" if z else "vector_2d"))


def long_definitions(srs: DataFrame) -> DataFrame:
    """Requirement 13: definitions of over 20 characters whose last EPSG code is the system's."""
    rows = srs.filter("srs_id > 0").withColumn("wkt", definition(srs))
    return score(rows, 13, (F.length("wkt") > 20) & (text.last_epsg(F.col("wkt")) == F.col("srs_id")))


def compound_only_in_3d(geometry_columns: DataFrame, srs: DataFrame) -> DataFrame:
    rows = geometry_columns.join(srs.select("file", "srs_id", definition(srs).alias("wkt")), ["file", "srs_id"]).filter(F.upper("wkt").contains("COMPOUND"))
    return score(rows, 14, F.col("z") != 0)


def complete_metadata(metadata: DataFrame) -> DataFrame:
    """Requirement 18: documents of the metadata profile with all mandatory elements."""
    return score(metadata.filter(F.lower("md_standard_uri").rlike("dgiwg|dmf")), 18, text.elements_present(F.col("metadata")) == 7)


def whole_file_references(reference: DataFrame) -> DataFrame:
    return score(reference, 20, F.col("reference_scope") == "geopackage").withColumns({"confirmed": F.least("confirmed", F.lit(1)).cast("long"), "total": F.lit(1).cast("long")})


def partial_references(reference: DataFrame, metadata: DataFrame) -> DataFrame:
    """Requirement 21: references below the file that resolve to a document of an allowed scope."""
    docs = metadata.select("file", F.col("id").alias("md_file_id"), "md_scope").distinct()
    pairs = F.broadcast(dims.scope_pairs(reference.sparkSession).withColumn("fine", F.lit(True)))
    rows = reference.filter("reference_scope <> 'geopackage'").join(docs, ["file", "md_file_id"], "left").join(pairs, ["reference_scope", "md_scope"], "left")
    return score(rows, 21, F.col("fine"))


def series_documents(metadata: DataFrame) -> DataFrame:
    return score(metadata.filter("md_scope = 'series'"), 22, F.length("md_standard_uri") > 5)


def parents(reference: DataFrame, metadata: DataFrame) -> DataFrame:
    return catalog.parents_resolve(reference, metadata).select("file", F.lit(23).alias("req"), "confirmed", "total")


def square_levels(matrix: DataFrame) -> DataFrame:
    return score(matrix, 25, (F.col("tile_width") == dims.TILE_SIZE) & (F.col("tile_height") == dims.TILE_SIZE))


def populated_levels(matrix: DataFrame, tiles: DataFrame) -> DataFrame:
    """Requirement 28: tables of several levels with tiles on every declared one."""
    have = tiles.select("file", "table_name", "zoom_level").distinct().withColumn("there", F.lit(True))
    rows = matrix.join(have, ["file", "table_name", "zoom_level"], "left").groupBy("file", "table_name").agg(F.count("*").alias("n"), F.count("there").alias("k")).filter("n > 1")
    return score(rows, 28, F.col("n") == F.col("k"))


def single_levels(matrix: DataFrame) -> DataFrame:
    rows = matrix.groupBy("file", "table_name").agg(F.count("*").alias("n"), F.every((F.col("tile_width") == 256) & (F.col("tile_height") == 256)).alias("square")).filter("n = 1")
    return score(rows, 29, F.col("square"))


def boxes_within_sets(contents: DataFrame, sets: DataFrame) -> DataFrame:
    return zoom.bbox_within_set(contents, sets).select("file", F.lit(30).alias("req"), "confirmed", "total")


def linked_layers(contents: DataFrame, reference: DataFrame, kind: str) -> DataFrame:
    names = reference.filter("reference_scope = 'table'").select("file", "table_name").distinct().withColumn("linked", F.lit(True))
    return score(contents.filter(F.col("data_type") == kind).join(names, ["file", "table_name"], "left"), 31 if kind == "tiles" else 32, F.col("linked"))


def complete_coverages(coverage: DataFrame) -> DataFrame:
    ok = filled(F.col("quantity_definition")) & filled(F.col("field_name")) & filled(F.col("grid_cell_encoding"))
    return score(coverage, 33, ok)


def extension_audit(extensions: DataFrame) -> DataFrame:
    """Each registered extension: known, left by the common open-source writer, or unknown."""
    known = [e for e in dims.EXTENSIONS if not e.endswith("_")]
    kind = F.when(F.col("extension_name").isin(known) | F.col("extension_name").startswith("gpkg_geom_"), "known").when(F.col("extension_name").startswith("gdal"), "gdal").otherwise("unknown")
    return extensions.groupBy("file", kind.alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("extension_name").alias("n_names"))


def definition_audit(srs: DataFrame) -> DataFrame:
    """Definitions by how they start and who issued them."""
    d = F.coalesce("definition", F.lit(""))
    start = F.when(F.upper(d).rlike(r"^\s*(" + "|".join(text.WKT2_ROOTS) + r")\["), "WKT2").when(text.is_wkt1(d), "WKT1").otherwise("none")
    return srs.filter("srs_id > 0").groupBy("file", start.alias("start")).agg(F.count("*").alias("n"), F.count_if(d.contains('AUTHORITY["ESRI"')).alias("n_esri"))


def reference_audit(reference: DataFrame) -> DataFrame:
    """Whole-file references that wrongly name a table, column or row."""
    whole = reference.filter("reference_scope = 'geopackage'")
    clean = F.col("table_name").isNull() & F.col("column_name").isNull() & F.col("row_id_value").isNull()
    return whole.groupBy("file").agg(F.count("*").alias("n"), F.count_if(~clean).alias("n_named"))


def _gridded(sets: DataFrame, contents: DataFrame, srs: DataFrame) -> DataFrame:
    grids = contents.filter(catalog.category(F.col("data_type")) == "gridded").select("file", "table_name")
    rows = sets.join(grids, ["file", "table_name"]).join(srs.select("file", "srs_id", F.upper(F.coalesce("definition", F.lit(""))).alias("d")), ["file", "srs_id"], "left")
    return rows.withColumn("three", (F.col("srs_id") == 4979) | F.coalesce(F.col("d").rlike("COMPOUNDCRS|COMPD_CS"), F.lit(False)))


def gridded_systems(sets: DataFrame, contents: DataFrame, srs: DataFrame, *, three: bool) -> DataFrame:
    """Requirements 11 and 12: coverages of two or three dimensions in a system of the list, or in a compound one."""
    rows = _gridded(sets, contents, srs).filter(F.col("three") == three)
    ok = catalog.allowed(F.col("srs_id"), "gridded_3d" if three else "gridded_2d") | (F.lit(three) & F.col("d").rlike("COMPOUNDCRS|COMPD_CS"))
    return score(rows, 12 if three else 11, ok)


def compound_definitions(srs: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Requirements 15 (all systems) and 16 (those of ``users``): compound definitions that are whole."""
    rows = srs.filter("srs_id > 0").withColumn("wkt", definition(srs)).filter(F.upper("wkt").rlike("COMPOUNDCRS|COMPD_CS"))
    if users is not None:
        rows = rows.join(users.select("file", "srs_id").distinct(), ["file", "srs_id"], "left_semi")
    return score(rows, 15 if users is None else 16, text.compound_problems(F.col("wkt")) == "")


def epochs(srs: DataFrame) -> DataFrame:
    return score(srs.filter("epoch IS NOT NULL AND epoch <> 0"), 17, F.col("epoch") > 0)


def whole_documents(metadata: DataFrame) -> DataFrame:
    """Requirement 19: documents of type text/xml that parse and have children."""
    from ..functions import xml

    rows = metadata.withColumn("f", xml.facts(F.col("metadata")))
    return score(rows, 19, (F.col("mime_type") == "text/xml") & F.col("f.ok") & (F.size("f.children") > 0))


def described_systems(srs: DataFrame) -> DataFrame:
    return score(srs.filter("srs_id > 0"), 24, (F.col("organization") == "EPSG") & filled(F.col("description")))


def sound_images(matrix: DataFrame, heads: DataFrame, contents: DataFrame) -> DataFrame:
    """Requirement 26: declared levels whose images are all of one format that the data type allows, and of the right size."""
    kind = contents.select("file", "table_name", catalog.category(F.col("data_type")).alias("kind"))
    fits = F.when(F.col("kind") == "gridded", F.col("format").isin("PNG", "TIFF")).otherwise(F.col("format").isin("PNG", "JPEG"))
    good = F.coalesce(fits & (F.col("width") == dims.TILE_SIZE) & (F.col("height") == dims.TILE_SIZE), F.lit(False))
    levels = heads.join(kind, ["file", "table_name"], "left").groupBy("file", "table_name", "zoom_level").agg((F.every(good) & (F.min("format") == F.max("format"))).alias("sound"))
    return score(matrix.select("file", "table_name", "zoom_level").join(levels, ["file", "table_name", "zoom_level"], "left"), 26, F.col("sound"))


def known_scopes(metadata: DataFrame) -> DataFrame:
    return score(metadata, 37, F.col("md_scope").isin(sorted({m for allowed in dims.SCOPES.values() for m in allowed})))


def raster_audit(sets: DataFrame, srs: DataFrame) -> DataFrame:
    """Matrix sets of any data type by their system: of the list, a conformal cone, own codes above 100000, or another."""
    rows = sets.select("file", "srs_id").join(srs.select("file", "srs_id", F.concat_ws(" ", "definition", "definition_12_063").alias("d")), ["file", "srs_id"], "left")
    kind = F.when(catalog.allowed(F.col("srs_id"), "raster"), "listed").when(catalog.is_lambert(F.col("d")), "cone").when(F.col("srs_id") > 100000, "own").otherwise("other")
    return rows.groupBy("file", kind.alias("kind")).agg(F.count("*").alias("n"))


def layer_audit(geometry_columns: DataFrame) -> DataFrame:
    """Feature layers, flat or not, that are not in 4326."""
    return geometry_columns.groupBy("file").agg(F.count("*").alias("n"), F.count_if(F.col("srs_id") != 4326).alias("n_other"))


def document_audit(metadata: DataFrame) -> DataFrame:
    """Documents by the standard that they name: how many are of another type, malformed, incomplete, or name a path of some machine."""
    from ..functions import xml

    uri = F.lower(F.coalesce("md_standard_uri", F.lit("")))
    kind = F.when(F.trim(uri) == "", "none").when(uri.contains("dgiwg") | uri.contains("dmf"), "profile").when(uri.contains("isotc211"), "iso").otherwise("other")
    rows = metadata.withColumns({"f": xml.facts(F.col("metadata")), "kind": kind})
    path = F.coalesce(F.col("metadata").rlike(r"(?i)[a-z]:\\|file://|/(home|users|tmp)/"), F.lit(False))
    needed = F.array(*[F.lit(e) for e in dims.MANDATORY_ELEMENTS])
    return rows.groupBy("file", "kind").agg(
        F.count("*").alias("n"), F.count_if(F.coalesce(F.col("mime_type") != "text/xml", F.lit(True))).alias("n_other_type"), F.count_if(~F.col("f.ok")).alias("n_malformed"),
        F.count_if(F.col("f.ok") & (F.size(F.array_except(needed, "f.children")) > 0)).alias("n_incomplete"), F.count_if(path).alias("n_paths"),
    )


def product_audit(metadata: DataFrame) -> DataFrame:
    """Documents of a product; a series comes before a dataset."""
    counts = metadata.groupBy("file").agg(F.count_if(F.col("md_scope") == "series").alias("n_series"), F.count_if(F.col("md_scope") == "dataset").alias("n_dataset"))
    return counts.withColumn("product", F.when(F.col("n_series") > 0, "series").when(F.col("n_dataset") > 0, "dataset"))


def software_signals(c) -> DataFrame:
    """``file, signal, gdal, arcgis``: traces of the writing software in a catalog, for ``scoring.software_vote``.

    All rows of a table are looked at, not the first few.
    """
    has = lambda x, *words: F.coalesce(F.lower(x).rlike("|".join(words)), F.lit(False))
    document = lambda *words: has(F.col("md_standard_uri"), *words)
    systems = c.srs.filter("srs_id > 0")
    found = [
        (1, True, c.schema.filter("table_name = 'gpkg_ogr_contents'")),
        (2, True, c.extensions.filter(F.lower("extension_name").startswith("gdal"))),
        (3, True, c.metadata.filter(document("gdal", "ogr") | has(F.col("metadata"), "gdal", "ogr", "qgis"))),
        (4, True, systems.filter(has(F.col("srs_name"), "gdal") | has(F.col("definition"), "gdal"))),
        (5, False, c.srs.filter("srs_id > 100000")),
        (6, False, systems.filter(has(F.col("srs_name"), "esri") | has(F.col("organization"), "esri"))),
        (7, False, c.metadata.filter(document("esri") | has(F.col("metadata"), "esri", "arcgis", "geodatabase"))),
        (8, False, c.schema.filter(F.col("table_name").ilike("gdb_%"))),
        (9, False, systems.filter(F.col("definition").contains('AUTHORITY["ESRI"'))),
    ]
    rows = [r.select("file", F.lit(i).alias("signal"), F.lit(g).alias("gdal"), F.lit(not g).alias("arcgis")) for i, g, r in found]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    none = c.files.select("file", F.lit(0).alias("signal"), F.lit(False).alias("gdal"), F.lit(False).alias("arcgis"))
    return out.distinct().unionByName(none)
