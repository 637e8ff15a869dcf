"""The requirements as evidence: each rule gives rows ``file, req, level, note``.

Level 2 is a violation, 1 something that cannot be confirmed, 0 that the rule applies.  A
file without a row for a rule is skipped by it.  What concerns a file as a whole (tables and
columns that it has, kinds of data, counts of documents) is one wide row for each file, from
one grouped pass over each table, and its rules are an array of that row.  The other rules are
column expressions and equi-joins on ``file``; statuses are one grouped maximum over the
evidence of all rules together.  Constant tables of fixed size are broadcast, the others are
left to Spark.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions import text, wkt, xml
from . import catalog, zoom

FAIL, PARTIAL, FINE = 2, 1, 0
LEVELS = "file string, req int, level int, note string"


def mark(rows: DataFrame, req: int, level: Column | int, note: Column | str = "") -> DataFrame:
    level = F.lit(level).cast("int") if isinstance(level, int) else level.cast("int")
    note = F.lit(note) if isinstance(note, str) else note
    return rows.select("file", F.lit(req).alias("req"), level.alias("level"), F.when(level > FINE, note).alias("note"))


def judge(rows: DataFrame, req: int, bad: Column, note: Column | str) -> DataFrame:
    """A row of evidence for each row: a violation where ``bad``."""
    return mark(rows, req, F.when(F.coalesce(bad, F.lit(False)), FAIL).otherwise(FINE), note)


def judges(rows: DataFrame, *rules: tuple) -> DataFrame:
    """``judge`` by several rules ``(where, req, bad, note)`` in one pass, so that joins behind ``rows`` are not repeated for each; a rule without ``where`` holds for all rows."""
    said = []
    for where, req, bad, note in rules:
        level = F.when(F.coalesce(bad, F.lit(False)), FAIL).otherwise(FINE)
        one = F.struct(F.lit(req).alias("req"), level.cast("int").alias("level"), F.when(level > FINE, F.lit(note) if isinstance(note, str) else note).alias("note"))
        said.append(one if where is None else F.when(where, one))
    return rows.select("file", F.explode(F.array(*said)).alias("x")).filter("x IS NOT NULL").select("file", "x.*")


def say(*parts) -> Column:
    """A note from texts and names of columns; a null column is left out."""
    return F.concat_ws(" ", *[F.col(p[1:]).cast("string") if p.startswith("$") else F.lit(p) for p in parts])


def either(first: DataFrame, *others: DataFrame) -> DataFrame:
    for o in others:
        first = first.unionByName(o)
    return first


def definition(preferred: str = "definition_12_063") -> Column:
    """The WKT2 text if there is one, else the other."""
    known = lambda c: F.nullif(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit("undefined"))
    return F.coalesce(known(preferred), known("definition"))


def compound(c: str) -> Column:
    upper = F.upper(F.coalesce(F.col(c), F.lit("")))
    return upper.contains("COMPOUNDCRS") | upper.contains("COMPD_CS")


def extension_rules(c, as_of: str) -> DataFrame:
    """Requirements 1 to 5: extensions and the base format."""
    cats = catalog.categories(c.contents)
    pragma = c.pragmas.groupBy("file").pivot("name", ["application_id", "user_version", "encoding", "journal_mode"]).agg(F.first("value"))
    app = F.col("application_id").cast("long")
    known = app.isin(0x47503132, 0x47503133, 0x47503134) | ((app == 0x47504B47) & (F.col("user_version").cast("long") >= 10200))
    stamp = catalog.timestamp_problem(F.col("last_change"), as_of)
    scope = F.lower(F.trim("scope"))
    scoped = c.extensions.filter(F.trim(F.coalesce("table_name", F.lit(""))) != "").join(c.contents.select("file", "table_name", catalog.category(F.col("data_type")).alias("category")), ["file", "table_name"])
    whole = c.extensions.filter(F.trim(F.coalesce("table_name", F.lit(""))) == "").join(cats, "file")
    rules = F.broadcast(dims.extension_rules(c.files.sparkSession).filter("use = 'N'").withColumnRenamed("extension_name", "rule"))
    hit = (F.col("category") == F.col("c2")) & ((F.col("extension_name") == F.col("rule")) | (F.col("rule").endswith("_") & F.col("extension_name").startswith(F.col("rule"))))
    barred = either(scoped.select("file", "extension_name", "category"), whole.select("file", "extension_name", "category")).join(rules.withColumnRenamed("category", "c2"), hit)
    return either(
        judges(
            pragma, (None, 3, ~F.coalesce(known, F.lit(False)), say("application id", "$application_id", "version", "$user_version")),
            (None, 3, F.upper("encoding") != "UTF-8", say("encoding", "$encoding")), (None, 3, F.lower("journal_mode") == "wal", "write-ahead log"),
        ),
        judge(c.contents, 3, stamp == "malformed", say("last_change of", "$table_name")),
        mark(catalog.missing_extensions(c.contents, c.extensions), 3, FAIL, say("no extension", "$extension_name")),
        judge(c.extensions, 3, (scope != "") & ~scope.isin("read-write", "write-only"), say("scope of", "$extension_name")),
        mark(catalog.registered_with_use(c.contents, c.extensions, "O"), 4, PARTIAL, say("optional", "$extension_name")),
        mark(barred, 5, FAIL, say("$extension_name", "with", "$category")),
        mark(c.heads.filter("format = 'WEBP'"), 5, FAIL, say("WEBP tile in", "$table_name")),
    ).join(cats.select("file").distinct(), "file", "left_semi")


def raster_rules(c) -> DataFrame:
    """Requirements 7 and 8: systems, pixel sizes and tile sizes of tile tables."""
    tiles = c.sets.join(c.contents.filter("data_type = 'tiles'").select("file", "table_name"), ["file", "table_name"])
    rows = tiles.select("file", "table_name", "srs_id").join(c.srs.select("file", "srs_id", F.concat_ws(" ", "definition", "definition_12_063").alias("wkt")), ["file", "srs_id"], "left")
    offsets = zoom.zoom_offset(c.matrix, tiles).select("file", "table_name", "n_wrong")
    rows = rows.join(offsets, ["file", "table_name"], "left")
    state = F.when(~catalog.allowed(F.col("srs_id"), "raster"), F.when(catalog.is_lambert(F.col("wkt")), "skip").otherwise("system")).when(F.col("n_wrong") > 0, "size").when(F.col("n_wrong").isNull(), "skip").otherwise("good")
    rows = rows.withColumn("state", state)
    bad = rows.filter("state IN ('system', 'size')")
    rest = rows.groupBy("file").agg(F.count_if(F.col("state") == "good").alias("good"), F.count_if(F.col("state") == "skip").alias("skip"))
    sizes = tiles.select("file", "table_name").join(c.matrix, ["file", "table_name"], "left")
    return either(
        mark(bad, 7, FAIL, F.when(F.col("state") == "system", say("$table_name", "uses system", "$srs_id")).otherwise(say("pixel sizes of", "$table_name"))),
        mark(rest, 7, F.when((F.col("skip") > 0) & (F.col("good") == 0), PARTIAL).otherwise(FINE), "pixel sizes have no standard here"),
        judge(sizes, 8, (F.col("tile_width") != dims.TILE_SIZE) | (F.col("tile_height") != dims.TILE_SIZE), say("$table_name", "level", "$zoom_level")),
    )


def system_rules(c) -> DataFrame:
    """Requirements 9 to 17: coordinate systems of layers and coverages, and their definitions."""
    layers = c.geometry_columns.join(c.srs.select("file", "srs_id", "definition"), ["file", "srs_id"], "left")
    named = say("$table_name", "uses system", "$srs_id")
    area = F.broadcast(dims.extents(c.files.sparkSession))
    grids = c.sets.join(c.contents.filter(catalog.category(F.col("data_type")) == "gridded").select("file", "table_name"), ["file", "table_name"])
    grids = grids.join(c.srs.select("file", "srs_id", "definition"), ["file", "srs_id"], "left")
    three = (F.col("srs_id") == 4979) | compound("definition")
    grids = grids.join(area, "srs_id", "left")
    tx, ty = (F.abs(F.col(f"e_max_{a}") - F.col(f"e_min_{a}")) * 0.001 for a in "xy")
    outside = (F.col("min_x") < F.col("e_min_x") - tx) | (F.col("min_y") < F.col("e_min_y") - ty) | (F.col("max_x") > F.col("e_max_x") + tx) | (F.col("max_y") > F.col("e_max_y") + ty)
    whole = F.col("min_x").isNotNull() & F.col("min_y").isNotNull() & F.col("max_x").isNotNull() & F.col("max_y").isNotNull()
    listed = sorted({x for codes in dims.VALIDATE.values() for x in codes} | set(dims.LISTED))
    used = c.srs.filter("srs_id > 0").withColumn("wkt", definition())
    problems = text.definition_problems(F.col("wkt"), F.col("srs_id"), F.col("srs_name"))
    unnamed = F.when(F.col("wkt").rlike(r"(?i)(METHOD|PROJECTION)\s*[\[(]"), "").otherwise("method")  # a definition without one leaves it open
    differs = F.array_except(F.split(wkt.structure_problems(F.col("wkt"), F.col("srs_id")), ","), F.array(F.lit(""), F.lit("code"), F.lit("axis order"), unnamed))
    compared = used.withColumns({"differs": F.coalesce(F.array_join(differs, ", "), F.lit("")), "problems": problems})
    solid = used.join(c.geometry_columns.filter("z <> 0").select("file", "srs_id").distinct(), ["file", "srs_id"], "left_semi").filter(compound("wkt"))
    covered = c.sets.join(c.coverage.select("file", "table_name").distinct(), ["file", "table_name"]).select("file", "srs_id").distinct()
    wkt2 = c.schema.filter("table_name = 'gpkg_spatial_ref_sys' AND column_name = 'definition_12_063'").select("file", F.lit(True).alias("has")).distinct()
    vertical = used.join(covered, ["file", "srs_id"], "left_semi").filter(compound("wkt")).join(wkt2, "file", "left")
    epoch = F.coalesce(F.round(text.frame_epoch(F.col("wkt")), 1) != F.round("epoch", 1), F.lit(True))
    return either(
        judges(
            layers, (F.col("z") == 0, 9, ~catalog.allowed(F.col("srs_id"), "vector_2d"), named), (F.col("z") != 0, 10, ~catalog.allowed(F.col("srs_id"), "vector_3d"), named),
            (F.col("z") == 0, 14, compound("definition"), say("$table_name", "is flat")),
        ),
        judges(
            grids, (~three, 11, ~catalog.allowed(F.col("srs_id"), "gridded_2d"), named), (~three, 11, whole & outside, say("box of", "$table_name")),
            (three, 12, ~catalog.allowed(F.col("srs_id"), "gridded_3d") & ~compound("definition"), named),
        ),
        judges(
            compared, (None, 13, ~F.col("srs_id").isin(listed) & ~text.is_dynamic(F.col("srs_id"), F.col("srs_name")), say("system", "$srs_id")),
            (None, 13, F.col("problems") != "", F.concat(say("system", "$srs_id", ": "), F.col("problems"))), (None, 13, F.col("differs") != "", F.concat(say("system", "$srs_id", "differs in: "), F.col("differs"))),
            (F.col("epoch") != 0, 17, epoch, say("epoch of system", "$srs_id")),
        ),
        judge(solid, 15, text.compound_problems(F.col("wkt")) != "", F.concat(say("system", "$srs_id", ": "), text.compound_problems(F.col("wkt")))),
        judge(vertical, 16, F.col("has").isNull() | (text.compound_problems(F.col("wkt")) != ""), say("system", "$srs_id")),
    )


def documents(c) -> DataFrame:
    """The documents with what the rules read in them, parsed once."""
    uri = F.lower(F.coalesce("md_standard_uri", F.lit("")))
    docs = c.metadata.withColumn("f", xml.facts(F.col("metadata")))
    later = F.coalesce(F.col("f.namespace").contains("/-3/") | F.col("f.namespace").contains("/gmi/"), F.lit(False))
    typed = F.col("mime_type").isNotNull() & (F.col("mime_type") != "text/xml")
    return docs.select(
        "file", "id", "md_scope", "mime_type", "md_standard_uri", typed.alias("typed"), (_blank("metadata") | ~F.col("f.ok")).alias("malformed"), (_blank("metadata") | ~F.col("f.ok") | (F.col("f.n_mandatory") == 0)).alias("barren"),
        (uri.contains("dgiwg") & uri.contains("dmf") & ~later).alias("read"), xml.field_problems(F.col("f")).alias("lack"),
    )


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


REFERENCES, COVERAGES = "gpkg_metadata_reference", "gpkg_2d_gridded_coverage_ancillary"
#: Requirement: table and columns that it must have.
COLUMNS = {
    20: ("gpkg_metadata", ["id", "md_scope", "md_standard_uri", "mime_type", "metadata"]),
    21: (REFERENCES, ["reference_scope", "table_name", "column_name", "row_id_value", "timestamp", "md_file_id"]),
    25: ("gpkg_tile_matrix_set", ["table_name", "srs_id", "min_x", "min_y", "max_x", "max_y"]),
    33: (COVERAGES, ["tile_matrix_set_name", "field_name", "quantity_definition", "grid_cell_encoding"]),
}
TILE_SCOPES, FEATURE_SCOPES = ["model", "tile"], ["featureType", "feature"]


def file_rules(c, docs: DataFrame, linked: DataFrame) -> DataFrame:
    """What the rules say of a file as a whole."""
    kind = catalog.category(F.col("data_type"))
    catalogs = sorted({t for t, _ in COLUMNS.values()} | {"gpkg_geometry_columns", "gpkg_tile_matrix", "gpkg_2d_gridded_tile_ancillary"})
    own = c.schema.filter(F.col("table_name").isin(catalogs))
    whole = (F.col("reference_scope") == "geopackage") & F.col("table_name").isNull() & F.col("column_name").isNull() & F.col("row_id_value").isNull()
    count = lambda cond, name: F.count_if(cond).alias(name)
    parts = [
        own.groupBy("file").agg(F.collect_set("table_name").alias("tables"), F.collect_set(F.concat_ws(".", "table_name", "column_name")).alias("columns")),
        c.contents.groupBy("file").agg(*[count(kind == k, k) for k in dims.CATEGORIES]),
        docs.groupBy("file").agg(F.count("*").alias("docs"), count(F.col("read"), "read"), count(F.col("mime_type") == "text/xml", "xml"), count(F.col("md_scope").isin("series", "dataset"), "products")),
        c.reference.groupBy("file").agg(F.count("*").alias("references"), count(whole, "anchors")),
        linked.groupBy("file").agg(count(F.col("md_scope").isin(TILE_SCOPES), "tile_docs"), count(F.col("md_scope").isin(FEATURE_SCOPES), "feature_docs")),
        c.extensions.filter("extension_name = 'gpkg_2d_gridded_coverage'").groupBy("file").agg(F.count("*").alias("gridded_extension")),
        c.heads.groupBy("file").agg(F.count("*").alias("images")), c.sets.groupBy("file").agg(F.count("*").alias("n_sets")),
    ]
    row = c.files.select("file")
    for p in parts:
        row = row.join(p, "file", "left")
    none = lambda n: F.coalesce(F.col(n), F.lit(0)) == 0
    has = lambda t: F.coalesce(F.array_contains("tables", t), F.lit(False))
    tiled, data = ~none("tiles") | ~none("gridded"), ~none("tiles") | ~none("gridded") | ~none("features")
    always, no_references, no_metadata = F.lit(True), ~has(REFERENCES), ~has("gpkg_metadata")
    absent = lambda t: f"no table {t}"
    rules = [
        (4, FINE, data, ""), (5, FINE, data, ""), (14, FINE, always, ""),
        (18, FAIL, none("docs"), "no documents"), (18, PARTIAL, ~none("docs") & none("read"), "no document of the profile"),
        (19, FAIL, no_references, absent(REFERENCES)), (19, FAIL, no_metadata, absent("gpkg_metadata")), (19, FAIL, none("anchors"), "no reference for the whole file"), (19, FINE, always, ""),
        (20, FAIL, no_metadata, absent("gpkg_metadata")), (20, FINE, always, ""),
        (21, FAIL, no_references, absent(REFERENCES)), (21, PARTIAL, has(REFERENCES) & none("references"), "no references"),
        (22, FAIL, none("products"), "no document of a product"),
        (23, FAIL, none("anchors"), "no reference for the whole file"), (23, FINE, always, ""),
        (24, FINE, always, ""), (24, FAIL, ~none("features") & ~has("gpkg_geometry_columns"), absent("gpkg_geometry_columns")),
        (24, FAIL, tiled & ~has("gpkg_tile_matrix_set"), absent("gpkg_tile_matrix_set")), (24, FAIL, tiled & ~has("gpkg_tile_matrix"), absent("gpkg_tile_matrix")),
        (25, FINE, tiled, ""), (25, FAIL, tiled & ~has("gpkg_tile_matrix_set"), absent("gpkg_tile_matrix_set")),
        (26, PARTIAL, ~none("n_sets") & none("images"), "no tiles"),
        (31, FAIL, no_references, absent(REFERENCES)), (31, PARTIAL, none("tile_docs"), "no documents of layers"),
        (32, FAIL, no_references, absent(REFERENCES)), (32, PARTIAL, none("feature_docs"), "no documents of layers"), (32, FAIL, has("gpkg_metadata") & none("xml"), "no document of type text/xml"),
        (33, FINE, has(COVERAGES), ""), (33, FAIL, has(COVERAGES) & none("gridded_extension"), "extension not registered"), (33, FAIL, has(COVERAGES) & ~has("gpkg_2d_gridded_tile_ancillary"), absent("gpkg_2d_gridded_tile_ancillary")),
        *[(req, FAIL, has(t) & (tiled if req == 25 else always) & ~F.array_contains("columns", f"{t}.{name}"), f"no column {name}") for req, (t, names) in COLUMNS.items() for name in names],
    ]
    said = F.array(*[F.when(cond, F.struct(F.lit(req).alias("req"), F.lit(level).alias("level"), F.lit(note or None).cast("string").alias("note"))) for req, level, cond, note in rules])
    return row.select("file", F.explode(F.filter(said, lambda x: x.isNotNull())).alias("x")).select("file", "x.*")


def metadata_rules(c, docs: DataFrame, linked: DataFrame) -> DataFrame:
    """Requirements 18 to 22, 31, 32 and 37: documents, and references between them and tables."""
    document = say("document", "$id")
    pair = say("document", "$md_file_id", ":", "$reference_scope", "with", "$md_scope")
    stamped = F.coalesce(F.trim("timestamp"), F.lit("")) != ""
    references = c.schema.filter(F.col("table_name") == REFERENCES).select("file").distinct()
    unfit = F.col("fine").isNull()

    def layer(req: int, kind: str) -> DataFrame:
        unlinked = catalog.unlinked_layers(c.contents, c.reference, kind).join(references, "file", "left_semi")
        return mark(unlinked, req, FAIL, say("nothing refers to", "$table_name"))

    grids = c.coverage.select("file", "table_name").distinct()
    around = linked.join(grids.withColumn("own", F.lit(True)), ["file", "table_name"], "left").filter("own OR reference_scope = 'geopackage'").join(grids.select("file").distinct(), "file", "left_semi")
    orphans = c.reference.join(c.metadata.select("file", F.col("id").alias("md_file_id")), ["file", "md_file_id"], "left_anti")
    return either(
        judges(
            docs, (F.col("read"), 18, F.col("lack") != "", F.concat(document, F.lit(": "), F.col("lack"))), (None, 19, F.col("typed"), document),
            (None, 19, F.col("malformed"), F.concat(document, F.lit(" is not well-formed"))), (F.col("md_scope").isin("series", "dataset"), 22, F.col("typed") | F.col("barren"), document),
        ),
        judges(
            linked, (None, 19, unfit, pair), (None, 21, unfit, pair), (F.col("fine"), 21, stamped & ~text.is_stamp(F.trim("timestamp")), say("timestamp of", "$md_file_id")),
            (F.col("md_scope").isin(TILE_SCOPES), 31, unfit | _blank("md_standard_uri") | F.col("barren"), pair), (F.col("md_scope").isin(FEATURE_SCOPES), 32, unfit | F.col("barren"), pair),
        ),
        judges(orphans, *[(None, req, F.lit(True), say("no document", "$md_file_id")) for req in (21, 24)]),
        layer(31, "tiles"), layer(32, "features"),
        judge(around, 37, unfit | F.col("barren"), pair),
    )


def data_rules(c) -> DataFrame:
    """Requirement 24: what the catalog names is there, layers have keys, sound indexes and the geometries that they declare; attributes that say nothing are told."""
    declared = c.contents.select("file", "table_name").distinct()
    there = c.schema.select("file", "table_name").distinct()
    layers = c.geometry_columns.select("file", "table_name", "column_name", "geometry_type_name", "z", "m")
    key = c.schema.filter("pk > 0").groupBy("file", "table_name").agg(F.count("*").alias("n_keys"), F.max(F.upper("type")).alias("key_type"))
    keyed = layers.join(there, ["file", "table_name"], "left_semi").join(key, ["file", "table_name"], "left")
    rows = c.shapes.groupBy("file", "table_name").agg(F.count_if(~F.col("empty")).alias("n_shapes"))
    indexed = layers.join(c.index.withColumnsRenamed({x: f"i_{x}" for x in ("min_x", "min_y", "max_x", "max_y")}), ["file", "table_name"], "left").join(rows, ["file", "table_name"], "left")
    indexed = indexed.join(c.contents.select("file", "table_name", "min_x", "min_y", "max_x", "max_y"), ["file", "table_name"], "left")
    beyond = (F.col("i_min_x") < F.col("min_x") - 1e-6) | (F.col("i_min_y") < F.col("min_y") - 1e-6) | (F.col("i_max_x") > F.col("max_x") + 1e-6) | (F.col("i_max_y") > F.col("max_y") + 1e-6)
    shapes = c.shapes.filter("NOT empty").join(layers, ["file", "table_name"])
    declares = lambda d, h: (F.col(d) == 1) & ~F.col(h) | (F.col(d) == 0) & F.col(h)
    wanted = F.regexp_replace(F.upper("geometry_type_name"), "[ZM]+$", "")
    free = wanted.isin("GEOMETRY", "GEOMETRYCOLLECTION", "") | wanted.isNull()
    name = lambda why: F.concat(F.col("table_name"), F.lit(f": {why}"))

    def named(rows: DataFrame, why: str) -> DataFrame:
        return mark(rows.select("file", "table_name").distinct().join(declared, ["file", "table_name"], "left_anti"), 24, FAIL, name(why))

    silent = []
    if c.columns is not None:
        said = c.columns.groupBy("file", "table_name", "column_name").agg(F.sum("n").alias("n"), F.sum("n_empty").alias("n_empty")).filter("n > 0 AND n = n_empty")
        silent = [mark(said, 24, PARTIAL, F.concat("table_name", F.lit("."), "column_name", F.lit(": null or a placeholder in all "), "n", F.lit(" rows")))]
    return either(
        *silent,
        mark(declared.join(there, ["file", "table_name"], "left_anti"), 24, FAIL, name("no such table")),
        named(c.geometry_columns, "layer is not in contents"), named(c.sets, "matrix set is not in contents"), named(c.matrix, "matrix is not in contents"),
        judge(keyed, 24, F.col("n_keys").isNull() | (F.col("n_keys") != 1) | (F.col("key_type") != "INTEGER"), name("no integer primary key")),
        judges(
            indexed, (None, 24, F.col("n").isNull(), name("no spatial index")), (None, 24, F.col("n") != F.coalesce("n_shapes", F.lit(0)), name("index entries are not its rows")),
            (None, 24, beyond, name("reaches beyond its declared box")),
        ),
        mark(c.shapes.filter("empty"), 24, FAIL, name("null geometry")),
        judges(
            shapes, (None, 24, F.col("problem").isNotNull(), F.concat(name(""), F.col("problem"))), (None, 24, declares("z", "has_z") | declares("m", "has_m"), name("Z or M not as declared")),
            (None, 24, ~free & (F.col("geometry_type") != wanted), F.concat(name("holds "), F.col("geometry_type"))),
        ),
    )


def pyramid_rules(c) -> DataFrame:
    """Requirements 25 to 30: levels, images and boxes of tile pyramids."""
    kinds = c.contents.select("file", catalog.category(F.col("data_type")).alias("k"))
    applies = kinds.filter("k IN ('tiles', 'gridded')").select("file").distinct()
    there = c.schema.select("file", "table_name").distinct()
    sized = c.matrix.select("file", "table_name", "zoom_level", "tile_width", "tile_height")
    images = c.heads.join(sized, ["file", "table_name", "zoom_level"], "left")
    wrong = F.col("width").isNull() | (F.col("width") != dims.TILE_SIZE) | (F.col("height") != dims.TILE_SIZE) | (F.col("width") != F.col("tile_width")) | (F.col("height") != F.col("tile_height"))
    tables = c.sets.select("file", "table_name").distinct()
    image = say("$format", "$width", "x", "$height", "in", "$table_name")
    boxes = zoom.bbox_in_extent(c.contents, c.sets)
    return either(
        judge(zoom.zoom_gaps(c.matrix).join(applies, "file", "left_semi"), 25, F.col("n_gaps") > 0, say("$table_name", "lacks levels", "$gaps")),
        mark(tables.join(there, ["file", "table_name"], "left_anti"), 26, FAIL, say("no table", "$table_name")),
        judges(images, (F.col("format") != "WEBP", 26, (F.col("format") == "UNKNOWN") | wrong, image), (F.col("format") == "WEBP", 26, F.lit(True), image)),
        judge(zoom.zoom_factor(c.matrix).filter("status <> 'SKIPPED'"), 27, F.col("status") == "FAIL", say("steps of", "$table_name")),
        judge(zoom.zoom_monotone(c.matrix), 28, F.col("status") == "FAIL", say("order of", "$table_name")),
        judge(zoom.tile_size(c.matrix), 29, F.col("uniform") == "FAIL", say("sizes of", "$table_name")),
        judge(boxes, 30, ~F.col("problem").isin("ok", "unknown system"), say("box of", "$table_name", ":", "$problem")),
    )


def gridded_rules(c) -> DataFrame:
    """Requirements 34 to 36: gridded coverages."""
    heights = catalog.gridded_elevation(c.coverage)
    grids = c.coverage.select("file", "table_name").distinct()
    steps = zoom.zoom_steps(c.matrix.join(grids, ["file", "table_name"])).filter("zoom_before IS NOT NULL")
    factor = lambda a, b: F.when(F.col(a) == 0, 0.0).otherwise(F.col(b) / F.col(a))
    off = lambda a, b: F.abs(factor(a, b) - 2) > 0.01
    return either(
        judges(
            heights, (F.col("field_status") != "SKIPPED", 34, F.col("field_status") == "FAIL", say("field of", "$table_name")),
            (F.col("centre_status") != "SKIPPED", 35, F.col("centre_status") == "FAIL", say("cells of", "$table_name")),
        ),
        mark(grids, 36, FINE),
        judge(steps, 36, off("pixel_x_size", "px_before") | off("pixel_y_size", "py_before"), say("$table_name", "level", "$zoom_level")),
    )


def groups(c, as_of: str, kept=lambda rows, name: rows):
    """Name and evidence of each group of rules in turn; ``kept`` may write the parsed documents and their references, which several groups read."""
    docs = kept(documents(c), "documents")
    pairs = F.broadcast(dims.scope_pairs(c.files.sparkSession).withColumn("fine", F.lit(True)))
    named = docs.select("file", F.col("id").alias("md_file_id"), "md_scope", "md_standard_uri", "barren")
    linked = kept(c.reference.join(named, ["file", "md_file_id"]).join(pairs, ["reference_scope", "md_scope"], "left"), "linked")
    yield "extensions", extension_rules(c, as_of)
    yield "rasters", raster_rules(c)
    yield "systems", system_rules(c)
    yield "files", file_rules(c, docs, linked)
    yield "metadata", metadata_rules(c, docs, linked)
    yield "data", data_rules(c)
    yield "pyramids", pyramid_rules(c)
    yield "grids", gridded_rules(c)


def evidence(c, as_of: str) -> DataFrame:
    """``file, req, level, note`` of all rules over a catalog, as one plan."""
    return either(*[rows for _, rows in groups(c, as_of)])


@contextmanager
def no_guessed_broadcasts(spark: SparkSession):
    """Joins inside broadcast only tables that say so: by the few bytes of its files a table of millions of keys looks small, and the driver would hold it."""
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        for n in names:
            spark.conf.set(n, "-1")
        yield
    finally:
        for n, value in before.items():
            spark.conf.unset(n) if value is None else spark.conf.set(n, value)


def written_evidence(c, as_of: str, folder: str, brief=lambda rows: rows) -> DataFrame:
    """``brief`` of the evidence of each group of rules, from tables below ``folder``.

    The groups are written one after the other, so that the driver never holds the plan of all
    rules, and documents are parsed once.
    """
    spark = c.files.sparkSession

    def kept(rows: DataFrame, name: str) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    with no_guessed_broadcasts(spark):
        parts = [kept(brief(rows), f"rules_{name}") for name, rows in groups(c, as_of, kept)]
    return either(*parts)
