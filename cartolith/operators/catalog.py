"""Rules over the catalog: coordinate systems, extensions, references between tables.

Small constant tables are broadcast (their size is fixed); catalog tables meet by ordinary
equi-joins on ``file`` and a table name or id, so a batch of files is one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims


def category(data_type: Column) -> Column:
    """features, tiles or gridded; null for anything else."""
    t = F.lower(data_type)
    return F.when(t == "features", "features").when(t == "tiles", "tiles").when(t.contains("gridded") | t.contains("coverage"), "gridded")


def categories(contents: DataFrame) -> DataFrame:
    return contents.select("file", category(F.col("data_type")).alias("category")).filter("category IS NOT NULL").distinct()


def allowed(srs_id: Column, kind: str, policy: dict = dims.VALIDATE) -> Column:
    return srs_id.isin(policy[kind])


def vector_crs(geometry_columns: DataFrame, srs: DataFrame, *, z: bool) -> DataFrame:
    """Feature layers of one dimension whose system is not allowed for it; PASS* if all are."""
    layers = geometry_columns.filter("z <> 0" if z else "z = 0").join(srs.select("file", "srs_id", "srs_name"), ["file", "srs_id"], "left")
    ok = allowed(F.col("srs_id"), "vector_3d" if z else "vector_2d")
    out = layers.groupBy("file").agg(F.count("*").alias("n_layers"), F.count_if(~ok).alias("n_bad"), F.array_join(F.slice(F.array_sort(F.collect_set(F.when(~ok, F.col("srs_id")))), 1, 5).cast("array<string>"), ",").alias("bad_systems"))
    return out.withColumn("status", F.when(F.col("n_bad") > 0, "FAIL").otherwise("PASS*"))


def is_lambert(definition: Column) -> Column:
    """Lambert conformal conic in either spelling of well-known text."""
    return F.upper(F.translate(F.coalesce(definition, F.lit("")), "_", " ")).rlike("LAMBERT (CONFORMAL CONIC|CONIC CONFORMAL)")


def raster_crs(sets: DataFrame, contents: DataFrame, srs: DataFrame) -> DataFrame:
    """Tile tables with a system that raster data may not use (Lambert conformal conic may, by definition)."""
    tiles = contents.filter("data_type = 'tiles'").select("file", "table_name")
    rows = sets.join(tiles, ["file", "table_name"]).join(srs.select("file", "srs_id", "definition"), ["file", "srs_id"], "left")
    ok = allowed(F.col("srs_id"), "raster") | is_lambert(F.col("definition"))
    return rows.groupBy("file").agg(F.count("*").alias("n_tables"), F.count_if(~ok).alias("n_bad")).withColumn("status", F.when(F.col("n_bad") > 0, "FAIL").otherwise("PASS"))


def gridded_crs(sets: DataFrame, contents: DataFrame, srs: DataFrame) -> DataFrame:
    """Gridded tables by dimension: 3-D is code 4979 or a compound definition."""
    grids = contents.filter(category(F.col("data_type")) == "gridded").select("file", "table_name")
    rows = sets.join(grids, ["file", "table_name"]).join(srs.select("file", "srs_id", "definition"), ["file", "srs_id"], "left")
    compound = F.upper(F.coalesce("definition", F.lit(""))).rlike("COMPOUNDCRS|COMPD_CS")
    three = (F.col("srs_id") == 4979) | compound
    ok = F.when(three, allowed(F.col("srs_id"), "gridded_3d") | compound).otherwise(allowed(F.col("srs_id"), "gridded_2d"))
    return rows.withColumn("dimension", F.when(three, 3).otherwise(2)).groupBy("file", "dimension").agg(F.count("*").alias("n_tables"), F.count_if(~ok).alias("n_bad"))


def missing_extensions(contents: DataFrame, extensions: DataFrame) -> DataFrame:
    """Mandatory extensions of a file's data categories that it does not register."""
    rules = F.broadcast(dims.extension_rules(contents.sparkSession).filter("use = 'M'"))
    needed = categories(contents).join(rules, "category").select("file", "extension_name").distinct()
    return needed.join(extensions.select("file", "extension_name").distinct(), ["file", "extension_name"], "left_anti")


def registered_with_use(contents: DataFrame, extensions: DataFrame, use: str) -> DataFrame:
    """Registered extensions that some data category of the file has as ``use`` (a trailing _ is a prefix)."""
    rules = F.broadcast(dims.extension_rules(contents.sparkSession).filter(F.col("use") == use).withColumnRenamed("extension_name", "rule"))
    hit = (F.col("extension_name") == F.col("rule")) | (F.col("rule").endswith("_") & F.col("extension_name").startswith(F.col("rule")))
    return extensions.select("file", "extension_name").join(rules, hit).join(categories(contents), ["file", "category"]).select("file", "extension_name", "category").distinct()


def bad_scopes(extensions: DataFrame) -> DataFrame:
    """Extension rows whose scope is given but neither read-write nor write-only."""
    return extensions.filter(F.col("scope").isNotNull() & ~F.col("scope").isin("read-write", "write-only")).groupBy("file").agg(F.count("*").alias("n_bad"))


def timestamp_problem(stamp: Column, as_of: str) -> Column:
    """ISO 8601 as text: malformed fails, a time after ``as_of`` is a note; compared as text, never cast."""
    iso = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"
    return F.when(stamp.isNull() | ~stamp.rlike(iso), "malformed").when(stamp > as_of, "future").otherwise("ok")


def undeclared_tables(schema: DataFrame, contents: DataFrame) -> DataFrame:
    """User tables that the contents table does not name (catalog, index and SQLite tables aside)."""
    tables = schema.select("file", "table_name").distinct()
    own = F.lower("table_name").rlike("^(gpkg_|rtree_|sqlite_)")
    return tables.filter(~own).join(contents.select("file", "table_name"), ["file", "table_name"], "left_anti")


def orphan_references(reference: DataFrame, metadata: DataFrame) -> DataFrame:
    """References to metadata ids that do not exist."""
    ids = metadata.select("file", F.col("id").alias("md_file_id"))
    return reference.join(ids, ["file", "md_file_id"], "left_anti").groupBy("file").agg(F.count("*").alias("n_orphans"))


def unreferenced_metadata(metadata: DataFrame, reference: DataFrame) -> DataFrame:
    """Metadata documents that nothing refers to."""
    used = reference.select("file", F.col("md_file_id").alias("id")).distinct()
    return metadata.join(used, ["file", "id"], "left_anti").select("file", "id")


def parents_resolve(reference: DataFrame, metadata: DataFrame) -> DataFrame:
    """References with a parent: how many parents exist."""
    parents = metadata.select("file", F.col("id").alias("md_parent_id"), F.lit(True).alias("found")).distinct()
    rows = reference.filter("md_parent_id IS NOT NULL").join(parents, ["file", "md_parent_id"], "left")
    return rows.groupBy("file").agg(F.count("*").alias("total"), F.count_if("found").alias("confirmed"))


def scope_violations(reference: DataFrame, metadata: DataFrame) -> DataFrame:
    """References whose document has a scope that the reference scope does not allow."""
    rows = reference.join(metadata.select("file", F.col("id").alias("md_file_id"), "md_scope"), ["file", "md_file_id"])
    pairs = F.broadcast(dims.scope_pairs(reference.sparkSession))
    bad = rows.join(pairs, ["reference_scope", "md_scope"], "left_anti")
    return bad.groupBy("file", "reference_scope", "md_scope").agg(F.count("*").alias("n_bad"))


def unlinked_layers(contents: DataFrame, reference: DataFrame, kind: str) -> DataFrame:
    """Layers of a data type without a table-scope metadata reference."""
    linked = reference.filter("reference_scope = 'table' AND table_name IS NOT NULL").select("file", "table_name").distinct()
    return contents.filter(F.col("data_type") == kind).join(linked, ["file", "table_name"], "left_anti").select("file", "table_name")


def anchors(reference: DataFrame) -> DataFrame:
    """Whole-file references with no table, column and row, per file."""
    whole = (F.col("reference_scope") == "geopackage") & F.col("table_name").isNull() & F.col("column_name").isNull() & F.col("row_id_value").isNull()
    return reference.groupBy("file").agg(F.count_if(whole).alias("n_anchors")).withColumn("status", F.when(F.col("n_anchors") > 0, "PASS*").otherwise("FAIL"))


def missing_columns(schema: DataFrame, table: str, required: list[str]) -> DataFrame:
    """Required columns that a table of a file lacks, for files that have the table."""
    have = schema.filter(F.col("table_name") == table)
    need = have.select("file").distinct().select("file", F.explode(F.array(*map(F.lit, required))).alias("column_name"))
    return need.join(have.select("file", "column_name"), ["file", "column_name"], "left_anti")


def index_health(features: DataFrame, index: DataFrame) -> DataFrame:
    """Rows with a geometry against index entries per layer: surplus entries are zombies, a lack is missing."""
    a = features.groupBy("file", "table_name").agg(F.count("geom").alias("n_geometries"))
    b = index.groupBy("file", "table_name").agg(F.count("*").alias("n_entries"))
    diff = F.coalesce("n_entries", F.lit(0)) - F.coalesce("n_geometries", F.lit(0))
    out = a.join(b, ["file", "table_name"], "full").select("file", "table_name", F.coalesce("n_geometries", F.lit(0)).alias("n_geometries"), F.coalesce("n_entries", F.lit(0)).alias("n_entries"), diff.alias("diff"))
    return out.withColumn("health", F.when(F.col("diff") > 0, "zombie").when(F.col("diff") < 0, "missing").otherwise("ok"))


def layer_extent(index: DataFrame) -> DataFrame:
    return index.groupBy("file", "table_name").agg(F.min("minx").alias("min_x"), F.min("miny").alias("min_y"), F.max("maxx").alias("max_x"), F.max("maxy").alias("max_y"), F.count("*").alias("n"))


def extent_mismatch(contents: DataFrame, index: DataFrame, *, tolerance: float = 1e-6) -> DataFrame:
    """Layers whose entries reach beyond the declared box."""
    e = layer_extent(index).select("file", "table_name", *[F.col(c).alias(f"i_{c}") for c in ("min_x", "min_y", "max_x", "max_y")])
    beyond = (F.col("i_min_x") < F.col("min_x") - tolerance) | (F.col("i_min_y") < F.col("min_y") - tolerance) | (F.col("i_max_x") > F.col("max_x") + tolerance) | (F.col("i_max_y") > F.col("max_y") + tolerance)
    return contents.join(e, ["file", "table_name"]).filter(beyond).select("file", "table_name")


def placeholder_profile(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Per group and column: nulls, placeholder texts and whether nothing else is there; one pass for all columns."""
    sums = [x for c in columns for x in (F.count_if(F.col(c).isNull()).alias(f"{c}__null"), F.count_if(F.lower(F.trim(F.col(c).cast("string"))).isin(*dims.PLACEHOLDERS)).alias(f"{c}__placeholder"))]
    wide = df.groupBy(*by).agg(F.count("*").alias("n"), *sums)
    long = wide.select(*by, "n", F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__null").alias("n_null"), F.col(f"{c}__placeholder").alias("n_placeholder")) for c in columns])).alias("s"))
    return long.select(*by, "s.*", "n", (F.col("s.n_null") + F.col("s.n_placeholder") == F.col("n")).alias("empty"))


def gridded_elevation(coverage: DataFrame) -> DataFrame:
    """Coverages of elevation or height: field name and cell encoding as required; others are skipped."""
    height = F.coalesce(F.lower("quantity_definition").rlike("elevation|height"), F.lit(False))
    status = lambda ok: F.when(~height, "SKIPPED").when(F.coalesce(ok, F.lit(False)), "PASS").otherwise("FAIL")
    return coverage.select("file", "table_name", status(F.lower("field_name").isin("height", "elevation")).alias("field_status"), status(F.col("grid_cell_encoding") == "grid-value-is-center").alias("centre_status"))
