"""Validation of a set of files as one plan: rules to evidence, evidence to findings, findings to verdicts."""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, fields

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions import binary, geometry
from ..operators import catalog, requirements, scoring


@dataclass
class Catalog:
    """Catalog tables of many files; each has a ``file`` column.  A table that no file has is empty.

    ``heads`` has the format and size of each tile's image, ``shapes`` the facts of each
    geometry (``shape_facts``), ``index`` the entries and extent of each layer's index,
    ``columns``, which may be left out, the rows of each attribute and those that say nothing.
    """

    files: DataFrame
    schema: DataFrame
    pragmas: DataFrame
    contents: DataFrame
    srs: DataFrame
    geometry_columns: DataFrame
    sets: DataFrame
    matrix: DataFrame
    extensions: DataFrame
    metadata: DataFrame
    reference: DataFrame
    heads: DataFrame
    shapes: DataFrame
    index: DataFrame
    coverage: DataFrame
    columns: DataFrame | None = None

    def written(self, folder: str) -> "Catalog":
        """The same catalog from Parquet tables below ``folder``, so that rules read each source once."""
        tables: dict[str, DataFrame] = {f.name: df for f in fields(self) if (df := getattr(self, f.name)) is not None}

        def write(name: str) -> None:
            tables[name].write.mode("overwrite").parquet(f"{folder}/{name}")

        with ThreadPoolExecutor(4) as pool:  # the tables have nothing to do with each other, and most are small
            list(pool.map(inheritable_thread_target(self.files.sparkSession)(write), tables))
        return Catalog(**{name: df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}") for name, df in tables.items()})


#: Fields of a catalog and the source of their rows in a scan.
SOURCES = {
    "schema": "schema", "pragmas": "pragma", "contents": "gpkg_contents", "srs": "gpkg_spatial_ref_sys", "geometry_columns": "gpkg_geometry_columns", "sets": "gpkg_tile_matrix_set",
    "matrix": "gpkg_tile_matrix", "extensions": "gpkg_extensions", "metadata": "gpkg_metadata", "reference": "gpkg_metadata_reference", "heads": "heads", "shapes": "features", "index": "index",
    "coverage": "gpkg_2d_gridded_coverage_ancillary", "columns": "columns",
}


@dataclass
class Scan(Catalog):
    """A catalog over files: ``scan`` has the rows of all its tables, tagged by ``source``, from one opening of each file."""

    scan: DataFrame | None = None

    def written(self, folder: str) -> "Catalog":
        """One pass over the files writes all tables, a folder for each; shapes are reduced to their facts on the way."""
        from ..sources.gpkg import with_errors

        spark = self.files.sparkSession
        rows = self.scan.withColumn("_h", binary.gp_header(F.col("geom"), compat=False)).select("*", *_shape_columns()).drop("geom", "_h")
        rows.write.mode("overwrite").partitionBy("source").parquet(f"{folder}/scan")
        whole = spark.read.schema(rows.schema).parquet(f"{folder}/scan")
        get = lambda source: whole.filter(F.col("source") == source)
        out = {}
        for name, source in SOURCES.items():
            wanted: DataFrame = getattr(self, name)
            renamed = F.col("tile_matrix_set_name").alias("table_name")
            out[name] = get(source).select(*[renamed if name == "coverage" and f.name == "table_name" else F.col(f"`{f.name}`").cast(f.dataType) for f in wanted.schema.fields])
        return Catalog(files=with_errors(get("files"), get("errors")), **out)


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder for tables between plans, in the cluster's shared ``spark.checkpoint.dir``; a temporary one only in local mode without any."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base or tempfile.mkdtemp(prefix='cartolith-')}/{label}-{uuid.uuid4().hex}"


def shape_facts(features: DataFrame, *, compat: bool = False) -> DataFrame:
    """``file, table_name, empty, has_z, has_m, geometry_type, problem`` from geometry blobs.

    With ``compat``, Z and M are read as ``binary.gp_header`` says there.
    """
    return features.select("file", "table_name", "geom", binary.gp_header(F.col("geom"), compat=compat).alias("_h")).select("file", "table_name", *_shape_columns())


def _shape_columns() -> list[Column]:
    """Facts from a blob ``geom`` and its header ``_h``."""
    body = F.expr("substring(geom, _h.wkb_offset + 1)")
    problem = F.when(F.col("geom").isNotNull() & F.col("_h").isNull(), "no header").otherwise(geometry.validity(body))
    flag = lambda c: F.coalesce(F.col(f"_h.{c}"), F.lit(False)).alias(c)
    return [F.col("geom").isNull().alias("empty"), flag("has_z"), flag("has_m"), geometry.geometry_type(F.col("_h.wkb_type")).alias("geometry_type"), problem.alias("problem")]


def file_profile(contents: DataFrame, matrix: DataFrame) -> DataFrame:
    """A row of facts for each file; ``categories`` and ``systems`` are null where no table has one."""
    levels = matrix.groupBy("file").agg(F.min("zoom_level").alias("low"), F.max("zoom_level").alias("high"), F.count("*").alias("n_levels"))
    joined = lambda c: F.nullif(F.array_join(F.array_sort(F.collect_set(c)).cast("array<string>"), ","), F.lit(""))
    facts = contents.groupBy("file").agg(F.count("*").alias("n_tables"), joined(catalog.category(F.col("data_type"))).alias("categories"), joined("srs_id").alias("systems"))
    return facts.join(levels, "file", "left")


def whole_profile(c: Catalog) -> DataFrame:
    """``file_profile`` and, beside it, tiles by count and size, the factor of the lowest two levels, extensions, metadata standards and gridded fields."""
    joined = lambda x: F.array_join(F.array_sort(F.collect_set(x)), ",")
    tiles = c.heads.groupBy("file").agg(F.count("*").alias("n_tiles"), joined(F.concat_ws("x", "width", "height")).alias("tile_sizes"), joined("format").alias("tile_formats"))
    low = c.matrix.withColumn("k", F.row_number().over(Window.partitionBy("file", "table_name").orderBy("zoom_level"))).filter("k <= 2")
    steps = low.groupBy("file", "table_name").agg(F.max(F.when(F.col("k") == 1, F.col("pixel_x_size"))).alias("a"), F.max(F.when(F.col("k") == 2, F.col("pixel_x_size"))).alias("b"))
    factor = steps.filter("b <> 0").groupBy("file").agg(F.min(F.round(F.col("a") / F.col("b"), 4)).alias("factor"))
    extensions = c.extensions.groupBy("file").agg(joined("extension_name").alias("extensions"))
    standards = c.metadata.groupBy("file").agg(joined("md_standard_uri").alias("standards"))
    grids = c.coverage.groupBy("file").agg(joined("field_name").alias("grid_fields"))
    out = c.files.select("file").join(file_profile(c.contents, c.matrix), "file", "left")
    for part in (tiles, factor, extensions, standards, grids):
        out = out.join(part, "file", "left")
    return out


def worst_of(rows: DataFrame) -> DataFrame:
    """``file, req, level, n, bad, part`` of evidence: the highest level, the number of violations and the first note of each kind."""
    violation, partial = F.col("level") == 2, F.col("level") == 1
    return rows.groupBy("file", "req").agg(F.max("level").alias("level"), F.count_if(violation).alias("n"), F.min(F.when(violation, F.col("note"))).alias("bad"), F.min(F.when(partial, F.col("note"))).alias("part"))


def findings(c: Catalog, as_of: str, rows: DataFrame | None = None, *, folder: str | None = None) -> DataFrame:
    """``file, req, status, detail`` for every file and requirement 1 to 37; SKIPPED where nothing applies.

    A damaged file, of which some tables cannot be read, has ERROR throughout.  ``detail``
    counts the violations and names the first.  ``rows``, evidence that was written before,
    saves computing it again.  With ``folder``, each group of rules is a plan of its own, whose
    evidence is summed up below it; without, all rules are one large plan.
    """
    if rows is None and folder is not None:
        parts = requirements.written_evidence(c, as_of, folder, worst_of)
        worst = parts.groupBy("file", "req").agg(F.max("level").alias("level"), F.sum("n").alias("n"), F.min("bad").alias("bad"), F.min("part").alias("part"))
    else:
        worst = worst_of(requirements.evidence(c, as_of) if rows is None else rows)
    grid = c.files.select("file", "damage", F.explode(F.sequence(F.lit(1), F.lit(37))).alias("req"))
    best = F.when(F.col("req").isin(dims.BEST_IS_PARTIAL), "PASS*").otherwise("PASS")
    status = F.when(F.col("damage").isNotNull() & ~F.col("req").isin(1, 2, 6), "ERROR").when(F.col("level") == 2, "FAIL").when(F.col("level") == 1, "PASS*").when(F.col("level") == 0, best).otherwise("SKIPPED")
    detail = F.when(F.col("damage").isNotNull(), F.col("damage")).when(F.col("level") == 2, F.concat(F.col("n"), F.lit(" found: "), F.col("bad"))).when(F.col("level") == 1, F.col("part"))
    return grid.join(worst.hint("merge"), ["file", "req"], "left").select("file", "req", status.alias("status"), F.substring(F.coalesce(detail, F.lit("")), 1, 1000).alias("detail"))


def examples(rows: DataFrame, k: int = 5) -> DataFrame:
    """``file, req, level, notes``: the first ``k`` notes of each file and requirement in alphabetical order, violations first."""
    w = Window.partitionBy("file", "req").orderBy(F.desc("level"), "note")
    few = rows.filter("level > 0").distinct().withColumn("k", F.row_number().over(w)).filter(F.col("k") <= k)
    return few.groupBy("file", "req").agg(F.max("level").alias("level"), F.array_sort(F.collect_list(F.struct("k", "note"))).alias("n")).select("file", "req", "level", F.transform("n", lambda x: x["note"]).alias("notes"))


def validate(c: Catalog, as_of: str, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings and verdicts.  With ``folder``, catalog tables and findings are written there and read once."""
    if folder is None:
        facts = findings(c, as_of)
        return facts, scoring.file_verdicts(facts)
    facts = findings(c.written(f"{folder}/catalog"), as_of, folder=f"{folder}/evidence")
    facts.write.mode("overwrite").parquet(f"{folder}/findings")
    facts = facts.sparkSession.read.parquet(f"{folder}/findings")
    return facts, scoring.file_verdicts(facts)
