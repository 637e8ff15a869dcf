"""Catalog maintenance as transforms, sampling and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import dims


def drop_orphan_systems(srs: DataFrame, *users: DataFrame) -> DataFrame:
    """Without positive, not approved codes that no table uses."""
    used = users[0].select("file", "srs_id")
    for u in users[1:]:
        used = used.unionByName(u.select("file", "srs_id"))
    keep = (F.col("srs_id") <= 0) | F.col("srs_id").isin(dims.APPROVED)
    return srs.filter(keep).unionByName(srs.filter(~keep).join(used.distinct(), ["file", "srs_id"], "left_semi"))


def upsert_extensions(extensions: DataFrame, new: DataFrame) -> DataFrame:
    """Add rows that are not there yet; (file, table, column, extension) is compared null-safely."""
    keys = ["file", "table_name", "column_name", "extension_name"]
    a, b = new.alias("a"), extensions.select(*keys).distinct().alias("b")
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return extensions.unionByName(a.join(b, cond, "left_anti").select(*extensions.columns))


def fill_definitions(srs: DataFrame, known: DataFrame) -> DataFrame:
    """Fill empty or undefined WKT2 texts from known ones, and empty descriptions by the name."""
    empty = lambda c: F.nullif(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit("undefined"))
    out = srs.join(known.select("srs_id", F.col("wkt2").alias("_wkt")), "srs_id", "left")
    return out.withColumns({"definition_12_063": F.coalesce(empty("definition_12_063"), "_wkt", F.lit("undefined")), "description": F.coalesce(F.nullif(F.trim("description"), F.lit("")), "srs_name")}).drop("_wkt")


def metadata_ids(documents: DataFrame) -> DataFrame:
    """Ids in insertion order per file; layers refer to the file's package document as parent."""
    w = Window.partitionBy("file").orderBy("position")
    rows = documents.withColumn("id", F.row_number().over(w).cast("long"))
    parent = rows.filter("kind = 'package'").groupBy("file").agg(F.min("id").alias("package_id"))
    return rows.join(parent, "file", "left").withColumn("md_parent_id", F.when(F.col("kind") == "layer", F.col("package_id"))).drop("package_id")


def stratified_sample(rows: DataFrame, n: int, *, by: list[str], key: str = "fid") -> DataFrame:
    """For each group the first row at or after each of n evenly spaced thresholds of its key range, each once.

    step = max(1, floor((max - min) / n)); thresholds are min + i * step.  The first row at
    or after a threshold is the smallest key of its bucket or of the next bucket that has
    rows, so keys meet thresholds by bucket, not by a range join.
    """
    span = rows.groupBy(*by).agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    span = span.withColumn("step", F.greatest(F.lit(1).cast("long"), F.floor((F.col("hi") - F.col("lo")) / n)))
    firsts = rows.join(span, by).withColumn("bucket", F.floor((F.col(key) - F.col("lo")) / F.col("step"))).groupBy(*by, "bucket").agg(F.min(key).alias(key), F.first("step").alias("step"), F.first("lo").alias("lo"))
    w = Window.partitionBy(*by).orderBy("bucket")
    before = F.coalesce(F.lag("bucket").over(w), F.lit(-1))
    return firsts.withColumn("before", before).filter(F.col("before") + 1 < n).select(*by, key)


def first_per_zoom(tiles: DataFrame, k: int) -> DataFrame:
    """The first k tiles of each level by column and row."""
    w = Window.partitionBy("file", "table_name", "zoom_level").orderBy("tile_column", "tile_row")
    return tiles.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k).drop("rn")


def hash_sample(rows: DataFrame, n: int, *, by: list[str], key: str) -> DataFrame:
    """n rows of each group by the order of a digest of the key: random-looking, and the same on every run."""
    w = Window.partitionBy(*by).orderBy(F.md5(F.col(key).cast("string")), key)
    return rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).drop("rn")


def report_names(files: DataFrame) -> DataFrame:
    """A report name for each file: stem and tag, with _2, _3, ... where they collide."""
    w = Window.partitionBy("stem", "tag").orderBy("file")
    k = F.row_number().over(w)
    return files.withColumn("report", F.concat("stem", F.lit("_"), "tag", F.when(k > 1, F.concat(F.lit("_"), k)).otherwise("")))


def widened_type(types: DataFrame, *, by: list[str]) -> DataFrame:
    """The geometry type of a layer: the only one that occurs, else GEOMETRY."""
    out = types.groupBy(*by).agg(F.collect_set("geometry_type").alias("t"), F.count("geometry_type").alias("n"))
    return out.select(*by, F.when(F.size("t") == 1, F.col("t")[0]).otherwise("GEOMETRY").alias("geometry_type"), "n")
