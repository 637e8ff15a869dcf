"""Reports: findings as JSON by file, the roll-up as CSV, and a quick structural check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..operators import catalog, scoring
from .validate import Catalog


def write_findings(facts: DataFrame, path: str, *, notes: DataFrame | None = None, audits: DataFrame | None = None) -> None:
    """One JSON object for each file: verdict, counts and each requirement's status, with what else ``facts`` has of it.

    ``notes`` (``file, req, notes``) goes with the requirements; ``audits`` (``file, audit,
    facts``) and the writing software with the file.
    """
    verdicts = scoring.file_verdicts(facts)
    if notes is not None:
        facts = facts.join(notes.select("file", "req", "notes"), ["file", "req"], "left")
    own = [c for c in ("name", "status", "detail", "notes", "confirmed", "total_n") if c in facts.columns]
    of_file = [F.max(c).alias(c) for c in ("software", "confidence") if c in facts.columns]
    listed = facts.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("req", *own))).alias("requirements"), *of_file)
    out = verdicts.join(listed, "file")
    if audits is not None:
        out = out.join(audits.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("audit", "facts"))).alias("audits")), "file", "left")
    out.write.mode("overwrite").json(path)


def rollup_table(facts: DataFrame) -> DataFrame:
    """The roll-up's nine columns in report order.

    ``facts`` also has software, confirmed and total_n, and may have ``disputed``, true where
    an audit contradicts the status.
    """
    kind = F.broadcast(dims.obligations(facts.sparkSession))
    r = scoring.requirement_rollup(facts).join(kind, "req", "left")
    audits = facts.groupBy("req").agg(F.count_if("disputed") if "disputed" in facts.columns else F.lit(0).cast("long")).toDF("req", "audit_disputes")
    name = F.get(F.array(*map(F.lit, dims.NAMES)), F.col("req") - 1)
    return r.join(audits, "req", "left").select(
        F.col("req").alias("Req"), name.alias("Requirement"), F.col("obligation").alias("Compliance Type"), F.col("applicable").alias("Applicable GPKGs"), F.col("disputes").alias("Validator Disputes"),
        F.col("audit_disputes").alias("Auditor Disputes"), F.col("pass_star").alias("PASS* Count"), F.col("star_confirmed").alias("PASS* Manual Confirmed"), F.col("rate").alias("Dispute Rate %"),
    )


def write_rollup(facts: DataFrame, path: str) -> None:
    rollup_table(facts).orderBy("Req").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def quick_check(c: Catalog) -> DataFrame:
    """Structure flags of each file: tables, index, standard systems; compliant if it is indexed and has contents."""
    tables = c.schema.select("file", F.lower("table_name").alias("t")).distinct()
    flags = tables.groupBy("file").agg(
        F.max(F.col("t").startswith("rtree_")).alias("has_index"),
        F.max(F.col("t") == "gpkg_metadata").alias("has_metadata"),
        F.max(F.col("t") == "gpkg_extensions").alias("has_extensions"),
    )
    systems = c.srs.groupBy("file").agg(F.array_join(F.array_except(F.array(F.lit(-1), F.lit(0), F.lit(4326)), F.collect_set("srs_id")).cast("array<string>"), ",").alias("missing_systems"))
    layers = c.contents.groupBy("file").agg(F.count("*").alias("n_layers"), F.count_if(catalog.category(F.col("data_type")) == "features").alias("n_feature_layers"))
    out = c.files.join(flags, "file", "left").join(systems, "file", "left").join(layers, "file", "left")
    return out.withColumn("compliant", F.coalesce(F.col("has_index") & (F.col("n_layers") > 0), F.lit(False)))
