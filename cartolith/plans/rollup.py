"""Roll-up from files: findings, confirmations, writing software and audits of a catalog by file and requirement.

Everything meets by equi-joins on (file, req) or file, after each side has been counted by that
key.  Batches are kept as one folder each, written again as a whole if a batch is repeated; the
newest finding of a file counts, so batches add up without validating earlier files again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..operators import requirements, scorers, scoring
from .validate import Catalog, examples, findings


#: Second looks that are one plan when they are written.
LOOKS = 8


def confirmations(c: Catalog, folder: str | None = None) -> DataFrame:
    """``file, req, confirmed, total_n`` of all second looks at a catalog; with ``folder``, from tables below it that are written a few looks at a time."""
    tiles = c.heads.select("file", "table_name", "zoom_level")
    users = c.sets.join(c.coverage.select("file", "table_name").distinct(), ["file", "table_name"], "left_semi")
    rows = [
        scorers.mandatory_extensions(c.contents, c.extensions), scorers.named_extensions(c.extensions), scorers.tile_systems(c.sets, c.srs), scorers.aligned_sets(c.matrix, c.sets),
        scorers.vector_systems(c.geometry_columns, z=False), scorers.vector_systems(c.geometry_columns, z=True), scorers.gridded_systems(c.sets, c.contents, c.srs, three=False),
        scorers.gridded_systems(c.sets, c.contents, c.srs, three=True), scorers.long_definitions(c.srs), scorers.compound_only_in_3d(c.geometry_columns, c.srs), scorers.compound_definitions(c.srs),
        scorers.compound_definitions(c.srs, users), scorers.epochs(c.srs), scorers.complete_metadata(c.metadata), scorers.whole_documents(c.metadata), scorers.whole_file_references(c.reference),
        scorers.partial_references(c.reference, c.metadata), scorers.series_documents(c.metadata), scorers.parents(c.reference, c.metadata), scorers.described_systems(c.srs),
        scorers.square_levels(c.matrix), scorers.sound_images(c.matrix, c.heads, c.contents), scorers.populated_levels(c.matrix, tiles), scorers.single_levels(c.matrix),
        scorers.boxes_within_sets(c.contents, c.sets), scorers.linked_layers(c.contents, c.reference, "tiles"), scorers.linked_layers(c.contents, c.reference, "features"),
        scorers.complete_coverages(c.coverage), scorers.known_scopes(c.metadata),
    ]
    one = [r.select("file", F.col("req").cast("int").alias("req"), F.col("confirmed").cast("long").alias("confirmed"), F.col("total").cast("long").alias("total_n")) for r in rows]
    if folder is not None:
        spark = c.files.sparkSession
        with requirements.no_guessed_broadcasts(spark):
            for i in range(0, len(one), LOOKS):
                reduce(DataFrame.unionByName, one[i : i + LOOKS]).write.mode("overwrite").parquet(f"{folder}/looks={i}")
        return spark.read.schema(one[0].schema).parquet(*[f"{folder}/looks={i}" for i in range(0, len(one), LOOKS)])
    return reduce(DataFrame.unionByName, one)


def audits(c: Catalog) -> DataFrame:
    """``file, audit, facts``: a row for each row of each audit, its facts as JSON."""
    named = {
        "extensions": scorers.extension_audit(c.extensions), "definitions": scorers.definition_audit(c.srs), "references": scorers.reference_audit(c.reference), "raster systems": scorers.raster_audit(c.sets, c.srs),
        "layers": scorers.layer_audit(c.geometry_columns), "documents": scorers.document_audit(c.metadata), "products": scorers.product_audit(c.metadata),
    }
    rows = [a.select("file", F.lit(n).alias("audit"), F.to_json(F.struct(*[x for x in a.columns if x != "file"])).alias("facts")) for n, a in named.items()]
    return reduce(DataFrame.unionByName, rows)


def second_look() -> Column:
    """Findings of requirements that are known to pass or fail for the wrong reasons, unless they pass in full."""
    return F.col("req").isin(dims.SECOND_LOOK) & F.col("status").isin("FAIL", "PASS*")


def file_facts(c: Catalog, as_of: str, rows: DataFrame | None = None, *, folder: str | None = None) -> DataFrame:
    """``file, req, status, detail, confirmed, total_n, software, confidence, disputed`` of every file and requirement.

    With ``folder``, evidence and second looks are written below it by several plans; without, all is one large plan.
    """
    software = scoring.software_vote(scorers.software_signals(c)).select("file", "software", "confidence")
    looks = confirmations(c, f"{folder}/looks" if folder else None)
    facts = findings(c, as_of, rows, folder=f"{folder}/evidence" if folder else None).join(looks.hint("merge"), ["file", "req"], "left").join(software.hint("merge"), "file", "left")
    number = lambda x: F.coalesce(F.col(x), F.lit(0).cast("long")).alias(x)
    return facts.select("file", "req", "status", "detail", number("confirmed"), number("total_n"), "software", "confidence", second_look().alias("disputed"))


def write_batch(facts: DataFrame, path: str, batch: int) -> None:
    """Keep the facts of one batch of files; a batch that is repeated replaces itself."""
    facts.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def all_batches(spark: SparkSession, path: str) -> DataFrame:
    """The newest facts of each file over all batches."""
    rows = spark.read.option("basePath", path).parquet(path)
    newest = rows.groupBy("file").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["file", "batch"]).drop("batch")


def write_reports(c: Catalog, as_of: str, folder: str, *, batch: int = 0) -> DataFrame:
    """Facts, one JSON object for each file (with notes, confirmations, software and audits) and the roll-up's CSV below ``folder``.

    The facts of this batch are written first and read again; the CSV is of all batches there.
    """
    from .report import write_findings, write_rollup

    spark = c.files.sparkSession
    rows = requirements.written_evidence(c, as_of, f"{folder}/evidence")
    write_batch(file_facts(c, as_of, rows, folder=f"{folder}/parts"), f"{folder}/facts", batch)
    facts = spark.read.parquet(f"{folder}/facts/batch={batch}")
    write_findings(facts, f"{folder}/files", notes=examples(rows), audits=audits(c))
    write_rollup(all_batches(spark, f"{folder}/facts"), f"{folder}/rollup")
    return facts
