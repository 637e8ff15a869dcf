"""A training-data pipeline over ``documents``: five stages, each written and read again.

Quality rules drop texts they reject; line dedup rewrites texts, and drops those of which no
word is left, as all their lines stand in other texts; of each class of similar documents
one stays; contaminated documents go; the rest is encoded.

Line dedup comes first, so near copies reach the join without the lines they share: what is
left of them is their own and mostly no longer similar, which is why few of them go there.

Every stage takes null, empty and repeated rows and an empty table: null and blank texts fail
the quality rules, so later stages see none unless they are called by themselves; then line
dedup and decontamination keep them, the join keeps each, and encoding gives no ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.llm import bpe, decontaminate, line_dedup, ngram_join, quality_rules
from cartolith.llm._common import delete_path, materialize, scratch_of_run, scratch_path, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(spark, docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; ``n_chars`` follows the text.  A text that loses its last word goes."""
    out = line_dedup.dedup_lines(docs)
    out = out.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one_of_each(spark, docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids (packed, little-endian unsigned 32-bit) of each document, with the digests of op 3."""
    import public_tokenizers

    done = bpe.encode_decode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return done.select(
        "doc_id", "lang", "source", "ids",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", contamination),
    ("bpe_encoding", tokens),
]

#: Merging byte pairs by rank is no SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order.  A stage's own intermediate tables and its input are deleted once its result is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        with scratch_of_run(spark):
            docs = materialize(spark, stage(spark, docs, sf_dir), name, path)
        if before:
            delete_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
