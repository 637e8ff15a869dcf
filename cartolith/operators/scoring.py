"""Statuses to verdicts, roll-ups and matrices.

The fact table is one row for each (file, requirement) with a status; everything here is a
grouped aggregate over it, and files never meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims

STATUSES = ["PASS", "PASS*", "FAIL", "WARNING", "ERROR", "SKIPPED", "N/A"]
NAMES = {"PASS": "n_pass", "PASS*": "n_pass_star", "FAIL": "n_fail", "WARNING": "n_warning", "ERROR": "n_error", "SKIPPED": "n_skipped", "N/A": "n_na"}


def verdict(n_fail: Column, n_error: Column, n_pass_star: Column, n_skipped: Column) -> Column:
    """An error hides everything else; then failures, partial passes and skipped checks in turn."""
    return (
        F.when(n_error > 0, "VALIDATION ERROR")
        .when(n_fail > 0, "NON-CONFORMANT")
        .when(n_pass_star > 0, "LIKELY CONFORMANT")
        .when(n_skipped > 0, "AUTOMATED CHECKS CONFORMANT")
        .otherwise("CONFORMANT")
    )


def file_verdicts(facts: DataFrame) -> DataFrame:
    counts = facts.groupBy("file").agg(*[F.count_if(F.col("status") == s).alias(n) for s, n in NAMES.items()], F.count("*").alias("total"))
    return counts.withColumn("verdict", verdict(F.col("n_fail"), F.col("n_error"), F.col("n_pass_star"), F.col("n_skipped")))


def gate(facts: DataFrame) -> DataFrame:
    """Conformant: no mandatory requirement fails.  The exit code also counts errors and conditional failures."""
    kind = F.broadcast(dims.obligations(facts.sparkSession))
    return facts.join(kind, "req", "left").groupBy("file").agg((F.count_if((F.col("status") == "FAIL") & (F.col("obligation") == "M")) == 0).alias("conformant"), F.max(F.col("status").isin("FAIL", "ERROR").cast("int")).alias("exit_code"))


def file_counts(facts: DataFrame) -> DataFrame:
    """Per file: partial passes, those confirmed in full and in part, and those that nothing confirms."""
    star = F.col("status") == "PASS*"
    whole, some = (F.col("total_n") > 0) & (F.col("confirmed") == F.col("total_n")), (F.col("confirmed") > 0) & (F.col("confirmed") < F.col("total_n"))
    return facts.groupBy("file").agg(F.count_if(star).alias("pass_star"), F.count_if(star & whole).alias("star_confirmed"), F.count_if(star & some).alias("star_partial"), F.count_if(star & (F.col("confirmed") == 0)).alias("star_open"))


def requirement_rollup(facts: DataFrame) -> DataFrame:
    """Per requirement over all files: applicable, disputes (failures and errors), confirmed PASS*, rate in percent (half to even)."""
    applicable = ~F.col("status").isin("SKIPPED", "N/A")
    star, failed = F.col("status") == "PASS*", F.col("status").isin("FAIL", "ERROR")
    out = facts.groupBy("req").agg(
        F.count_if(applicable).alias("applicable"),
        F.count_if(failed).alias("disputes"),
        F.count_if(star).alias("pass_star"),
        F.count_if(star & (F.col("total_n") > 0) & (F.col("confirmed") == F.col("total_n"))).alias("star_confirmed"),
        F.array_join(F.array_sort(F.collect_set(F.when(failed, F.col("software")))), ",").alias("fail_software"),
    )
    rate = F.when(F.col("applicable") > 0, F.bround(100 * F.col("disputes") / F.col("applicable"), 0)).otherwise(0.0)
    return out.withColumn("rate", rate.cast("long"))


def confidence(rollup: DataFrame, base: str = "High") -> DataFrame:
    """Low if nothing applies or no PASS* is confirmed; at most Medium below half."""
    share = F.col("star_confirmed") / F.col("pass_star")
    level = F.when(F.col("applicable") == 0, "Low").when((F.col("pass_star") > 0) & (F.col("star_confirmed") == 0), "Low").when((F.col("pass_star") > 0) & (share < 0.5), "Medium").otherwise(base)
    return rollup.select("req", level.alias("confidence"))


def status_matrix(facts: DataFrame, reqs: list[int]) -> DataFrame:
    """One row for each file, one column for each requirement."""
    return facts.groupBy("file").pivot("req", reqs).agg(F.max("status")).select("file", *[F.col(f"`{r}`").alias(f"r{r}") for r in reqs])


def cascades(facts: DataFrame, missing_metadata: DataFrame) -> DataFrame:
    """Files without a metadata table whose absence explains two failures or more."""
    failed = facts.filter((F.col("status") == "FAIL") & F.col("req").isin(dims.METADATA_REQUIREMENTS))
    found = failed.join(missing_metadata.select("file").distinct(), "file", "left_semi").groupBy("file").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("req")).cast("array<string>"), ",").alias("reqs"))
    return found.filter("n >= 2")


def software_vote(signals: DataFrame) -> DataFrame:
    """Label and confidence from the signals for either writing software; mixed signals are of low confidence."""
    g, a = F.col("n_gdal"), F.col("n_arcgis")
    label = F.when((g == 0) & (a == 0), "UNKNOWN").when(g > a, "GDAL").otherwise("ARCGIS")
    mixed = ((g > 0) & (a > 0)) | ((g == 0) & (a == 0))
    level = F.when(mixed, "Low").when(F.greatest(g, a) >= 2, "High").otherwise("Medium")
    counts = signals.groupBy("file").agg(F.count_if("gdal").alias("n_gdal"), F.count_if("arcgis").alias("n_arcgis"))
    return counts.select("file", "n_gdal", "n_arcgis", label.alias("software"), level.alias("confidence"))
