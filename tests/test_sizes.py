"""What the driver holds and how work is dealt, at any size of the tables."""

from pyspark.sql import functions as F

from cartolith import queries, validation_views
from cartolith.operators import requirements
from cartolith.plans.rollup import file_facts

SF = "/root/testdata/sf0.001"


def joins(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_rules_are_not_one_plan(spark, tmp_path):
    """rules and second looks are written by groups, so no plan holds them all."""
    assert joins(queries.queries()["findings"](spark, SF)) <= 2
    c = validation_views.catalog_of(spark, SF).written(str(tmp_path / "catalog"))
    assert joins(file_facts(c, validation_views.AS_OF, folder=str(tmp_path / "parts"))) <= 8
    assert max(joins(rows) for _, rows in requirements.groups(c, validation_views.AS_OF)) <= 25


def test_written_evidence_is_the_evidence(spark, tmp_path):
    c = validation_views.catalog_of(spark, SF).written(str(tmp_path / "catalog"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    one, parts = requirements.evidence(c, validation_views.AS_OF), requirements.written_evidence(c, validation_views.AS_OF, str(tmp_path / "parts"))
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before
    assert one.exceptAll(parts).count() == 0 and parts.exceptAll(one).count() == 0


def test_documents_are_dealt_over_tasks(spark):
    """a customer table of one small file must not put all its documents into one task."""
    sizes = [r["count"] for r in validation_views.catalog_of(spark, SF).metadata.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 4 and max(sizes) < sum(sizes) / 2
