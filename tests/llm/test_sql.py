"""The SQL of the operators that have some, on the driver's smallest tables and on made ones."""

import os

import duckdb
import pytest
from llm.conftest import corpus

from cartolith.llm import queries

SF = "/root/testdata/sf0.001"


def both(spark, name, folder):
    """Rows of a query and of its SQL, columns in order of name."""
    con = duckdb.connect()
    for f in sorted(os.listdir(folder)):
        files = f"{folder}/{f}" if os.path.isfile(f"{folder}/{f}") else f"{folder}/{f}/*.parquet"
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{files}'")
    df = queries.QUERIES[name](spark, folder)
    cursor = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    got = sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr)
    return got, sorted((tuple(r[names.index(c)] for c in order) for r in cursor.fetchall()), key=repr), order


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    got, want, _ = both(spark, name, SF)
    assert got == want and got


@pytest.mark.parametrize("name", ["op8_line_windows", "op9_bayes_ngram_join", "op10_wu_manber"])
def test_query_equals_sql_on_edge_cases(spark, tmp_path, name):
    rows = {r[0]: r for r in corpus() if r[0] is not None}  # the SQL takes ids as unique
    spark.createDataFrame([*rows.values()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, rows[50][1][300:900]), (2, None), (3, "two words"), (4, "aa"), (10, rows[3][1][:400]), (None, rows[4][1][:300])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got, want, _ = both(spark, name, str(tmp_path))
    assert got == want and len(got) == len(rows)


def test_cutoffs_equal_sql_where_they_reject(spark, labelled):
    """Labels enough for cutoffs in every stratum, with copies, contradictions and nulls among them."""
    got, want, order = both(spark, "op4_risk_controlled_rules", labelled)
    assert got == want
    kept, failed = order.index("kept"), order.index("base_failed")
    assert sum(not r[kept] and not r[failed] for r in got) > 500
