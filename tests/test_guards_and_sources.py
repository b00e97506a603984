"""Guards that refuse, and files that go round."""

import pytest
from pyspark.sql import functions as F

from claimloom.operators import quality
from claimloom.plans import catalog
from claimloom.sources import readers, writers


def test_repeated_dimension_key_is_refused(spark):
    dim = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    with pytest.raises(Exception, match="dimension key repeats"):
        quality.unique_dimension(dim, "k").collect()


def test_null_gate_raises(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "x double")
    with pytest.raises(Exception, match="null in x"):
        quality.require_no_nulls(df, ["x"]).collect()


def test_empty_table_raises_in_null_analysis(spark):
    with pytest.raises(Exception, match="table is empty"):
        quality.null_analysis(spark.createDataFrame([], "x int"), ["x"]).collect()


def test_missing_batch_columns_raise(spark):
    with pytest.raises(ValueError, match="policy_id"):
        readers.normalise_headers(spark.createDataFrame([("C1",)], "` Claim_ID ` string"))


def test_rejected_rows_keep_their_text(spark, tmp_path):
    path = tmp_path / "cost.csv"
    path.write_text("procedure_code,average_cost,expected_cost,region\nPROC1,10,12,Delhi\nPROC2,abc,1,Pune\n")
    rows = readers.read_csv(spark, str(path), readers.COST_SCHEMA).orderBy("procedure_code").collect()
    assert [r[readers.REJECTED] for r in rows] == [None, "PROC2,abc,1,Pune"]


def test_ingest_counts_and_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("claim_id,x\nC1,1\nC2,2\n")
    assert writers.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out")) == 2
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "p.txt").write_text("one\n\ntwo")
    assert [tuple(r) for r in readers.read_documents(spark, str(tmp_path / "docs")).collect()] == [("p.txt", "one\n\ntwo")]


def test_every_query_has_a_unique_name():
    names = [e.name for e in catalog.entries()]
    assert len(names) == len(set(names)) > 150


def test_dedup_limit_runs_before_the_shuffle(spark, star):
    from claimloom.operators.clean import keep_first

    plan = keep_first(star.claims, "claim_id", ["row_key"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_point_lookup_reaches_the_scan(spark, star):
    plan = star.table("lineitem").where(F.col("l_orderkey") == 5).select("l_partkey")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_orderkey,5)" in plan and "l_comment" not in plan
