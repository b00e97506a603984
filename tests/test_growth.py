"""Plans and figures that must not grow faster than the tables."""

import numpy as np
from pyspark.sql import functions as F

from claimloom.functions import fixed_values as fixed
from claimloom.operators import extract, history, models, policy_text
from claimloom.sources.star import ClaimStar


def test_phrase_vector_searches_the_text_once(spark):
    df = spark.createDataFrame([(policy_text.phrases()[3] + " and " + policy_text.phrases()[7],), ("nothing known",)], "text string")
    vectors = df.select(policy_text.phrase_vector(F.col("text")).alias("v"))
    assert "array_contains(lambda" in vectors._jdf.queryExecution().optimizedPlan().toString()
    assert [[i for i, x in enumerate(r.v) if x] for r in vectors.collect()] == [[3, 7], [383]]


def test_dimensions_join_by_their_measured_size(spark, tmp_path):
    spark.range(20000).selectExpr("id AS s_suppkey", "uuid() AS s_name", "cast(id % 25 AS int) AS s_nationkey", "rand() AS s_acctbal").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(25).selectExpr("cast(id AS int) AS n_nationkey", "uuid() AS n_name").write.parquet(f"{tmp_path}/nation.parquet")
    spark.range(5).selectExpr("cast(id AS int) AS r_regionkey", "concat('region', id) AS r_name").write.parquet(f"{tmp_path}/region.parquet")
    spark.range(200000).selectExpr(
        "id AS l_orderkey", "id % 977 AS l_partkey", "id % 100 AS l_suppkey", "cast(rand() * 1000 AS double) AS l_extendedprice").write.parquet(f"{tmp_path}/lineitem.parquet")
    made = ClaimStar(spark, str(tmp_path))
    threshold = 10 << 20
    for dim, rows in ((made.providers, 20000), (made.cost, 58)):
        assert int(str(dim._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < threshold
        assert 0 < dim.count() <= rows


def test_tabled_contributions_equal_those_of_single_leaves():
    rng = np.random.default_rng(3)
    leaves = []
    for _ in range(40):
        chosen = rng.choice(len(fixed.FEATURES), rng.integers(1, 6), replace=False)
        low = rng.uniform(-1, 0, len(chosen))
        leaves.append((rng.normal(), {int(f): (a, a + 1, s) for f, a, s in zip(chosen, low, rng.uniform(0.1, 0.9, len(chosen)))}))
    x = rng.normal(size=(50, len(fixed.FEATURES)))
    want, got = np.zeros_like(x), np.zeros_like(x)
    for value, bounds in leaves:
        models.shapley_of_leaf(x, value, bounds, want)
    for table in models._leaf_tables(leaves):
        models.shapley_by_pattern(x, *models.pattern_table(*table), got)
    assert np.allclose(got, want, atol=1e-12)


def test_fields_search_the_text_once_for_each_pattern(spark):
    df = spark.createDataFrame([("Claim ID: C1234\nDate: 3/4/2001",)], "text string")
    found = extract.extract_fields(df)
    assert found.columns == ["text", "extracted"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    for pattern in fixed.FIELD_PATTERNS["date"][1]:
        assert plan.count(f"(?i){pattern}, 1)") <= 2  # four formats are tried
    row = found.first().extracted
    assert (row.claim_id.value, row.date.value, row.policy_id.value) == ("C1234", "2001-03-04", None)


def test_duplicate_flags_meet_on_short_keys(spark):
    columns = ["claim_id", "submitted_by", "row_key", *history.COMPARED]
    df = spark.createDataFrame([("C1", "a", "1", *"bcdefgh"), ("C2", "a", "2", *"bcdefgh"), ("C1", "a", "3", *"bcdefgx")], columns)
    flagged = history.with_duplicate_flags(df)
    assert "unhex(sha2(" in flagged._jdf.queryExecution().optimizedPlan().toString()
    assert {r.row_key: (r.copies, r.versions) for r in flagged.collect()} == {"1": (2, 2), "2": (2, 1), "3": (1, 2)}
