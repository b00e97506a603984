"""The scoring chain ships no claim to meet a dimension and compiles in methods the JVM compiles too."""

from claimloom.plans.catalog.adjudicate import scored_claims


def _compiled_sizes(spark, df):
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    parts = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
    return [parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size())]


def test_diagnosis_has_a_measured_size(star):
    assert "ExistingRDD" not in star.diagnosis._jdf.queryExecution().executedPlan().toString()


def test_scoring_methods_stay_small_enough_for_the_jvm(spark, star):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = scored_claims(star).select("claim_id", "row_key", "reasons", "recommended", "billing_verdict")
        assert max(_compiled_sizes(spark, plan)) < 8000
        assert "SortMergeJoin" not in plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_logs_look_up_the_action_before_the_json(star, monkeypatch):
    from claimloom.operators import history
    from claimloom.plans.catalog import sources

    seen = []
    found = history.audit_actions
    monkeypatch.setattr(history, "audit_actions", lambda new, *rest: seen.append(new.columns) or found(new, *rest))
    rows = sources._logs(star).collect()
    assert "full_response" not in seen[0] and sum(r["events"] for r in rows) == star.claims.count()
