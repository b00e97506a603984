"""Risk and label queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.operators import risk as k
from claimloom.plans.catalog import Entry
from claimloom.plans.catalog.clean import _plain
from claimloom.plans.silver import AS_OF, COPY_ORDER, Medallion
from claimloom.plans.sql_text import AS_OF as AS_OF_TEXT
from claimloom.plans.sql_text import pct, query

RULES = f"""WITH r AS (SELECT *, coalesce(diagnosis_code, 'UNKNOWN') AS d, coalesce(procedure_code, 'UNKNOWN') AS p,
  coalesce(provider_id, 'UNKNOWN') AS v, CASE WHEN billed_amount > 0 THEN billed_amount ELSE 0 END AS b
  FROM claims QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY row_key) = 1),
t1 AS (SELECT *, CASE WHEN d = 'UNKNOWN' THEN 3 ELSE 0 END + CASE WHEN p = 'UNKNOWN' THEN 3 ELSE 0 END
  + CASE WHEN b = 0 THEN 2 ELSE 0 END AS points, CASE WHEN d = 'UNKNOWN' THEN 'R01_MISSING_DIAGNOSIS'
  WHEN p = 'UNKNOWN' THEN 'R02_MISSING_PROCEDURE' WHEN b = 0 THEN 'R03_MISSING_BILLED_AMOUNT' ELSE 'NONE' END AS reason FROM r),
t2 AS (SELECT t1.*, c.average_cost, c.expected_cost, t1.points + CASE WHEN average_cost > 0 AND b > average_cost * 2 THEN 2 ELSE 0 END AS points2,
  CASE WHEN reason = 'NONE' AND average_cost > 0 AND b > average_cost * 2 THEN 'R04_EXTREME_OVERBILLING' ELSE reason END AS reason2
  FROM t1 LEFT JOIN cost c ON t1.p = c.procedure_code)
"""
PROB = "CAST(list_extract([0.05, 0.20, 0.40, 0.65, 0.78, 0.88, 0.95], CAST(least({p}, 6) + 1 AS INTEGER)) AS DOUBLE)"
TIER = "CASE WHEN {q} >= 0.7 THEN 'HIGH' WHEN {q} >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END"


def _rule_points(s):
    return k.with_point_outcome(
        k.rule_claims_base(s.claims, COPY_ORDER).withColumn("denial_points", k.denial_points()).withColumn("denial_reason_code", k.reason_code())
    )


ENTRIES = [
    Entry(
        "R1_pre_risk_score",
        lambda s: Medallion(s).claims.select("claim_id", "pre_risk_score"),
        query("SELECT claim_id, pre_risk_score FROM silver_claims", "silver_claims"),
    ),
    Entry(
        "R2_billing_ratio",
        lambda s: Medallion(s).scored.select("claim_id", "billing_ratio"),
        query("SELECT claim_id, billing_ratio FROM scored", "scored"),
    ),
    Entry(
        "R3_final_score_and_tier",
        lambda s: Medallion(s).scored.select("claim_id", "billing_points", "final_risk_score", "risk_tier"),
        query("SELECT claim_id, billing_points, final_risk_score, risk_tier FROM scored", "scored"),
    ),
    Entry(
        "R4_noisy_label",
        lambda s: Medallion(s).scored.select("claim_id", "denial_flag"),
        query("SELECT claim_id, denial_flag FROM scored", "scored"),
    ),
    Entry(
        "R5_labeled_projection",
        lambda s: _plain(Medallion(s).labeled),
        query(
            "SELECT claim_id, patient_id, provider_id, diagnosis_code, procedure_code, CAST(billed_amount AS DOUBLE) AS billed_amount,"
            " is_billed_missing, CAST(claim_date AS VARCHAR) AS claim_date, denial_flag FROM scored",
            "scored",
        ),
    ),
    Entry(
        "R6_denial_points",
        lambda s: _rule_points(s).select("claim_id", "denial_points", "denial_reason_code"),
        query(RULES + "SELECT claim_id, points AS denial_points, reason AS denial_reason_code FROM t1", "claims", "cost"),
    ),
    Entry(
        "R7_points_outcome",
        lambda s: _rule_points(s).select("claim_id", "denial_flag", "denial_probability", "risk_tier"),
        query(
            RULES + f"SELECT claim_id, CASE WHEN points >= 3 THEN 1 ELSE 0 END AS denial_flag, {PROB.format(p='points')} AS denial_probability, "
            + TIER.format(q=PROB.format(p="points")) + " AS risk_tier FROM t1",
            "claims", "cost",
        ),
    ),
    Entry(
        "R8_overbilling_rule",
        lambda s: Medallion(s).wide_rules.select("claim_id", "denial_flag", "denial_probability", "risk_tier", "denial_reason_code"),
        query(
            RULES + f"SELECT claim_id, CASE WHEN points2 >= 3 THEN 1 ELSE 0 END AS denial_flag, {PROB.format(p='points2')} AS denial_probability, "
            + TIER.format(q=PROB.format(p="points2")) + " AS risk_tier, reason2 AS denial_reason_code FROM t2",
            "claims", "cost",
        ),
    ),
    Entry(
        "R8_wide_claims",
        lambda s: _plain(Medallion(s).wide_rules.withColumns({"_silver_timestamp": F.col("_silver_timestamp").isNotNull(), "claim_age_days": F.col("claim_age_days").cast("double")})),
        query(
            RULES + "SELECT t2.claim_id, t2.patient_id, t2.v AS provider_id, CAST(t2.claim_date AS VARCHAR) AS claim_date, "
            f"CAST(date_diff('day', t2.claim_date, DATE '{AS_OF_TEXT}') AS DOUBLE) AS claim_age_days, true AS _silver_timestamp, 'silver' AS _silver_layer, t2.d AS diagnosis_code,"
            " t2.p AS procedure_code, CAST(b AS DOUBLE) AS billed_amount, CAST(coalesce(t2.average_cost, 0) AS DOUBLE) AS average_cost,"
            " CAST(coalesce(t2.expected_cost, 0) AS DOUBLE) AS expected_cost, coalesce(specialty, 'UNKNOWN') AS specialty,"
            " coalesce(location, 'UNKNOWN') AS location, coalesce(category, 'UNKNOWN') AS diagnosis_category,"
            " coalesce(severity, 'UNKNOWN') AS diagnosis_severity, CASE WHEN d = 'UNKNOWN' THEN 1 ELSE 0 END AS is_diagnosis_missing,"
            " CASE WHEN p = 'UNKNOWN' THEN 1 ELSE 0 END AS is_procedure_missing, CASE WHEN points2 >= 3 THEN 1 ELSE 0 END AS denial_flag, "
            + PROB.format(p="points2") + " AS denial_probability, " + TIER.format(q=PROB.format(p="points2"))
            + " AS risk_tier, reason2 AS denial_reason_code FROM t2 LEFT JOIN providers pr ON t2.v = pr.provider_id"
            " LEFT JOIN diagnosis dg ON t2.d = dg.diagnosis_code",
            "claims", "cost", "providers", "diagnosis",
        ),
    ),
    Entry(
        "R9_claim_age",
        lambda s: s.claims.select("claim_id", "row_key", k.claim_age(F.col("claim_date"), AS_OF).cast("double").alias("claim_age_days")),
        query(f"SELECT claim_id, row_key, CAST(date_diff('day', claim_date, DATE '{AS_OF_TEXT}') AS DOUBLE) AS claim_age_days FROM claims", "claims"),
    ),
    Entry(
        "R10_label_guardrails",
        lambda s: k.label_guardrails(_rule_points(s), "denial_flag", 1),
        query(
            RULES + "SELECT *, CASE WHEN denial_rate < 20 THEN 'BELOW_TARGET' WHEN denial_rate > 45 THEN 'ABOVE_TARGET' ELSE 'OK' END AS status FROM ("
            "SELECT count(*) AS total, count(*) FILTER (points >= 3) AS denied, " + pct("count(*) FILTER (points >= 3)", "count(*)", 2) + " AS denial_rate FROM t1)",
            "claims", "cost",
        ),
    ),
]
