"""Feature engineering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.functions import fixed_values as fixed
from claimloom.operators import features as f
from claimloom.plans.catalog import Entry
from claimloom.plans.catalog.clean import _plain
from claimloom.plans.silver import AS_OF, Medallion
from claimloom.plans.sql_text import AS_OF as AS_OF_TEXT
from claimloom.plans.sql_text import half_up, query

MEAN_COST = "(SELECT CAST(sum(expected_cost) AS DOUBLE) / count(expected_cost) FROM cost)"
SERVING = f"""SELECT c.claim_id, c.row_key,
  {half_up('billed / greatest(expected, 1)', 4)} AS billing_ratio, {half_up('billed - expected', 4)} AS cost_diff,
  CASE WHEN {half_up('billed / greatest(expected, 1)', 4)} > CAST(1.5 AS DOUBLE) THEN 1 ELSE 0 END AS high_cost_flag,
  50 AS provider_claim_count, specialty_code AS provider_specialty_enc, severity AS severity_score, 20 AS diag_claim_count,
  category_code AS diag_category_enc, CASE WHEN billed_amount IS NULL THEN 1 ELSE 0 END AS is_billed_missing,
  CASE WHEN procedure_code IS NULL THEN 1 ELSE 0 END AS is_proc_missing, CASE WHEN diagnosis_code IS NULL THEN 1 ELSE 0 END AS is_diag_missing,
  coalesce(date_diff('day', claim_date, DATE '{AS_OF_TEXT}'), 0) AS claim_age_days
FROM (SELECT x.*, coalesce(CAST(billed_amount AS DOUBLE), CAST(0 AS DOUBLE)) AS billed,
        coalesce(CAST(co.expected_cost AS DOUBLE), {MEAN_COST}) AS expected,
        CASE WHEN specialty = 'Cardiology' THEN 0 WHEN specialty = 'General' THEN 1 WHEN specialty = 'Neurology' THEN 2
             WHEN specialty = 'Orthopedic' THEN 3 ELSE 1 END AS specialty_code,
        CASE upper(d.severity) WHEN 'HIGH' THEN 3 WHEN 'LOW' THEN 1 ELSE 2 END AS severity,
        CASE category WHEN 'Bone' THEN 0 WHEN 'Cold' THEN 1 WHEN 'Diabetes' THEN 2 WHEN 'Fever' THEN 3 WHEN 'Heart' THEN 4
             WHEN 'Skin' THEN 5 ELSE 0 END AS category_code
      FROM {{source}} x LEFT JOIN cost co ON x.procedure_code = co.procedure_code LEFT JOIN providers p ON x.provider_id = p.provider_id
      LEFT JOIN diagnosis d ON x.diagnosis_code = d.diagnosis_code) c"""

ENTRIES = [
    Entry(
        "F1_claim_base",
        lambda s: _plain(Medallion(s).base),
        query(
            "SELECT claim_id, patient_id, provider_id, diagnosis_code, procedure_code, CAST(billed_amount AS DOUBLE) AS billed_amount, is_billed_missing,"
            " CAST(claim_date AS VARCHAR) AS claim_date, denial_flag, provider_specialty, diag_category, diag_severity,"
            " CAST(average_cost AS DOUBLE) AS average_cost, CAST(expected_cost AS DOUBLE) AS expected_cost, proc_region FROM base",
            "base",
        ),
    ),
    Entry(
        "F2_cost_features",
        lambda s: f.cost_features(Medallion(s).base).select("claim_id", "billing_ratio", "cost_diff", "high_cost_flag"),
        query("SELECT claim_id, billing_ratio, cost_diff, high_cost_flag FROM all_features", "all_features"),
    ),
    Entry(
        "F3_provider_features",
        lambda s: f.with_provider_features(m.labeled, m.labeled).select(
            "claim_id", "provider_claim_count", "provider_denial_rate", "provider_avg_billed", "provider_risk_score") if (m := Medallion(s)) else None,
        query(
            "SELECT claim_id, provider_claim_count, provider_denial_rate, provider_avg_billed, "
            + half_up("provider_claim_count * provider_denial_rate", 4) + " AS provider_risk_score FROM all_features",
            "all_features",
        ),
    ),
    Entry(
        "F4_severity_score",
        lambda s: Medallion(s).base.select("claim_id", f.severity_score(F.col("diag_severity")).alias("severity_score")),
        query("SELECT claim_id, severity_score FROM all_features", "all_features"),
    ),
    Entry(
        "F5_diagnosis_volume",
        lambda s: f.with_diagnosis_volume(m.labeled, m.labeled).select("claim_id", "diag_claim_count") if (m := Medallion(s)) else None,
        query("SELECT claim_id, diag_claim_count FROM all_features", "all_features"),
    ),
    Entry(
        "F6_integrity_flags",
        lambda s: f.integrity_flags(Medallion(s).labeled).select("claim_id", "is_billed_missing", "is_proc_missing", "is_diag_missing", "missing_flag_count"),
        query(
            "SELECT claim_id, is_billed_missing, is_proc_missing, is_diag_missing, is_billed_missing + is_proc_missing + is_diag_missing AS missing_flag_count FROM all_features",
            "all_features",
        ),
    ),
    Entry(
        "F7_time_features",
        lambda s: f.time_features(m.labeled, m.labeled).select("claim_id", "claim_age_days", "claim_month") if (m := Medallion(s)) else None,
        query("SELECT claim_id, claim_age_days, claim_month FROM all_features", "all_features"),
    ),
    Entry(
        "F8_label_codes",
        lambda s: f.encode(m.base, m.providers, m.diagnosis, m.cost).select(
            "claim_id", "provider_specialty_enc", "diag_category_enc", "proc_region_enc") if (m := Medallion(s)) else None,
        query("SELECT claim_id, provider_specialty_enc, diag_category_enc, proc_region_enc FROM all_features", "all_features"),
    ),
    Entry(
        "F9_gold_features",
        lambda s: Medallion(s).gold,
        query("SELECT claim_id, " + ", ".join(fixed.FEATURES) + ", denial_flag FROM all_features", "all_features"),
    ),
    Entry(
        "F10_serving_features",
        lambda s: f.serving_features(s.claims, s.providers, s.diagnosis, s.cost, AS_OF).select("claim_id", "row_key", *fixed.FEATURES),
        query(SERVING.format(source="claims"), "claims", "cost", "providers", "diagnosis"),
    ),
]
