"""Profiling and data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.functions import fixed_values as fixed
from claimloom.operators import quality as q
from claimloom.plans.catalog import Entry
from claimloom.plans.catalog.risk import PROB, RULES, TIER
from claimloom.plans.silver import Medallion
from claimloom.plans.sql_text import avg2, half_up, pct, query

CLAIM = ["claim_id", "patient_id", "provider_id", "diagnosis_code", "procedure_code", "billed_amount", "claim_date", "policy_id"]
REPORTED = ["claim_id", "patient_id", "provider_id", "procedure_code", "billed_amount"]


def _null_rows(columns: list[str], table: str, extra: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count, {extra.format(c=c)} FROM {table}" for c in columns
    )


FEATURE_TYPES = {
    "billing_ratio": T.DoubleType(), "cost_diff": T.DoubleType(),
    "provider_claim_count": T.LongType(), "diag_claim_count": T.LongType(),
}
FEATURE_SCHEMA = T.StructType(
    [T.StructField("claim_id", T.StringType())]
    + [T.StructField(f, FEATURE_TYPES.get(f, T.IntegerType())) for f in fixed.FEATURES]
    + [T.StructField("denial_flag", T.IntegerType())]
)


def _schema_check(s):
    """Contract differences next to the row count of the table they concern."""
    gold = Medallion(s).gold
    wrong = q.schema_differences(gold, FEATURE_SCHEMA)
    names = ",".join(sorted(r.column_name for r in wrong.collect()))  # at most one row for each contract column
    return gold.agg(F.count("claim_id").alias("rows")).withColumn("differs", F.lit(names))


def _scored_label(s):
    return Medallion(s).scored


WIDE_REPORT = """WITH r AS (SELECT upper(trim(claim_id)) AS claim_id, coalesce(diagnosis_code, 'UNKNOWN') AS d,
  coalesce(procedure_code, 'UNKNOWN') AS p, CASE WHEN billed_amount > 0 THEN billed_amount ELSE 0 END AS b
  FROM claims QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY row_key) = 1),
w AS (SELECT r.*, CASE WHEN d = 'UNKNOWN' THEN 3 ELSE 0 END + CASE WHEN p = 'UNKNOWN' THEN 3 ELSE 0 END
  + CASE WHEN b = 0 THEN 2 ELSE 0 END + CASE WHEN average_cost > 0 AND b > average_cost * 2 THEN 2 ELSE 0 END AS points
  FROM r LEFT JOIN cost c ON r.p = c.procedure_code)
"""

ENTRIES = [
    Entry(
        "Q1_column_profile",
        lambda s: q.column_profile(s.claims.select(*CLAIM), exact=True),
        query(
            " UNION ALL ".join(
                f"SELECT '{c}' AS column_name, count(*) AS rows, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count,"
                f" CAST(min({c}) AS VARCHAR) AS smallest, CAST(max({c}) AS VARCHAR) AS largest FROM claims"
                for c in CLAIM
            ),
            "claims",
        ),
    ),
    Entry(
        "Q1_amount_profile",
        lambda s: q.amount_profile(s.claims, "billed_amount"),
        query(
            "SELECT 'billed_amount' AS column_name, count(billed_amount) AS rows, " + avg2("billed_amount", 4) + " AS mean, "
            + half_up("stddev_samp(CAST(billed_amount AS DOUBLE))", 4) + " AS stddev, CAST(min(billed_amount) AS DOUBLE) AS smallest, CAST(max(billed_amount) AS DOUBLE) AS largest, "
            + ", ".join(f"CAST(quantile_disc(billed_amount, {p}) AS DOUBLE) AS {n}" for n, p in q.QUARTILES.items()) + " FROM claims",
            "claims",
        ),
    ),
    Entry(
        "Q2_range_checks",
        lambda s: q.range_checks(s.claims),
        query(
            "SELECT count(*) FILTER (billed_amount < 0) AS negative_billed_amounts,"
            " count(*) FILTER (billed_amount > 100000) AS high_billed_amounts FROM claims",
            "claims",
        ),
    ),
    Entry(
        "Q3_duplicate_keys",
        lambda s: q.duplicate_keys(s.claims, "claim_id"),
        query("SELECT claim_id, count(*) AS duplicate_count FROM claims GROUP BY 1 HAVING count(*) > 1", "claims"),
    ),
    Entry(
        "Q4_volume_overview",
        lambda s: q.volume_overview(s.claims),
        query(
            "SELECT count(*) AS total_claims, count(DISTINCT claim_id) AS unique_claims, count(DISTINCT patient_id) AS unique_patients,"
            " count(DISTINCT provider_id) AS unique_providers, CAST(min(claim_date) AS VARCHAR) AS date_from,"
            " CAST(max(claim_date) AS VARCHAR) AS date_to FROM claims",
            "claims",
        ),
    ),
    Entry(
        "Q5_null_percentages",
        lambda s: q.null_percentages(s.claims, CLAIM),
        query("SELECT " + ", ".join(f"{pct(f'count(*) - count({c})', 'count(*)', 2)} AS {c}_null_pct" for c in CLAIM) + " FROM claims", "claims"),
    ),
    Entry(
        "Q6_null_report",
        lambda s: q.null_report(s.claims, REPORTED),
        query(_null_rows(REPORTED, "claims", pct("count(*) - count({c})", "count(*)", 1) + " AS null_pct"), "claims"),
    ),
    Entry(
        "Q7_null_analysis",
        lambda s: q.null_analysis(s.claims, CLAIM),
        query(
            "SELECT *, CASE WHEN null_pct > 5 THEN 'HIGH' ELSE 'OK' END AS status FROM ("
            + _null_rows(CLAIM, "claims", pct("count(*) - count({c})", "count(*)", 2) + " AS null_pct") + ")",
            "claims",
        ),
    ),
    Entry(
        "Q8_null_strategy",
        lambda s: q.null_strategy(s.claims, "billed_amount"),
        query(
            "SELECT *, CASE WHEN null_pct < 5 THEN 'DROP' WHEN null_pct <= 15 THEN 'IMPUTE' ELSE 'ESCALATE' END AS decision"
            " FROM (SELECT count(*) AS total_rows, count(*) - count(billed_amount) AS null_rows, "
            + pct("count(*) - count(billed_amount)", "count(*)", 2) + " AS null_pct FROM claims)",
            "claims",
        ),
    ),
    Entry(
        "Q9_amount_distribution",
        lambda s: q.amount_distribution(s.claims, "billed_amount"),
        query(
            "SELECT count(billed_amount) AS claims_with_amount, count(*) - count(billed_amount) AS missing_amount,"
            " CAST(min(billed_amount) AS DOUBLE) AS min_billed, CAST(quantile_disc(billed_amount, 0.25) AS DOUBLE) AS q1,"
            " CAST(quantile_disc(billed_amount, 0.5) AS DOUBLE) AS median, CAST(quantile_disc(billed_amount, 0.75) AS DOUBLE) AS q3, "
            + avg2("billed_amount") + " AS mean, CAST(max(billed_amount) AS DOUBLE) AS max_billed,"
            " count(*) FILTER (billed_amount < 0) AS negative_amounts, count(*) FILTER (billed_amount > 100000) AS extreme_outliers FROM claims",
            "claims",
        ),
    ),
    Entry(
        "Q10_amount_histogram",
        lambda s: q.amount_histogram(s.claims, "billed_amount", 5000),
        query(
            "SELECT CAST(floor(CAST(billed_amount AS DOUBLE) / 5000) AS BIGINT) * 5000 AS bucket_from, count(*) AS claims FROM claims"
            " WHERE billed_amount IS NOT NULL GROUP BY 1",
            "claims",
        ),
    ),
    Entry(
        "Q11_duplicated_rows",
        lambda s: q.duplicated_rows(s.claims.select("claim_id", "patient_id", "row_key"), "claim_id", F.col("row_key")),
        query(
            "SELECT * FROM (SELECT claim_id, patient_id, row_key, count(*) OVER (PARTITION BY claim_id) AS dupe_count FROM claims)"
            " WHERE dupe_count > 1",
            "claims",
        ),
    ),
    Entry(
        "Q12_invalid_amounts",
        lambda s: q.invalid_amounts(s.claims, "billed_amount"),
        query("SELECT count(*) FILTER (billed_amount IS NULL OR billed_amount <= 0) AS invalid_amounts FROM claims", "claims"),
    ),
    Entry(
        "Q13_outliers",
        lambda s: q.outliers(s.claims, "billed_amount", 3.0).select("claim_id", "row_key", F.col("billed_amount").cast("double").alias("billed_amount")),
        query(
            "SELECT claim_id, row_key, CAST(billed_amount AS DOUBLE) AS billed_amount FROM claims WHERE CAST(billed_amount AS DOUBLE) >"
            " 3 * (SELECT CAST(sum(billed_amount) AS DOUBLE) / count(billed_amount) FROM claims)",
            "claims",
        ),
    ),
    Entry(
        "Q14_label_distribution",
        lambda s: q.label_distribution(Medallion(s).wide_rules, "denial_flag"),
        query(
            WIDE_REPORT + "SELECT denial_flag, claims, pct, denial_flag IN (0, 1) AS in_domain, CASE WHEN denial_flag = 1 THEN"
            " CASE WHEN pct < 5 THEN 'LOW' WHEN pct > 50 THEN 'HIGH' ELSE 'NONE' END ELSE 'NONE' END AS warning FROM ("
            "SELECT denial_flag, count(*) AS claims, " + pct("count(*)", "sum(count(*)) OVER ()", 2)
            + " AS pct FROM (SELECT CASE WHEN points >= 3 THEN 1 ELSE 0 END AS denial_flag FROM w) GROUP BY 1)",
            "claims", "cost",
        ),
    ),
    Entry(
        "Q15_code_format",
        lambda s: q.code_format(s.claims, "diagnosis_code"),
        query(
            "SELECT count(*) FILTER (regexp_matches(diagnosis_code, '[a-z]')) AS lowercase_codes,"
            " count(*) FILTER (diagnosis_code <> trim(diagnosis_code)) AS whitespace_codes,"
            " count(*) FILTER (diagnosis_code IS NULL) AS null_codes FROM claims",
            "claims",
        ),
    ),
    Entry(
        "Q15_code_format_samples",
        lambda s: q.code_format_samples(s.claims, "diagnosis_code"),
        query(
            "SELECT claim_id, row_key, diagnosis_code FROM claims WHERE diagnosis_code IS NULL OR regexp_matches(diagnosis_code, '[a-z]')"
            " OR diagnosis_code <> trim(diagnosis_code) ORDER BY claim_id, row_key LIMIT 5",
            "claims",
        ),
    ),
    Entry(
        "Q16_key_overlap",
        lambda s: q.union_all(
            [
                q.key_overlap(s.claims, s.providers, "provider_id", "providers"),
                q.key_overlap(s.claims, s.diagnosis, "diagnosis_code", "diagnosis"),
                q.key_overlap(s.claims, s.cost, "procedure_code", "cost"),
            ]
        ),
        query(
            " UNION ALL ".join(
                f"SELECT '{t}' AS dimension, count(DISTINCT c.{k}) AS shared_keys, count(*) AS matched_rows FROM claims c JOIN (SELECT DISTINCT {k} FROM {t}) d ON c.{k} = d.{k}"
                for t, k in [("providers", "provider_id"), ("diagnosis", "diagnosis_code"), ("cost", "procedure_code")]
            ),
            "claims", "providers", "diagnosis", "cost",
        ),
    ),
    Entry(
        "Q16_key_coverage",
        lambda s: q.union_all(
            [
                q.key_coverage(s.claims, s.providers, "provider_id", "providers"),
                q.key_coverage(s.claims, s.diagnosis, "diagnosis_code", "diagnosis"),
                q.key_coverage(s.claims, s.cost, "procedure_code", "cost"),
            ]
        ),
        query(
            " UNION ALL ".join(
                f"SELECT '{t}' AS dimension, count(*) AS fact_keys, count(*) FILTER (k NOT IN (SELECT {c} FROM {t}) OR k IS NULL) AS unmatched, "
                + pct(f"count(*) - count(*) FILTER (k NOT IN (SELECT {c} FROM {t}) OR k IS NULL)", "count(*)", 2)
                + f" AS match_rate FROM (SELECT DISTINCT {c} AS k FROM claims)"
                for t, c in [("providers", "provider_id"), ("diagnosis", "diagnosis_code"), ("cost", "procedure_code")]
            ),
            "claims", "providers", "diagnosis", "cost",
        ),
    ),
    Entry(
        "Q17_summary_report",
        lambda s: q.summary_report(Medallion(s).wide_rules, "denial_flag"),
        query(
            WIDE_REPORT + "SELECT count(*) AS total_claims, count(*) FILTER (points >= 3) AS denied_claims, "
            + pct("count(*) FILTER (points >= 3)", "count(*)", 2)
            + " AS denial_rate, count(DISTINCT d) AS diagnosis_codes, count(DISTINCT p) AS procedure_codes,"
            " (SELECT count(DISTINCT coalesce(provider_id, 'UNKNOWN')) FROM standard_claims) AS providers FROM w",
            "claims", "cost", "standard_claims",
        ),
    ),
    Entry(
        "Q18_key_uniqueness",
        lambda s: q.key_uniqueness(
            {
                "bronze_claims": (s.claims, "claim_id"), "silver_claims": (Medallion(s).claims, "claim_id"),
                "silver_provider": (Medallion(s).providers, "provider_id"),
                "silver_diagnosis": (Medallion(s).diagnosis, "diagnosis_code"), "silver_cost": (Medallion(s).cost, "procedure_code"),
            }
        ),
        query(
            " UNION ALL ".join(
                f"SELECT '{n}' AS tbl, count(*) - count(DISTINCT {k}) AS dupe_pks FROM {t}"
                for n, t, k in [
                    ("bronze_claims", "claims", "claim_id"), ("silver_claims", "silver_claims", "claim_id"),
                    ("silver_provider", "silver_providers", "provider_id"),
                    ("silver_diagnosis", "silver_diagnosis", "diagnosis_code"), ("silver_cost", "silver_cost", "procedure_code"),
                ]
            ),
            "claims", "silver_claims", "silver_diagnosis", "silver_cost",
        ),
    ),
    Entry(
        "Q19_score_share",
        lambda s: q.share_by(Medallion(s).claims, "pre_risk_score"),
        query(
            "SELECT pre_risk_score, count(*) AS claim_count, " + pct("count(*)", "sum(count(*)) OVER ()", 1)
            + " AS pct FROM silver_claims GROUP BY 1",
            "silver_claims",
        ),
    ),
    Entry(
        "Q20_imputation_counts",
        lambda s: q.imputation_counts(Medallion(s).claims),
        query(
            "SELECT count(*) AS total_claims, count(*) FILTER (is_billed_missing) AS billed_imputed,"
            " count(*) FILTER (is_proc_missing) AS proc_unknown, count(*) FILTER (is_diag_missing) AS diag_unknown,"
            " count(*) FILTER (is_provider_missing) AS provider_unknown, count(*) FILTER (is_both_missing) AS both_bill_and_proc_missing,"
            " count(recovered_region) AS region_recovered_from_provider FROM silver_claims",
            "silver_claims",
        ),
    ),
    Entry(
        "Q21_null_gate",
        lambda s: q.require_no_nulls(Medallion(s).gold, fixed.FEATURES).agg(
            F.count("claim_id").alias("rows"), *[F.count(f).alias(f"n_{f}") for f in fixed.FEATURES]
        ),
        query("SELECT count(*) AS rows, " + ", ".join(f"count({f}) AS n_{f}" for f in fixed.FEATURES) + " FROM all_features", "all_features"),
    ),
    Entry(
        "Q22_schema_contract",
        _schema_check,
        query("SELECT count(*) AS rows, '' AS differs FROM silver_claims", "silver_claims"),
    ),
    Entry(
        "Q23_fan_out_guard",
        lambda s: q.fan_out(
            s.claims,
            {
                "providers": (q.unique_dimension(s.providers, "provider_id"), "provider_id"),
                "diagnosis": (q.unique_dimension(s.diagnosis, "diagnosis_code"), "diagnosis_code"),
                "cost": (q.unique_dimension(s.cost, "procedure_code"), "procedure_code"),
                "history": (s.history, "claim_id"),
            },
        ),
        query(
            " UNION ALL ".join(
                f"SELECT '{t}' AS dimension, (SELECT count(*) FROM claims) AS rows_before, count(*) AS rows_after,"
                f" count(*) = (SELECT count(*) FROM claims) AS safe FROM claims c LEFT JOIN {t} d ON c.{k} = d.{k}"
                for t, k in [("providers", "provider_id"), ("diagnosis", "diagnosis_code"), ("cost", "procedure_code"), ("history", "claim_id")]
            ),
            "claims", "providers", "diagnosis", "cost", "history",
        ),
    ),
    Entry(
        "Q24_silver_report",
        lambda s: q.silver_report(Medallion(s).wide_rules),
        query(
            WIDE_REPORT + "SELECT count(*) AS total_rows, count(*) FILTER (points >= 3) AS denied, count(*) FILTER (points < 3) AS approved, "
            + pct("count(*) FILTER (points >= 3)", "count(*)", 2)
            + " AS denial_rate, count(*) FILTER (d = 'UNKNOWN') AS unknown_diagnosis, count(*) FILTER (p = 'UNKNOWN') AS unknown_procedure, "
            + avg2("b") + " AS avg_billed FROM w",
            "claims", "cost",
        ),
    ),
    Entry(
        "Q24_distributions",
        lambda s: q.union_all(
            [
                q.share_by(Medallion(s).wide_rules, c, places=2).select(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value"), "claim_count", "pct")
                for c in ("denial_reason_code", "risk_tier", "denial_flag")
            ]
        ),
        query(
            RULES + ", w AS (SELECT reason2 AS denial_reason_code, " + TIER.format(q=PROB.format(p="points2")) + " AS risk_tier, CASE WHEN points2 >= 3 THEN 1 ELSE 0 END AS denial_flag FROM t2) "
            + " UNION ALL ".join(
                f"SELECT '{c}' AS kind, CAST({c} AS VARCHAR) AS value, count(*) AS claim_count, {pct('count(*)', '(SELECT count(*) FROM w)', 2)} AS pct FROM w GROUP BY 2"
                for c in ("denial_reason_code", "risk_tier", "denial_flag")
            ),
            "claims", "cost",
        ),
    ),
    Entry(
        "Q25_class_balance",
        lambda s: q.class_balance(_scored_label(s), "denial_flag"),
        query(
            "SELECT denied, approved, " + half_up("CAST(greatest(denied, approved) AS DOUBLE) / least(denied, approved)", 4)
            + " AS imbalance_ratio FROM (SELECT count(*) FILTER (denial_flag = 0) AS denied, count(*) FILTER (denial_flag = 1) AS approved FROM scored)",
            "scored",
        ),
    ),
    Entry(
        "Q26_kpi_card",
        lambda s: q.kpi_card(s.claims),
        query(
            "SELECT count(*) AS total_claims, count(DISTINCT patient_id) AS unique_patients, count(DISTINCT provider_id) AS unique_providers, "
            + half_up("CAST(sum(billed_amount) AS DOUBLE)", 0) + " AS total_billed, " + avg2("billed_amount", 0)
            + " AS avg_billed_per_claim, count(*) - count(billed_amount) AS missing_billed_count, "
            + pct("count(*) - count(billed_amount)", "count(*)", 1) + " AS missing_billed_pct, "
            + pct("count(billed_amount)", "count(*)", 1) + " AS data_completeness_pct FROM claims",
            "claims",
        ),
    ),
]
