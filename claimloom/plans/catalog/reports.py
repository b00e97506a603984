"""Analytical report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.functions import fixed_values as fixed
from claimloom.operators import quality as q
from claimloom.operators import reports as r
from claimloom.plans.catalog import Entry
from claimloom.plans.catalog.risk import PROB, RULES, TIER
from claimloom.operators.risk import points_probability
from claimloom.plans.silver import Medallion
from claimloom.sources.scratch import written
from claimloom.plans.sql_text import avg2, half_up, pct, query, ratio, values


def _money(df, *columns):
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def _dated(df):
    return df.withColumn("claim_date", F.col("claim_date").cast("string"))


def _codes(s):
    rows = [(i, code) for i, (code, _) in enumerate(fixed.ERROR_CODES)]
    return s.spark.createDataFrame(rows, "code_number int, error_code string")


def _descriptions(s):
    return s.spark.createDataFrame(fixed.ERROR_CODES, "error_code string, description string")


def _log(s):
    return r.request_log(s.table("events"), _codes(s))


LOG = (
    "SELECT *, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code, CASE WHEN event_type = 'error'"
    " THEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 19 END AS code_number FROM events"
)
CODES = values([(i, c, d) for i, (c, d) in enumerate(fixed.ERROR_CODES)], "n, error_code, description")


def _scored_status(s):
    """Labeled claims in the explanation table's shape: a status and a denial probability."""
    return written(Medallion(s).scored.select(
        "claim_id",
        F.when(F.col("denial_flag") == 0, "DENIED").otherwise("APPROVED").alias("predicted_status"),
        points_probability(F.col("final_risk_score")).alias("denial_probability"),
        "risk_tier", "final_risk_score", "billing_ratio", "diagnosis_code",
    ), "scored_status")


STATUS = (
    "SELECT claim_id, CASE WHEN denial_flag = 0 THEN 'DENIED' ELSE 'APPROVED' END AS predicted_status,"
    " CAST(list_extract([0.05, 0.20, 0.40, 0.65, 0.78, 0.88, 0.95], CAST(least(final_risk_score, 6) + 1 AS INTEGER)) AS DOUBLE)"
    " AS denial_probability, risk_tier, final_risk_score, billing_ratio, diagnosis_code FROM scored"
)


def _join(*tables: str) -> str:
    alias = {"providers": ("p", "provider_id"), "diagnosis": ("d", "diagnosis_code"), "cost": ("co", "procedure_code")}
    return "FROM claims c " + " ".join(f"LEFT JOIN {t} {alias[t][0]} ON c.{alias[t][1]} = {alias[t][0]}.{alias[t][1]}" for t in tables)


BILLED_STATS = f"count(c.claim_id) AS total_claims, {avg2('c.billed_amount')} AS avg_billed"
RATIO8 = (
    "(CASE WHEN c.billed_amount >= 0 THEN 1 ELSE -1 END * ((2 * CAST(abs(c.billed_amount) * 100 AS HUGEINT) * 100000000"
    " + CAST(co.expected_cost * 100 AS HUGEINT)) // (2 * CAST(co.expected_cost * 100 AS HUGEINT))))"
)

ENTRIES = [
    Entry(
        "A1_busiest_providers",
        lambda s: r.busiest_providers(s.claims),
        query(
            "SELECT provider_id, count(*) AS claim_count FROM claims WHERE provider_id IS NOT NULL GROUP BY 1"
            " ORDER BY claim_count DESC, provider_id LIMIT 20",
            "claims",
        ),
    ),
    Entry(
        "A2_costliest_providers",
        lambda s: r.costliest_providers(s.claims),
        query(
            f"SELECT provider_id, count(*) AS total_claims, {avg2('billed_amount')} AS avg_billed, CAST(min(billed_amount) AS DOUBLE) AS min_billed,"
            " CAST(max(billed_amount) AS DOUBLE) AS max_billed FROM claims WHERE provider_id IS NOT NULL GROUP BY 1"
            " ORDER BY avg_billed DESC, provider_id LIMIT 15",
            "claims",
        ),
    ),
    Entry(
        "A3_provider_volume",
        lambda s: r.provider_volume(s.claims, s.providers),
        query(
            f"SELECT c.provider_id, doctor_name, specialty, location, {BILLED_STATS}, CAST(sum(c.billed_amount) AS DOUBLE) AS total_billed "
            + _join("providers") + " GROUP BY 1, 2, 3, 4",
            "claims", "providers",
        ),
    ),
    Entry(
        "A4_severity_counts",
        lambda s: r.severity_counts(Medallion(s).diagnosis.join(s.claims, "diagnosis_code", "left_semi")),
        query("SELECT severity, count(*) AS count FROM silver_diagnosis WHERE diagnosis_code IN (SELECT diagnosis_code FROM claims) GROUP BY 1", "claims", "silver_diagnosis"),
    ),
    Entry(
        "A5_severity_cost",
        lambda s: r.severity_cost(s.claims, s.diagnosis),
        query(f"SELECT severity, {BILLED_STATS} " + _join("diagnosis") + " WHERE severity IS NOT NULL GROUP BY 1", "claims", "diagnosis"),
    ),
    Entry(
        "A6_diagnosis_volume",
        lambda s: r.diagnosis_volume(s.claims, s.diagnosis),
        query(f"SELECT c.diagnosis_code, category, severity, {BILLED_STATS} " + _join("diagnosis") + " GROUP BY 1, 2, 3", "claims", "diagnosis"),
    ),
    Entry(
        "A7_claims_with_provider",
        lambda s: _dated(_money(r.with_provider(s.claims, s.providers), "billed_amount")),
        query(
            "SELECT claim_id, patient_id, doctor_name, specialty, location, CAST(billed_amount AS DOUBLE) AS billed_amount,"
            " CAST(claim_date AS VARCHAR) AS claim_date " + _join("providers"),
            "claims", "providers",
        ),
    ),
    Entry(
        "A8_claims_with_diagnosis",
        lambda s: r.with_diagnosis(s.claims, s.diagnosis),
        query("SELECT claim_id, procedure_code, c.diagnosis_code, category, severity " + _join("diagnosis"), "claims", "diagnosis"),
    ),
    Entry(
        "A9_billing_gap_top25",
        lambda s: _money(r.top_billing_gaps(s.claims, s.cost, 25), "billed_amount", "expected_cost"),
        query(
            "SELECT claim_id, row_key, c.procedure_code, CAST(billed_amount AS DOUBLE) AS billed_amount, CAST(expected_cost AS DOUBLE) AS expected_cost, "
            + ratio("billed_amount", "expected_cost", 2)
            + " AS billing_ratio, CASE WHEN billed_amount > 1.5 * expected_cost THEN 'OVERPRICED' ELSE 'NORMAL' END AS pricing_flag "
            "FROM claims c JOIN cost co ON c.procedure_code = co.procedure_code WHERE expected_cost > 0"
            " ORDER BY billing_ratio DESC NULLS LAST, claim_id, row_key LIMIT 25",
            "claims", "cost",
        ),
    ),
    Entry(
        "A9_billing_gap_rows",
        lambda s: _money(r.billing_gap(s.claims, s.cost), "billed_amount", "expected_cost"),
        query(
            "SELECT claim_id, row_key, c.procedure_code, CAST(billed_amount AS DOUBLE) AS billed_amount, CAST(expected_cost AS DOUBLE) AS expected_cost, "
            + ratio("billed_amount", "expected_cost", 2)
            + " AS billing_ratio, CASE WHEN billed_amount > 1.5 * expected_cost THEN 'OVERPRICED' ELSE 'NORMAL' END AS pricing_flag "
            "FROM claims c JOIN cost co ON c.procedure_code = co.procedure_code WHERE expected_cost > 0",
            "claims", "cost",
        ),
    ),
    Entry(
        "A10_claims_by_specialty",
        lambda s: r.claims_by_specialty(s.claims, s.providers),
        query(
            f"SELECT specialty, {BILLED_STATS}, CAST(sum(c.billed_amount) AS DOUBLE) AS total_billed,"
            " count(*) - count(c.billed_amount) AS missing_amount_count " + _join("providers") + " GROUP BY 1",
            "claims", "providers",
        ),
    ),
    Entry(
        "A11_claims_by_region",
        lambda s: r.claims_by_region(s.claims, s.cost),
        query(
            "SELECT region, total_claims, " + half_up("ab", 2) + " AS avg_billed, " + half_up("ae", 2)
            + " AS avg_expected, total_billed, " + half_up("(ab - ae) * CAST(100 AS DOUBLE) / nullif(ae, 0)", 1)
            + " AS gap_pct FROM (SELECT region, count(*) AS total_claims, CAST(sum(billed_amount) AS DOUBLE) / nullif(count(billed_amount), 0) AS ab,"
            " CAST(sum(expected_cost) AS DOUBLE) / nullif(count(expected_cost), 0) AS ae, CAST(sum(billed_amount) AS DOUBLE) AS total_billed "
            + _join("cost") + " GROUP BY 1)",
            "claims", "cost",
        ),
    ),
    Entry(
        "A12_high_cost_claims",
        lambda s: _dated(_money(r.high_cost_claims(s.claims, s.providers, s.diagnosis, s.cost), "billed_amount", "expected_cost")),
        query(
            "SELECT claim_id, patient_id, doctor_name, specialty, c.diagnosis_code, category AS diagnosis_category, severity AS diagnosis_severity,"
            " c.procedure_code, CAST(billed_amount AS DOUBLE) AS billed_amount, CAST(expected_cost AS DOUBLE) AS expected_cost, "
            + ratio("billed_amount", "expected_cost", 2) + " AS billing_ratio, CAST(claim_date AS VARCHAR) AS claim_date "
            + _join("providers", "diagnosis", "cost") + " WHERE billed_amount >= (SELECT quantile_disc(billed_amount, 0.9) FROM claims)",
            "claims", "providers", "diagnosis", "cost",
        ),
    ),
    Entry(
        "A13_imputation_readiness",
        lambda s: r.imputation_readiness(r.missing_billed_claims(s.claims, s.cost)),
        query(
            "SELECT count(*) AS total_missing_billed, count(expected_cost) AS can_impute_count, count(*) - count(expected_cost) AS cannot_impute_count, "
            + pct("count(expected_cost)", "count(*)", 1) + " AS imputable_pct " + _join("cost") + " WHERE billed_amount IS NULL",
            "claims", "cost",
        ),
    ),
    Entry(
        "A14_dashboard_tiles",
        lambda s: q.union_all(
            [
                r.claims_by_specialty(s.claims, s.providers).where("specialty is not null").select(
                    F.lit("specialty").alias("tile"), F.col("specialty").alias("name"), "total_claims", "avg_billed", "total_billed"),
                r.claims_by_region(s.claims, s.cost).where("region is not null").select(
                    F.lit("region").alias("tile"), F.col("region").alias("name"), "total_claims", "avg_billed", "total_billed"),
            ]
        ),
        query(
            f"SELECT 'specialty' AS tile, specialty AS name, {BILLED_STATS}, CAST(sum(c.billed_amount) AS DOUBLE) AS total_billed {_join('providers')}"
            f" WHERE specialty IS NOT NULL GROUP BY 2 UNION ALL SELECT 'region', region, {BILLED_STATS}, CAST(sum(c.billed_amount) AS DOUBLE)"
            f" {_join('cost')} WHERE region IS NOT NULL GROUP BY 2",
            "claims", "providers", "cost",
        ),
    ),
    Entry(
        "A15_category_severity",
        lambda s: r.category_severity(s.claims, s.diagnosis),
        query(f"SELECT category, severity, {BILLED_STATS} " + _join("diagnosis") + " WHERE category IS NOT NULL GROUP BY 1, 2", "claims", "diagnosis"),
    ),
    Entry(
        "A16_monthly_volume",
        lambda s: r.monthly_volume(s.claims),
        query(
            "SELECT strftime(claim_date, '%Y-%m') AS month, count(*) AS total_claims, " + half_up("CAST(sum(billed_amount) AS DOUBLE)", 0)
            + " AS total_billed FROM claims WHERE claim_date IS NOT NULL GROUP BY 1",
            "claims",
        ),
    ),
    Entry(
        "A17_overpriced_by_specialty",
        lambda s: r.overpriced_by_specialty(s.claims, s.providers, s.cost),
        query(
            "SELECT specialty, count(*) AS total_claims, "
            + half_up(f"CAST(CAST(sum({RATIO8}) AS DECIMAL(38,0)) * CAST(0.00000001 AS DECIMAL(8,8)) AS DOUBLE) / nullif(count(billed_amount), 0)", 2).replace(
                "CAST(CAST(sum(", "(CAST(sum(").replace("AS DECIMAL(38,0)) * CAST(0.00000001 AS DECIMAL(8,8)) AS DOUBLE)", "AS DOUBLE) / CAST(100000000 AS DOUBLE))")
            + " AS avg_billing_ratio, count(*) FILTER (billed_amount > 1.5 * expected_cost) AS overpriced_count, "
            + pct("count(*) FILTER (billed_amount > 1.5 * expected_cost)", "count(*)", 1)
            + " AS overpriced_pct " + _join("cost", "providers") + " WHERE expected_cost > 0 GROUP BY 1",
            "claims", "cost", "providers",
        ),
    ),
    Entry(
        "A18_risk_categories",
        lambda s: r.risk_categories(s.claims, s.cost),
        query(
            "SELECT CASE WHEN billed_amount IS NULL THEN 'High Risk  — Missing Bill' WHEN billed_amount > 1.5 * expected_cost THEN 'High Risk  — Overpriced'"
            " WHEN provider_id IS NULL OR patient_id IS NULL THEN 'Medium Risk — Missing Identity' ELSE 'Low Risk   — Normal' END AS risk_category,"
            " count(*) AS total_claims " + _join("cost") + " GROUP BY 1",
            "claims", "cost",
        ),
    ),
    Entry(
        "A19_denial_rate_by_diagnosis",
        lambda s: r.denial_rate_by_diagnosis(_scored_status(s)),
        query(
            "SELECT diagnosis_code, count(*) AS total, count(*) FILTER (denial_flag = 0) AS denied, "
            + pct("count(*) FILTER (denial_flag = 0)", "count(*)", 1)
            + " AS denial_rate_pct FROM scored GROUP BY 1 ORDER BY total DESC, diagnosis_code LIMIT 15",
            "scored",
        ),
    ),
    Entry(
        "A20_ratio_histogram",
        lambda s: r.ratio_histogram(_scored_status(s)),
        query(
            "SELECT " + half_up("billing_ratio", 1) + " AS ratio_bucket, count(*) AS cnt FROM scored WHERE billing_ratio BETWEEN 0 AND 5 GROUP BY 1",
            "scored",
        ),
    ),
    Entry(
        "A23_spot_checks",
        lambda s: q.union_all(
            [
                r.top_rows(x, status, order, n).select(F.lit(name).alias("check_name"), "claim_id", "predicted_status", "denial_probability")
                for x in [_scored_status(s)]
                for name, status, order, n in [
                    ("denied", "DENIED", [F.desc("denial_probability"), "claim_id"], 5),
                    ("approved", "APPROVED", ["denial_probability", "claim_id"], 5),
                    ("most_confident", "DENIED", [F.desc("denial_probability"), F.desc("claim_id")], 3),
                ]
            ]
        ),
        query(
            f"WITH st AS ({STATUS}) "
            + " UNION ALL ".join(
                f"SELECT * FROM (SELECT '{n}' AS check_name, claim_id, predicted_status, denial_probability FROM st WHERE predicted_status = '{w}' ORDER BY {o} LIMIT {k})"
                for n, w, o, k in [
                    ("denied", "DENIED", "denial_probability DESC, claim_id", 5), ("approved", "APPROVED", "denial_probability, claim_id", 5),
                    ("most_confident", "DENIED", "denial_probability DESC, claim_id DESC", 3),
                ]
            ),
            "scored",
        ),
    ),
    Entry(
        "A25_label_and_tier_counts",
        lambda s: q.union_all(
            [
                x.groupBy(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")).agg(F.count("*").alias("claims"))
                for x in [_scored_status(s)] for c in ["predicted_status", "risk_tier", "final_risk_score"]
            ]
        ),
        query(
            f"WITH st AS ({STATUS}) "
            + " UNION ALL ".join(
                f"SELECT '{c}' AS kind, CAST({c} AS VARCHAR) AS value, count(*) AS claims FROM st GROUP BY 2" for c in ["predicted_status", "risk_tier", "final_risk_score"]
            ),
            "scored",
        ),
    ),
    Entry(
        "A25_rule_counts",
        lambda s: q.union_all(
            [Medallion(s).wide_rules.groupBy(F.lit(c).alias("kind"), F.col(c).alias("value")).agg(F.count("*").alias("claims")) for c in ("denial_reason_code", "risk_tier")]
        ),
        query(
            RULES + ", w AS (SELECT reason2 AS denial_reason_code, " + TIER.format(q=PROB.format(p="points2")) + " AS risk_tier FROM t2) "
            + " UNION ALL ".join(f"SELECT '{c}' AS kind, {c} AS value, count(*) AS claims FROM w GROUP BY 2" for c in ("denial_reason_code", "risk_tier")),
            "claims", "cost",
        ),
    ),
    Entry(
        "A26_request_metrics",
        lambda s: r.request_metrics(_log(s)),
        f"SELECT count(*) AS total_requests, count(*) FILTER (status_code >= 400) AS total_errors, {pct('count(*) FILTER (status_code >= 400)', 'count(*)', 2)}"
        f" AS error_rate_pct FROM ({LOG})",
    ),
    Entry(
        "A26_error_code_counts",
        lambda s: r.error_code_counts(_log(s), _descriptions(s)).drop("description"),
        f"SELECT error_code, count(*) AS errors FROM ({LOG}) l JOIN ({CODES}) c ON l.code_number = c.n GROUP BY 1",
    ),
    Entry(
        "A27_claim_id_of_body",
        lambda s: s.table("events").select(
            "event_id", r.claim_id_of_body(F.regexp_replace("props", '"k"', '"claim_id"')).alias("claim_id"),
            r.claim_id_of_body(F.concat(F.lit("{"), F.col("props"))).alias("malformed_claim_id"),
        ),
        "SELECT event_id, coalesce(json_extract_string(replace(props, '\"k\"', '\"claim_id\"'), '$.claim_id'), '') AS claim_id,"
        " '' AS malformed_claim_id FROM events",
    ),
]
