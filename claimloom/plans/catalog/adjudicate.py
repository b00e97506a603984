"""Validation, duplicates, rules, attribution and adjudication queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.functions import fixed_values as fixed
from claimloom.functions.skew import enrich
from claimloom.functions.texts import service_date
from claimloom.operators import adjudicate as ad
from claimloom.operators import attribution as at
from claimloom.operators import duplicates, extract, rules
from claimloom.operators.features import mean_expected_cost, serving_features
from claimloom.operators.reports import error_code_counts
from claimloom.plans import batch as plan
from claimloom.plans.catalog import Entry
from claimloom.plans.catalog.reports import _descriptions as descriptions_of
from claimloom.plans.catalog.reports import _log as request_log_of
from claimloom.plans.scoring_sql import DUPLICATES, IMPORTANCES, INTERCEPT, SCORES, WEIGHTS, case, d, money, referenced, scored
from claimloom.plans.silver import AS_OF
from claimloom.plans.sql_text import AS_OF as AS_OF_TEXT
from claimloom.plans.sql_text import query, quote, values
from claimloom.sources.scratch import written

KEYS = ["claim_id", "row_key"]
TABLES = ("claims", "cost", "providers", "diagnosis", "policies")
BATCH_TABLES = ("batch", "history", "cost", "providers", "diagnosis", "policies")


def dims(s) -> plan.Dimensions:
    return plan.Dimensions(s.providers, s.diagnosis, s.cost, s.policies)


def p_approved():
    return at.logistic_probability(WEIGHTS, INTERCEPT)


def refs(s):
    return rules.with_references(s.claims, s.providers, s.diagnosis, s.cost, s.policies)


def scored_claims(s):
    return plan.score(s.claims, dims(s), p_approved(), AS_OF, IMPORTANCES)


def explained(s):
    return scored_claims(s).withColumn("outcome", ad.granular_outcome())


def with_category(s):
    none = F.array().cast("array<struct<rule_id:string,field:string,message:string>>")
    return explained(s).withColumn("violations", none).withColumn("denial_category", ad.denial_category())


def joined(array, field):
    return F.array_join(F.transform(array, lambda r: r[field]), " | ")


def batch_result(s):
    return plan.adjudicate_batch(s.batch, s.history, dims(s), p_approved(), AS_OF, IMPORTANCES)


def _batch_duplicates(s):
    """Dated rows through the engine; rows without a date stay, as invalid input."""
    dated = s.batch.withColumn("claim_date", service_date(F.col("service_date")))
    marked = duplicates.marked(dated.where("claim_date IS NOT NULL"), s.history)
    none = F.lit(False)
    invalid = dated.where("claim_date IS NULL").withColumns(
        {"duplicate_type": F.lit("INVALID_INPUT"), "is_blocked": none, "is_revised": none, "force_review": none, "matched_claim_id": F.lit(None).cast("string")}
    )
    columns = [*KEYS, "duplicate_type", "is_blocked", "is_revised", "force_review", "matched_claim_id"]
    return duplicates.with_decision(marked).select(columns).unionByName(invalid.select(columns))


def chain(*, future: bool = False) -> str:
    return "WITH " + referenced("claims", future) + ", " + scored() + " "


DUPLICATE_REASON = "replace(" + case({k: quote(v[0]) for k, v in fixed.DUPLICATE_TEXTS.items()}, "duplicate_type", "NULL") + ", '{matched}', coalesce(matched_claim_id, ''))"
BATCH = (
    "WITH " + DUPLICATES + ", " + referenced("dup") + ", " + scored("(SELECT * FROM ruled WHERE NOT is_blocked AND len(violations) = 0)")
    + """, final AS (SELECT claim_id, row_key, 'INVALID_INPUT' AS status, '—' AS duplicate_type, CAST(0 AS DOUBLE) AS denial_prob,
  'INVALID_INPUT' AS outcome, 'Invalid service date: ''''' AS primary_reason, 'N/A' AS policy_match,
  'Ensure the service date is a valid date (e.g. YYYY-MM-DD or DD/MM/YYYY).' AS next_action FROM batch WHERE service_date IS NULL
UNION ALL SELECT claim_id, row_key, 'DUPLICATE_BLOCKED', duplicate_type, CAST(0 AS DOUBLE), 'DUPLICATE_BLOCKED', """
    + DUPLICATE_REASON + ", 'N/A', "
    + case({k: quote(v[1]) for k, v in fixed.DUPLICATE_TEXTS.items()}, "duplicate_type", "NULL") + """ FROM ruled WHERE is_blocked
UNION ALL SELECT claim_id, row_key, 'REJECTED', duplicate_type, CAST(1 AS DOUBLE), 'RULE_DENY',
  array_to_string(list_transform(violations, lambda v: v.message), '; '), 'N/A', 'Correct rule violations and resubmit.' FROM ruled
  WHERE NOT is_blocked AND len(violations) > 0
UNION ALL SELECT claim_id, row_key, 'INVALID_INPUT', duplicate_type, CAST(0 AS DOUBLE), 'INVALID_INPUT', """
    + f"{quote(fixed.SCORING_FAILED[0])}, 'N/A', {quote(fixed.SCORING_FAILED[1])} FROM explained WHERE billed_amount < 0"
    + """
UNION ALL SELECT claim_id, row_key, status, duplicate_type, denial_prob, outcome, coalesce("""
    + DUPLICATE_REASON + """, e1, ''),
  CASE WHEN contains(status, 'APPROVED') OR contains(status, 'RESUBMISSION') THEN 'RAG Match: Approved Policy Criteria'
       ELSE 'RAG Match: Policy Exception Detected' END,
  CASE WHEN is_revised OR force_review THEN """
    + case({k: quote(v[1]) for k, v in fixed.DUPLICATE_TEXTS.items()}, "duplicate_type", "NULL") + " ELSE "
    + case({k: quote(v) for k, v in fixed.BATCH_ACTIONS.items()}, "status", "NULL") + """ END
  FROM (SELECT *, CASE WHEN is_revised THEN 'REVISED_RESUBMISSION' WHEN force_review THEN 'MANUAL_REVIEW'
        WHEN outcome = 'HOLD_FOR_CORRECTION' THEN 'REJECTED' ELSE outcome END AS status FROM explained WHERE billed_amount >= 0)) """
)
CATEGORY = {f: quote(n) for n, members in fixed.DRIVER_CATEGORIES.items() for f in members}
CATEGORY_SQL = f"CASE WHEN lowest IS NULL THEN '{fixed.CLEAN_CATEGORY}' ELSE {case(CATEGORY, 'lowest', quote(fixed.OTHER_CATEGORY))} END"
NEGATIVE = lambda names: "(" + " OR ".join(f"(f{i} IN ({', '.join(map(quote, names))}) AND i{i} < 0)" for i in (1, 2, 3)) + ")"
SHOWN = lambda names: "(" + " OR ".join(f"coalesce(f{i} IN ({', '.join(map(quote, names))}), false)" for i in (1, 2, 3)) + ")"
LATE = f"coalesce(date_diff('day', claim_date, DATE '{AS_OF_TEXT}') > 90, false)"
B, E = money("billed"), money("expected")


def _texts(s):
    """Claim letters with labelled values; gaps of the claim leave their label out."""
    line = lambda label, c: F.concat(F.lit(label), c)
    date = F.when(F.col("order_status") == "P", F.date_format("claim_date", "MM/dd/yyyy")).otherwise(F.col("claim_date").cast("string"))
    label = F.when(F.col("order_status") == "P", F.lit("Date: ")).otherwise(F.lit("Date of Service: "))
    return s.claims.select(
        *KEYS,
        F.concat_ws(
            "\n",
            F.lit("To whom it may concern, we submit the following claim."),
            line("Claim ID: ", F.col("claim_id")),
            F.when(F.col("return_flag") == "R", line("Member reference ", F.col("patient_id"))).otherwise(line("patient number: ", F.col("patient_id"))),
            line("Provider ID: ", F.col("provider_id")), line("Primary Diagnosis Code: ", F.col("diagnosis_code")),
            line("Procedure Performed: ", F.concat("procedure_code", F.lit("(Consultation)"))),
            line("Billed Amount: $", F.format_number(F.col("billed_amount").cast("double"), 2)),
            F.concat(label, date), line("Policy #: ", F.col("policy_id")),
        ).alias("text"),
    )


def _extracted(s):
    return extract.extract_fields(_texts(s))


EXTRACTED = (
    "SELECT claim_id, row_key, claim_id AS x_claim_id, patient_id AS x_patient_id, provider_id AS x_provider_id, diagnosis_code AS x_diagnosis_code,"
    " procedure_code AS x_procedure_code, policy_id AS x_policy_id, CASE WHEN billed_amount >= 0 THEN CAST(billed_amount AS DOUBLE) END AS x_billed_amount,"
    " CAST(claim_date AS VARCHAR) AS x_date FROM claims"
)
_CONF = {n: c for n, (c, _) in fixed.FIELD_PATTERNS.items()}
VALIDATED = f"""WITH e AS ({EXTRACTED}) SELECT e.claim_id, e.row_key,
  concat_ws(' | ', CASE WHEN x_billed_amount IS NULL THEN 'R-H5: billed_amount is missing from the document' END,
    CASE WHEN x_date IS NULL THEN 'R-H6: service date is missing from the document'
         WHEN x_date > '{AS_OF_TEXT}' THEN 'R-H6: service date ''' || x_date || ''' is in the future' END) AS hard_blocks,
  concat_ws(' | ', CASE WHEN x_provider_id IS NOT NULL AND p.provider_id IS NULL THEN 'R-S1: provider_id ''' || x_provider_id || ''' was not found in the approved provider list — verify manually' END,
    CASE WHEN x_diagnosis_code IS NOT NULL AND g.diagnosis_code IS NULL THEN 'R-S2: diagnosis_code ''' || x_diagnosis_code || ''' was not found in the approved diagnosis list — verify manually' END,
    CASE WHEN x_procedure_code IS NOT NULL AND c.procedure_code IS NULL THEN 'R-S3: procedure_code ''' || x_procedure_code || ''' was not found in the approved CPT list — verify manually' END,
    CASE WHEN x_procedure_code IS NULL THEN 'R-S5: procedure_code is missing — select it manually in the form' END,
    CASE WHEN x_diagnosis_code IS NULL THEN 'R-S6: diagnosis_code is missing — select it manually in the form' END,
    CASE WHEN x_provider_id IS NULL THEN 'R-S7: provider_id is missing — select it manually in the form' END) AS soft_warnings
FROM e LEFT JOIN providers p ON e.x_provider_id = p.provider_id LEFT JOIN diagnosis g ON e.x_diagnosis_code = g.diagnosis_code
LEFT JOIN cost c ON e.x_procedure_code = c.procedure_code"""


def _validated(s):
    return extract.validate_extracted(_extracted(s), s.providers, s.diagnosis, s.cost, AS_OF, "row_key")


def _date_texts(s):
    return s.claims.select(
        *KEYS,
        F.when(F.col("order_status") == "F", F.col("claim_date").cast("string")).when(F.col("order_status") == "O", F.date_format("claim_date", "d/M/yyyy"))
        .otherwise(F.date_format("claim_date", "MM.dd.yyyy")).alias("date_text"),
    )


ENTRIES = [
    Entry(
        "V1_row_errors",
        lambda s: s.claims.select(
            "row_key", F.when(F.col("return_flag") == "R", F.substring("claim_id", 2, 20)).otherwise(F.col("claim_id")).alias("claim_id"),
            F.when(F.col("return_flag") == "A", F.lit(" ")).otherwise(F.col("patient_id")).alias("patient_id"),
        ).withColumns({"errors": rules.row_errors(), "strict_errors": rules.row_errors(strict=True)}),
        query(
            "SELECT row_key, CASE WHEN return_flag = 'R' THEN substr(claim_id, 2) ELSE claim_id END AS claim_id, CASE WHEN return_flag = 'A' THEN ' ' ELSE patient_id END AS patient_id,"
            " CASE return_flag WHEN 'R' THEN 'claim_id ''' || substr(claim_id, 2) || ''' invalid (need CXXXX)' WHEN 'A' THEN 'patient_id missing' ELSE 'Valid' END AS errors,"
            " 'claim_id ''' || CASE WHEN return_flag = 'R' THEN substr(claim_id, 2) ELSE claim_id END || ''' invalid (need CXXXX); ' || CASE WHEN return_flag = 'A'"
            " THEN 'patient_id missing' ELSE 'patient_id ''' || patient_id || ''' invalid (need PXXX)' END AS strict_errors FROM claims",
            "claims",
        ),
    ),
    Entry(
        "V2_service_date",
        lambda s: _date_texts(s).withColumn("parsed", service_date(F.col("date_text")).cast("string")),
        query(
            "SELECT *, CAST(CAST(try_strptime(replace(replace(date_text, '.', '-'), '/', '-'), ['%Y-%m-%d', '%d-%m-%Y', '%m-%d-%Y']) AS DATE) AS VARCHAR) AS parsed FROM ("
            "SELECT claim_id, row_key, CASE order_status WHEN 'F' THEN CAST(claim_date AS VARCHAR) WHEN 'O' THEN strftime(claim_date, '%-d/%-m/%Y') ELSE strftime(claim_date, '%m.%d.%Y') END AS date_text FROM claims)",
            "claims",
        ),
    ),
    Entry(
        "V3_validate_extracted",
        lambda s: _validated(s).select(*KEYS, F.array_join("hard_blocks", " | ").alias("hard_blocks"), F.array_join("soft_warnings", " | ").alias("soft_warnings")),
        query(VALIDATED, "claims", "providers", "diagnosis", "cost"),
    ),
    Entry(
        "V4_extract_fields",
        lambda s: _extracted(s).select(*KEYS, *[F.col("extracted")[n]["value"].alias(f"x_{n}") for n in extract.ALL_FIELDS]),
        query(EXTRACTED, "claims"),
    ),
    Entry(
        "V5_fingerprints",
        lambda s: s.batch.select(*KEYS, duplicates.exact_fingerprint().alias("exact_fp"), duplicates.suspicious_fingerprint().alias("suspicious_fp"), duplicates.content_hash().alias("content_fp")),
        query(
            "SELECT claim_id, row_key, sha256(lower(concat(claim_id, '|', patient_id, '|', provider_id, '|', diagnosis_code, '|', procedure_code, '|', CAST(coalesce(billed_amount, 0) AS VARCHAR), '|', service_date, '|', policy_id))) AS exact_fp,"
            " sha256(lower(concat(patient_id, '|', provider_id, '|', procedure_code, '|', CAST(coalesce(billed_amount, 0) AS VARCHAR), '|', service_date))) AS suspicious_fp,"
            " substr(sha256(upper(concat(provider_id, '|', diagnosis_code, '|', procedure_code, '|', CAST(coalesce(billed_amount, 0) AS VARCHAR), '|', service_date, '|', policy_id, '|', patient_id))), 1, 16) AS content_fp FROM batch",
            "batch",
        ),
    ),
    Entry(
        "V6_V7_batch_duplicates",
        _batch_duplicates,
        query(
            "WITH " + DUPLICATES + " SELECT claim_id, row_key, duplicate_type, is_blocked, is_revised, force_review, matched_claim_id FROM dup"
            " UNION ALL SELECT claim_id, row_key, 'INVALID_INPUT', false, false, false, NULL FROM batch WHERE service_date IS NULL",
            "batch", "history",
        ),
    ),
    Entry(
        "V8_single_claim_check",
        lambda s: duplicates.single_check(s.batch.withColumn("claim_date", service_date(F.col("service_date"))), s.history).select(
            *KEYS, "duplicate_status", "matched_claim_id", F.date_format("matched_at", "yyyy-MM-dd HH:mm:ss").alias("matched_at")),
        query(
            """WITH k AS (SELECT *, concat_ws('|', coalesce(provider_id, '~'), coalesce(diagnosis_code, '~'), coalesce(procedure_code, '~'), coalesce(CAST(billed_amount AS VARCHAR), '~'),
  coalesce(CAST(claim_date AS VARCHAR), '~'), policy_id, patient_id) AS c FROM history),
b AS (SELECT *, concat_ws('|', coalesce(provider_id, '~'), coalesce(diagnosis_code, '~'), coalesce(procedure_code, '~'), coalesce(CAST(billed_amount AS VARCHAR), '~'),
  coalesce(service_date, '~'), policy_id, patient_id) AS c FROM batch),
m1 AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY c ORDER BY submitted_at DESC, claim_id DESC, row_key DESC) = 1),
m2 AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY submitted_at DESC, row_key DESC) = 1)
SELECT b.claim_id, b.row_key, CASE WHEN m1.claim_id IS NOT NULL THEN 'ENTIRE_DUPLICATE' WHEN m2.claim_id IS NOT NULL THEN 'DUPLICATE_ID' ELSE 'NEW' END AS duplicate_status,
  coalesce(m1.claim_id, m2.claim_id) AS matched_claim_id, strftime(coalesce(m1.submitted_at, m2.submitted_at), '%Y-%m-%d %H:%M:%S') AS matched_at
FROM b LEFT JOIN m1 ON b.c = m1.c LEFT JOIN m2 ON b.claim_id = m2.claim_id""",
            "batch", "history",
        ),
    ),
    Entry(
        "V9_V10_rule_violations",
        lambda s: rules.apply_rules(refs(s), AS_OF).select(
            *KEYS, joined(F.col("violations"), "rule_id").alias("rule_ids"), joined(F.col("violations"), "field").alias("fields"), joined(F.col("violations"), "message").alias("messages")),
        query(
            "WITH " + referenced("claims", True) + " SELECT claim_id, row_key, array_to_string(list_transform(violations, lambda v: v.rule), ' | ') AS rule_ids,"
            " array_to_string(list_transform(violations, lambda v: v.field), ' | ') AS fields, array_to_string(list_transform(violations, lambda v: v.message), ' | ') AS messages FROM ruled",
            *TABLES,
        ),
    ),
    Entry(
        "V11_billing_verdict",
        lambda s: refs(s).select(*KEYS, rules.billing_verdict().alias("billing_verdict")),
        query("WITH " + referenced("claims") + " SELECT claim_id, row_key, billing_verdict FROM ruled", *TABLES),
    ),
    Entry(
        "V12_granular_outcome",
        lambda s: explained(s).select(*KEYS, "denial_prob", "billing_verdict", "outcome"),
        query(chain() + "SELECT claim_id, row_key, denial_prob, billing_verdict, outcome FROM explained", *TABLES),
    ),
    Entry(
        "V13_batch_status",
        lambda s: batch_result(s).select(*KEYS, "status", "duplicate_type", "denial_prob", "outcome", "primary_reason", "policy_match", "next_action"),
        query(BATCH + "SELECT * FROM final", *BATCH_TABLES),
    ),
    Entry(
        "A24_batch_status_counts",
        lambda s: batch_result(s).groupBy("status").agg(F.count("*").alias("claims")),
        query(BATCH + "SELECT status, count(*) AS claims FROM final GROUP BY 1", *BATCH_TABLES),
    ),
    Entry(
        "V14_denial_category",
        lambda s: with_category(s).select(*KEYS, "denial_category"),
        query(chain() + f"SELECT claim_id, row_key, {CATEGORY_SQL} AS denial_category FROM explained", *TABLES),
    ),
    Entry(
        "V15_ranked_reasons",
        lambda s: written(scored_claims(s).select(*KEYS, "reasons"), "reasons").select(*KEYS, F.inline("reasons")).drop("policy_text", "policy_source"),
        query(chain() + "SELECT claim_id, row_key, rank, f AS feature, explanation, i AS impact_score FROM rk WHERE rank <= 3", *TABLES),
    ),
    Entry(
        "V16_recommendation",
        lambda s: scored_claims(s).select(*KEYS, "recommended.recommendation", "recommended.next_action"),
        query(chain() + "SELECT claim_id, row_key, recommendation, next_action FROM explained", *TABLES),
    ),
    Entry(
        "V17_scoring_chain",
        lambda s: scored_claims(s).select(
            *KEYS, "predicted_status", "denial_prob", "risk_level", "billing_ratio", F.get("reasons", F.lit(0))["explanation"].alias("primary_reason"),
            "recommended.recommendation", F.coalesce("error_code", F.lit("")).alias("error_code")),
        query(
            chain() + "SELECT claim_id, row_key, CASE WHEN billed_amount < 0 THEN 'ERROR' ELSE predicted_status END AS predicted_status, denial_prob, risk_level, billing_ratio,"
            " e1 AS primary_reason, recommendation, CASE WHEN billed_amount < 0 THEN 'CDP-001-001' ELSE '' END AS error_code FROM explained",
            *TABLES,
        ),
    ),
    Entry(
        "V18_fix_list",
        lambda s: explained(s).withColumn("fixes", ad.fix_list()).select(
            *KEYS, joined(F.col("fixes"), "label").alias("labels"), joined(F.col("fixes"), "impact").alias("impacts"), joined(F.col("fixes"), "action").alias("actions")),
        query(
            chain() + "SELECT claim_id, row_key, "
            + ", ".join(
                "concat_ws(' | ', " + ", ".join(f"CASE WHEN i{i} < 0 THEN {body.format(i=i)} END" for i in (1, 2, 3)) + f") AS {name}"
                for name, body in {
                    "labels": case({k: quote(v) for k, v in fixed.DRIVER_LABELS.items()}, "f{i}", "f{i}"),
                    "impacts": "CASE WHEN outcome = 'HOLD_FOR_CORRECTION' THEN 'CRITICAL' WHEN abs(i{i}) > 0.1 THEN 'HIGH' ELSE 'MEDIUM' END",
                    "actions": case(
                        {
                            k: quote(v).replace("{billed}", f"' || {B} || '").replace("{expected}", f"' || {E} || '")
                            .replace("{diagnosis}", "' || coalesce(diagnosis_code, 'MISSING') || '").replace("{procedure}", "' || coalesce(procedure_code, 'MISSING') || '")
                            .replace("{provider_id}", "' || coalesce(provider_id, '') || '").replace("{diagnosis_code}", "' || coalesce(diagnosis_code, '') || '")
                            .replace("{procedure_code}", "' || coalesce(procedure_code, '') || '").replace("{", "{{").replace("}", "}}")
                            for k, v in fixed.FIX_ACTIONS.items()
                        },
                        "f{i}", "next_action",
                    ),
                }.items()
            )
            + " FROM explained",
            *TABLES,
        ),
    ),
    Entry(
        "V18_completeness",
        lambda s: rules.apply_rules(refs(s)).select(*KEYS, ad.completeness().alias("valid_fields")),
        query("WITH " + referenced("claims") + " SELECT claim_id, row_key, greatest(7 - len(violations), 0) AS valid_fields FROM ruled", *TABLES),
    ),
    Entry(
        "V19_outcome_action",
        lambda s: with_category(s).withColumn("shown", ad.outcome_action(AS_OF)).select(*KEYS, "shown.title", "shown.steps"),
        query(
            chain() + f"""SELECT claim_id, row_key, """ + ", ".join(
                f"CASE WHEN t AND b THEN {quote(x[0])} WHEN t THEN {quote(x[1])} WHEN b AND billing_verdict IN ('FLAG_LOW', 'FLAG_VERY_LOW', 'FLAG_LOW_WARN') THEN {quote(x[2])}"
                f" WHEN b THEN {quote(x[3])} ELSE {case({k: quote(v[n]) for k, v in fixed.OUTCOME_ACTIONS.items()}, 'outcome', quote(fixed.OUTCOME_ACTIONS['HOLD_FOR_CORRECTION'][n]))} END AS {name}"
                for name, n, x in [
                    ("title", 0, (fixed.TIMELY_AND_BILLING_TITLE, fixed.TIMELY_ACTION[0], fixed.UNDERBILLED_TITLE, fixed.OVERBILLED_TITLE)),
                    ("steps", 2, (fixed.TIMELY_AND_BILLING_STEPS, fixed.TIMELY_ACTION[2], fixed.UNDERBILLED_STEPS, fixed.OVERBILLED_STEPS)),
                ]
            ) + f""" FROM (SELECT *, outcome IN ('APPROVED_WITH_WARNING', 'MANUAL_REVIEW') AND ({LATE} OR cat = 'Eligibility / Timeliness' OR {SHOWN(['claim_age_days'])}) AS t,
  outcome IN ('APPROVED_WITH_WARNING', 'MANUAL_REVIEW') AND (billing_verdict <> 'ACCEPT' OR cat = 'Billing / Financial' OR {SHOWN(fixed.BILLING_DRIVERS)}) AS b
  FROM (SELECT *, {CATEGORY_SQL} AS cat FROM explained))""",
            *TABLES,
        ),
    ),
    Entry(
        "V20_claim_report",
        lambda s: explained(s).select(*KEYS, ad.claim_report().alias("report")).select(
            *KEYS, F.get_json_object("report", "$.outcome").alias("outcome"), F.get_json_object("report", "$.denial_probability").cast("double").alias("denial_probability"),
            F.get_json_object("report", "$.top_reasons[0].feature").alias("first_feature"), F.get_json_object("report", "$.next_action").alias("next_action")),
        query(chain() + "SELECT claim_id, row_key, outcome, denial_prob AS denial_probability, f1 AS first_feature, next_action FROM explained", *TABLES),
    ),
    Entry(
        "V21_error_descriptions",
        lambda s: error_code_counts(request_log_of(s), descriptions_of(s)),
        "SELECT c.error_code, description, count(*) AS errors FROM events JOIN ("
        + values([(i, c, t) for i, (c, t) in enumerate(fixed.ERROR_CODES)], "n, error_code, description")
        + ") c ON CAST(json_extract_string(props, '$.k') AS INTEGER) % 19 = c.n WHERE event_type = 'error' GROUP BY 1, 2",
    ),
    Entry(
        "V22_claim_summary",
        lambda s: ad.summary_row(
            enrich(_summary_dims(s), s.cost.select("procedure_code", "region"), "procedure_code", "claim_id")),
        query(
            "WITH " + referenced("claims") + " SELECT claim_id, row_key, patient_id AS patient, CASE WHEN doctor_name IS NOT NULL THEN doctor_name || ' (' || coalesce(specialty, '—') || ')'"
            " ELSE coalesce(provider_id, '—') END AS provider, CASE WHEN category IS NOT NULL THEN diagnosis_code || ' — ' || category || ' (Severity: ' || severity || ')' ELSE coalesce(diagnosis_code, '—') END AS diagnosis,"
            " coalesce(procedure_code, '—') AS procedure, coalesce(region, '—') AS region, CASE WHEN billed_amount IS NULL THEN '—' ELSE '₹' || " + B + " END AS billed,"
            " CASE WHEN procedure_code IS NULL THEN '—' ELSE '₹' || " + E + " END AS expected_text, CASE WHEN procedure_code IS NULL THEN '—' WHEN billed_amount IS NULL THEN 'N/A'"
            " ELSE CAST(CAST(round_even(billed / expected * 100, 0) AS BIGINT) AS VARCHAR) || '%' END AS ratio_text, coalesce(CAST(claim_date AS VARCHAR), '—') AS date_text FROM ruled",
            *TABLES,
        ),
    ),
    Entry(
        "V23_factors",
        lambda s: ad.factors(scored_claims(s)).select(*KEYS, F.array_join("denial_factors", " | ").alias("denial_factors"), F.array_join("approval_factors", " | ").alias("approval_factors")),
        query(
            chain() + "SELECT claim_id, row_key, "
            + ", ".join(
                "concat_ws(' | ', " + ", ".join(
                    f"CASE WHEN i{i} {op} 0 THEN e{i} || ' — ' || {case({k: quote(v) for k, v in fixed.DRIVER_LABELS.items()}, f'f{i}', f'f{i}')} END" for i in (1, 2, 3)
                ) + f") AS {name}"
                for name, op in [("denial_factors", "<"), ("approval_factors", ">")]
            )
            + " FROM explained",
            *TABLES,
        ),
    ),
    Entry(
        "V24_extract_and_validate",
        lambda s: extract.extraction_response(
            extract.validate_extracted(extract.extract_fields(s.table("documents").select("doc_id", "text")), s.providers, s.diagnosis, s.cost, AS_OF, "doc_id")
        ).select("doc_id", F.size("hard_blocks").alias("blocks"), F.md5("raw_text").alias("raw_text_md5")),
        None,
    ),
    Entry(
        "D7_policy_references",
        lambda s: ad.policy_references(scored_claims(s), AS_OF).select(*KEYS, "timely_filing_reference", "billing_alignment_reference"),
        query(
            chain() + f"SELECT claim_id, row_key, coalesce({LATE} OR {NEGATIVE(['claim_age_days'])}, false) AS timely_filing_reference,"
            f" coalesce(billing_verdict <> 'ACCEPT' OR {NEGATIVE(fixed.BILLING_DRIVERS)}, false) AS billing_alignment_reference FROM explained",
            *TABLES,
        ),
    ),
    Entry(
        "M15_proxy_scores",
        lambda s: serving_features(s.claims, s.providers, s.diagnosis, s.cost, AS_OF).withColumn("scores", at.proxy_scores(IMPORTANCES, mean_expected_cost(s.cost))).select(*KEYS, "scores.*"),
        query("WITH " + referenced("claims") + " SELECT claim_id, row_key, " + ", ".join(f"{v} AS {k}" for k, v in SCORES.items()) + " FROM ruled", *TABLES),
    ),
    Entry(
        "M16_risk_level",
        lambda s: scored_claims(s).select(*KEYS, "risk_level", at.inference_risk(F.col("denial_prob")).alias("inference_risk")),
        query(
            chain() + f"SELECT claim_id, row_key, risk_level, CASE WHEN denial_prob > {d(0.6)} THEN 'HIGH' WHEN denial_prob > {d(0.35)} THEN 'MEDIUM' ELSE 'LOW' END AS inference_risk FROM explained",
            *TABLES,
        ),
    ),
    Entry(
        "M17_calibrated_probability",
        lambda s: serving_features(s.claims, s.providers, s.diagnosis, s.cost, AS_OF).select(
            *KEYS, at.calibrated_denial(p_approved()).alias("calibrated"), at.squashed_denial(at.calibrated_denial(p_approved())).alias("squashed")),
        query(chain().replace("WHEN policy_violation THEN CAST(1 AS DOUBLE) WHEN denial0", "WHEN denial0") + "SELECT claim_id, row_key, denial0 AS calibrated, denial_prob AS squashed FROM p3", *TABLES),
    ),
    Entry(
        "M18_coverage_override",
        lambda s: scored_claims(s).select(
            *KEYS, "policy_violation", "denial_prob", "predicted_status", "risk_level", F.coalesce(F.get(F.col("reasons"), 0)["feature"], F.lit("")).alias("first_driver")),
        query(chain() + "SELECT claim_id, row_key, policy_violation, denial_prob, CASE WHEN billed_amount < 0 THEN 'ERROR' ELSE predicted_status END AS predicted_status, risk_level, coalesce(f1, '') AS first_driver FROM explained", *TABLES),
    ),
]


def _summary_dims(s):
    df = enrich(refs(s), s.providers.select("provider_id", "doctor_name", "specialty"), "provider_id", "claim_id")
    return enrich(df, s.diagnosis, "diagnosis_code", "claim_id")
