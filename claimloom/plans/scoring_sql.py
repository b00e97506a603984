"""SQL statement of the scoring chain, for the check engine."""

from __future__ import annotations

from claimloom.functions import fixed_values as fixed
from claimloom.operators.attribution import DRIVER_ORDER
from claimloom.plans.sql_text import AS_OF, half_up, quote

WEIGHTS = {
    "billing_ratio": -0.9, "high_cost_flag": -1.1, "severity_score": -0.35, "provider_specialty_enc": 0.15, "diag_category_enc": 0.1,
    "is_billed_missing": -1.2, "is_proc_missing": -1.5, "is_diag_missing": -1.4, "claim_age_days": -0.0004,
}
INTERCEPT = 3.2
IMPORTANCES = {
    "billing_ratio": 0.21, "cost_diff": 0.17, "high_cost_flag": 0.06, "provider_claim_count": 0.09, "provider_specialty_enc": 0.03,
    "severity_score": 0.05, "diag_claim_count": 0.07, "diag_category_enc": 0.04, "is_billed_missing": 0.08, "is_proc_missing": 0.09,
    "is_diag_missing": 0.07, "claim_age_days": 0.04,
}
MEAN = "(SELECT CAST(sum(expected_cost) AS DOUBLE) / count(expected_cost) FROM cost)"


def d(x) -> str:
    return f"CAST({x} AS DOUBLE)"


def case(table: dict[str, str], key: str, default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {quote(k)} THEN {v}" for k, v in table.items()) + f" ELSE {default} END"


_z = d(INTERCEPT) + "".join(f" + {d(n)} * {d(w)}" for n, w in WEIGHTS.items())
_w = {f: d(v) for f, v in IMPORTANCES.items()}
_m = {f: d(-v) for f, v in IMPORTANCES.items()}
_r = "billing_ratio"
_SCORES = {
    **{f: f"{_m[f]} * {f} + {_w[f]} * ({d(1)} - {f}) * {d(0.6)}" for f in ("is_diag_missing", "is_proc_missing", "is_billed_missing")},
    "billing_ratio": (
        f"CASE WHEN {_r} > {d(1.75)} THEN {_m[_r]} * least({_r} - {d(1.75)}, {d(1)})"
        f" WHEN {_r} > {d(1.25)} THEN {_m[_r]} * ({_r} - {d(1.25)}) / {d(0.5)} * {d(0.4)}"
        f" WHEN {_r} = 1 THEN {_w[_r]} * {d(0.9)} WHEN {_r} >= {d(0.5)} THEN {d(-0.03)} - abs({_r} - {d(1)}) * {d(0.15)}"
        f" ELSE {_m[_r]} * {d(0.5)} END"
    ),
    "cost_diff": f"{_m['cost_diff']} * tanh(cost_diff / greatest({MEAN}, {d(1)}))",
    "high_cost_flag": f"{_w['high_cost_flag']} * ({d(0.5)} - high_cost_flag)",
    "provider_claim_count": f"{_w['provider_claim_count']} * tanh({d('provider_claim_count - 50')} / {d(50)})",
    "provider_specialty_enc": d(0),
    "severity_score": f"{_m['severity_score']} * {d('severity_score - 2')} / {d(2)}",
    "diag_claim_count": f"{_w['diag_claim_count']} * tanh({d('diag_claim_count - 20')} / {d(20)})",
    "diag_category_enc": d(0),
    "claim_age_days": (
        f"CASE WHEN claim_age_days <= 90 THEN {_w['claim_age_days']} * ({d(1)} - claim_age_days / {d(90)}) * {d(0.4)}"
        f" ELSE {_m['claim_age_days']} * tanh(({d('claim_age_days')} - {d(90)}) / {d(90)}) END"
    ),
}
SCORES = {f: half_up(_SCORES[f], 4) for f in DRIVER_ORDER}

_TEXT = {f"{f}{'-' if i == 0 else '+'}": quote(t[i]) for f, t in fixed.REASON_TEXTS.items() for i in (0, 1)}
_REC = [{f: quote(t[i]) for f, t in fixed.RECOMMENDATIONS.items()} for i in (0, 1)]
money = lambda x: f"format('{{:,}}', CAST(round_even({x}, 0) AS BIGINT))"


def _messages() -> str:
    t = fixed.RULE_MESSAGES

    def text(key: str, **parts: str) -> str:
        out = quote(t[key])
        for name, column in parts.items():
            out = out.replace("{" + name + "}", "' || " + column + " || '")
        return out

    checks = [
        ("diagnosis_code IS NULL", "R03", "diagnosis_code", text("diagnosis_missing")),
        ("diagnosis_code IS NOT NULL AND NOT diagnosis_known", "R06", "diagnosis_code", text("diagnosis_unknown", diagnosis_code="diagnosis_code")),
        ("procedure_code IS NULL", "R04", "procedure_code", text("procedure_missing")),
        ("procedure_code IS NOT NULL AND NOT procedure_known", "R07", "procedure_code", text("procedure_unknown", procedure_code="procedure_code")),
        ("provider_id IS NULL", "R05", "provider_id", text("provider_missing")),
        ("provider_id IS NOT NULL AND NOT provider_known", "R05", "provider_id", text("provider_unknown")),
        ("policy_id IS NULL", "R12", "policy_id", text("policy_missing")),
        ("policy_id IS NOT NULL AND NOT policy_known", "R12", "policy_id", text("policy_unknown", policy_id="policy_id")),
        ("claim_date IS NULL", "R09", "service_date", text("date_missing")),
        (f"{{future}} AND claim_date > DATE '{AS_OF}'", "R09", "service_date", text("date_future")),
        ("uncovered", "R10", "policy_id", text("not_covered", procedure_code="procedure_code", policy_id="policy_id")),
        ("before_start", "R11", "service_date", text("before_start", service_date="CAST(claim_date AS VARCHAR)", policy_start_date="CAST(policy_start_date AS VARCHAR)")),
        ("after_end", "R11", "service_date", text("after_end", service_date="CAST(claim_date AS VARCHAR)", policy_end_date="CAST(policy_end_date AS VARCHAR)")),
        ("billed = 0", "R02", "billed_amount", text("billed_missing")),
        (f"billed <> 0 AND billed > expected * {d(1.75)}", "R02b", "billed_amount", text("billed_high", billed=money("billed"), expected=money("expected"))),
    ]
    items = ", ".join(f"CASE WHEN {c} THEN {{'rule': '{r}', 'field': '{f}', 'message': {m}}} END" for c, r, f, m in checks)
    return f"list_filter([{items}], lambda v: v IS NOT NULL)"


def referenced(source: str, future: bool = False) -> str:
    """Common tables ``refs`` and ``ruled`` over a claim-shaped ``source``."""
    return f"""refs AS (SELECT x.*, p.policy_id IS NOT NULL AS policy_known, p.covered, p.policy_start_date, p.policy_end_date,
  pr.provider_id IS NOT NULL AS provider_known, dg.diagnosis_code IS NOT NULL AS diagnosis_known, co.procedure_code IS NOT NULL AS procedure_known,
  coalesce({d('x.billed_amount')}, {d(0)}) AS billed, coalesce({d('co.expected_cost')}, {MEAN}) AS expected,
  pr.doctor_name, pr.specialty, dg.category, dg.severity, co.region,
  CASE WHEN specialty = 'Cardiology' THEN 0 WHEN specialty = 'General' THEN 1 WHEN specialty = 'Neurology' THEN 2
       WHEN specialty = 'Orthopedic' THEN 3 ELSE CASE WHEN pr.provider_id IS NOT NULL AND specialty IS NOT NULL THEN 0 ELSE 1 END END AS provider_specialty_enc,
  CASE upper(severity) WHEN 'HIGH' THEN 3 WHEN 'LOW' THEN 1 ELSE 2 END AS severity_score,
  CASE category WHEN 'Bone' THEN 0 WHEN 'Cold' THEN 1 WHEN 'Diabetes' THEN 2 WHEN 'Fever' THEN 3 WHEN 'Heart' THEN 4 WHEN 'Skin' THEN 5 ELSE 0 END AS diag_category_enc,
  50 AS provider_claim_count, 20 AS diag_claim_count,
  CASE WHEN x.billed_amount IS NULL THEN 1 ELSE 0 END AS is_billed_missing, CASE WHEN x.procedure_code IS NULL THEN 1 ELSE 0 END AS is_proc_missing,
  CASE WHEN x.diagnosis_code IS NULL THEN 1 ELSE 0 END AS is_diag_missing,
  coalesce(date_diff('day', claim_date, DATE '{AS_OF}'), 0) AS claim_age_days,
  coalesce(NOT list_contains(p.covered, upper(x.procedure_code)), false) AS uncovered,
  coalesce(claim_date < policy_start_date, false) AS before_start, coalesce(claim_date > policy_end_date, false) AS after_end
FROM {source} x LEFT JOIN policies p ON x.policy_id = p.policy_id LEFT JOIN providers pr ON x.provider_id = pr.provider_id
LEFT JOIN diagnosis dg ON x.diagnosis_code = dg.diagnosis_code LEFT JOIN cost co ON x.procedure_code = co.procedure_code),
ruled AS (SELECT *, {half_up('billed / greatest(expected, 1)', 4)} AS billing_ratio, {half_up('billed - expected', 4)} AS cost_diff,
  CASE WHEN {half_up('billed / greatest(expected, 1)', 4)} > {d(1.5)} THEN 1 ELSE 0 END AS high_cost_flag,
  {_messages().replace('{future}', 'true' if future else 'false')} AS violations,
  CASE WHEN billed = 0 THEN 'AUTO_REJECT_MISSING' WHEN billed > expected * {d(1.75)} THEN 'AUTO_REJECT_HIGH' WHEN NOT expected > 0 THEN 'ACCEPT'
    WHEN billed / expected > {d(1.25)} THEN 'CONDITIONAL' WHEN billed / expected > {d(1.15)} THEN 'FLAG_HIGH_WARN'
    WHEN billed / expected < {d(0.5)} THEN 'FLAG_VERY_LOW' WHEN billed / expected < {d(0.75)} THEN 'FLAG_LOW'
    WHEN billed / expected < {d(0.85)} THEN 'FLAG_LOW_WARN' ELSE 'ACCEPT' END AS billing_verdict,
  uncovered OR before_start OR after_end AS policy_violation FROM refs)"""


def scored(table: str = "ruled") -> str:
    """Common tables up to ``explained``: prediction, ranked reasons and recommendation per row."""
    clean = (
        "is_proc_missing = 0 AND is_billed_missing = 0 AND is_diag_missing = 0 AND claim_age_days <= 90"
        f" AND billing_ratio <= {d(1.25)} AND billing_ratio >= {d(0.5)}"
    )
    drivers = ", ".join(f"{{'pos': {i}, 'f': '{f}', 'i': {SCORES[f]}}}" for i, f in enumerate(DRIVER_ORDER))
    drivers += f", {{'pos': {len(DRIVER_ORDER)}, 'f': 'policy_violation', 'i': CASE WHEN policy_violation THEN {d(-999)} END}}"
    base_text = case(_TEXT, "f || CASE WHEN i < 0 THEN '-' ELSE '+' END", "NULL")
    shown = (
        f"CASE WHEN f = 'billing_ratio' AND i < 0 AND billing_ratio < 1 THEN {quote(fixed.BILLED_LESS_TEXT)}"
        f" WHEN f = 'billing_ratio' AND i < 0 AND billing_ratio > 1 THEN {quote(fixed.BILLED_MORE_TEXT)} ELSE {base_text} END"
    )
    neg = "coalesce(CASE WHEN i1 < 0 THEN f1 END, CASE WHEN i2 < 0 THEN f2 END, CASE WHEN i3 < 0 THEN f3 END)"
    lowest = (
        "CASE WHEN least(i1, i2, i3) >= 0 THEN NULL WHEN i1 <= coalesce(i2, 0) AND i1 <= coalesce(i3, 0) THEN f1"
        " WHEN i2 <= coalesce(i3, 0) THEN f2 ELSE f3 END"
    )
    guarded = (
        f"CASE WHEN top = 'billing_ratio' AND billing_ratio <= {d(1.5)} THEN 'cost_diff'"
        " WHEN top = 'claim_age_days' AND claim_age_days <= 90 THEN 'severity_score' ELSE top END"
    )

    def rec(i: int) -> str:
        c, u, o = (quote(x[i]) for x in (fixed.CLEAN_RECOMMENDATION, fixed.UNDERBILLED_RECOMMENDATION, fixed.OVERBILLED_RECOMMENDATION))
        return (
            f"CASE WHEN predicted_status = 'APPROVED' THEN CASE WHEN first_against IS NULL THEN {c} WHEN billing_ratio < 1 THEN {u} ELSE {o} END"
            f" ELSE {case(_REC[i], guarded, quote(fixed.DEFAULT_RECOMMENDATION[i]))} END"
        )

    return f"""p1 AS (SELECT *, {d(1)} / ({d(1)} + exp(-({_z}))) AS p_approved FROM {table}),
p2 AS (SELECT *, {half_up(f'{d(1)} - CASE WHEN p_approved >= 0.5 THEN {d(0.75)} + (p_approved - {d(0.5)}) * {d(0.5)} ELSE p_approved * {d(0.5)} END', 4)} AS denial0 FROM p1),
p3 AS (SELECT *, CASE WHEN policy_violation THEN {d(1)} WHEN denial0 < 0.5 AND {clean}
  THEN {half_up(f'denial0 * least({d(0.1)} + abs(billing_ratio - {d(1)}) * {d(0.5)}, {d(1)})', 4)} ELSE denial0 END AS denial_prob FROM p2),
p4 AS (SELECT *, CASE WHEN denial_prob >= 0.5 THEN 'DENIED' ELSE 'APPROVED' END AS predicted_status,
  CASE WHEN denial_prob >= {d(0.8)} THEN 'CRITICAL' WHEN denial_prob >= {d(0.55)} THEN 'HIGH' WHEN denial_prob >= {d(0.35)} THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM p3),
dr AS (SELECT claim_id, row_key, predicted_status, billing_ratio, e.pos AS pos, e.f AS f, e.i AS i
  FROM (SELECT claim_id, row_key, predicted_status, billing_ratio, unnest([{drivers}]) AS e FROM p4) WHERE e.i IS NOT NULL AND abs(e.i) > {d(0.0001)}
  AND NOT (predicted_status = 'APPROVED' AND e.f = 'severity_score')),
rk AS (SELECT *, row_number() OVER (PARTITION BY claim_id, row_key ORDER BY CASE WHEN predicted_status = 'APPROVED' AND i >= 0 THEN 1 ELSE 0 END, -abs(i), pos) AS rank,
  {shown} AS explanation FROM dr),
rs AS (SELECT claim_id, row_key, max(f) FILTER (rank = 1) AS f1, max(f) FILTER (rank = 2) AS f2, max(f) FILTER (rank = 3) AS f3,
  max(i) FILTER (rank = 1) AS i1, max(i) FILTER (rank = 2) AS i2, max(i) FILTER (rank = 3) AS i3,
  max(explanation) FILTER (rank = 1) AS e1, max(explanation) FILTER (rank = 2) AS e2, max(explanation) FILTER (rank = 3) AS e3
  FROM rk WHERE rank <= 3 GROUP BY 1, 2),
p5 AS (SELECT p4.*, f1, f2, f3, i1, i2, i3, e1, e2, e3, {neg} AS first_against, coalesce({neg}, f1, 'is_diag_missing') AS top, {lowest} AS lowest
  FROM p4 LEFT JOIN rs ON p4.claim_id = rs.claim_id AND p4.row_key = rs.row_key),
explained AS (SELECT *, {rec(0)} AS recommendation, {rec(1)} AS next_action,
  CASE WHEN billed_amount < 0 THEN 'INVALID_INPUT' WHEN predicted_status = 'APPROVED' THEN CASE WHEN billing_verdict = 'CONDITIONAL' THEN 'MANUAL_REVIEW'
    WHEN billing_verdict IN ('FLAG_LOW', 'FLAG_VERY_LOW', 'FLAG_HIGH_WARN', 'FLAG_LOW_WARN') THEN 'APPROVED_WITH_WARNING'
    WHEN denial_prob < {d(0.2)} THEN 'APPROVED' WHEN denial_prob < {d(0.35)} THEN 'APPROVED_WITH_WARNING' ELSE 'MANUAL_REVIEW' END
  WHEN denial_prob < {d(0.65)} THEN 'MANUAL_REVIEW' WHEN denial_prob < {d(0.8)} THEN 'AT_RISK' ELSE 'HOLD_FOR_CORRECTION' END AS outcome FROM p5)"""


KEY5 = "lower(coalesce(patient_id, '') || '|' || coalesce(provider_id, '') || '|' || coalesce(procedure_code, '') || '|' || CAST(coalesce(billed_amount, 0) AS VARCHAR) || '|' || coalesce(CAST(claim_date AS VARCHAR), ''))"
KEY8 = "lower(claim_id || '|' || coalesce(diagnosis_code, '') || '|' || coalesce(policy_id, '')) || '|' || " + KEY5
DUPLICATES = f"""valid AS (SELECT *, CAST(service_date AS DATE) AS claim_date FROM batch WHERE service_date IS NOT NULL),
h AS (SELECT claim_id, {KEY8} AS k8, {KEY5} AS k5 FROM history),
d0 AS (SELECT valid.*, {KEY8} AS k8, {KEY5} AS k5 FROM valid),
d1 AS (SELECT d0.*, k8 IN (SELECT k8 FROM h) AS history_exact, claim_id IN (SELECT claim_id FROM h) AS history_id, d0.k5 IN (SELECT k5 FROM h) AS history_suspicious,
  CASE WHEN k8 IN (SELECT k8 FROM h) OR claim_id IN (SELECT claim_id FROM h) THEN claim_id ELSE hm.m END AS matched_claim_id
  FROM d0 LEFT JOIN (SELECT k5, min(claim_id) AS m FROM h GROUP BY 1) hm ON d0.k5 = hm.k5),
d2 AS (SELECT *, coalesce(row_key > min(row_key) FILTER (NOT history_exact) OVER (PARTITION BY k8), false) AS batch_exact,
  coalesce(row_key > min(row_key) FILTER (NOT history_exact) OVER (PARTITION BY claim_id), false) AS batch_id,
  coalesce(row_key > min(row_key) FILTER (NOT history_exact) OVER (PARTITION BY k5), false) AS batch_suspicious FROM d1),
dup AS (SELECT *, CASE WHEN batch_exact AND NOT history_exact THEN 'Within-Batch Exact Duplicate' WHEN history_exact THEN 'Exact Match (History)'
  WHEN history_id THEN 'Existing ID Modified' WHEN history_suspicious THEN 'Historical Suspicious Duplicate' WHEN batch_id THEN 'Within-Batch ID Conflict'
  WHEN batch_suspicious THEN 'Within-Batch Suspicious Duplicate' ELSE '—' END AS duplicate_type, history_exact OR batch_exact AS is_blocked,
  NOT (history_exact OR batch_exact) AND history_id AS is_revised,
  NOT (history_exact OR batch_exact) AND (batch_id OR batch_suspicious OR (NOT history_id AND history_suspicious)) AS force_review FROM d2)"""
