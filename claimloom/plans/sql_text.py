"""Standard-SQL statements of the same results, run by another engine as a check."""

from __future__ import annotations

from claimloom.functions import fixed_values as fixed

AS_OF = "2001-10-01"


def half_up(x: str, places: int) -> str:
    s = f"CAST({10**places} AS DOUBLE)"
    h = "CAST(0.5 AS DOUBLE)"
    return (
        f"(CASE WHEN ({x}) >= 0 THEN CAST(floor(({x}) * {s} + {h}) AS BIGINT)"
        f" ELSE -CAST(floor(-({x}) * {s} + {h}) AS BIGINT) END / {s})"
    )


def avg2(x: str, places: int = 2) -> str:
    return half_up(f"CAST(sum({x}) AS DOUBLE) / NULLIF(count({x}), 0)", places)


def pct(part: str, whole: str, places: int) -> str:
    return half_up(f"({part}) * CAST(100 AS DOUBLE) / NULLIF({whole}, 0)", places)


def ratio(a: str, b: str, places: int) -> str:
    return half_up(f"CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0)", places)


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def initcap(x: str) -> str:
    return (
        f"array_to_string(list_transform(string_split(lower({x}), ' '),"
        " lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')"
    )


def values(rows: list[tuple], columns: str) -> str:
    body = ", ".join("(" + ", ".join(quote(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({columns})"


_BILLED = (
    "CASE WHEN (l_orderkey + l_suppkey * 5) % 3 = 0 THEN NULL"
    " WHEN (l_orderkey + l_partkey) % 97 = 0 THEN -CAST(l_extendedprice AS DECIMAL(18,2))"
    " ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END"
)
_PROC = "CASE WHEN (l_orderkey + l_partkey * 3) % 4 <> 0 THEN 'PROC' || CAST(l_partkey % 60 AS VARCHAR) END"

CTES: dict[str, tuple[list[str], str]] = {
    "claims": (
        [],
        f"""SELECT 'C' || lpad(CAST(l_orderkey * 10 + l_linenumber AS VARCHAR), 8, '0') AS claim_id,
  'P' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS patient_id,
  CASE WHEN (l_orderkey * 3 + l_linenumber) % 29 <> 0
       THEN 'PR' || lpad(CAST(l_suppkey AS VARCHAR), 5, '0') END AS provider_id,
  CASE WHEN (l_orderkey * 7 + l_linenumber * 3 + l_suppkey) % 10 >= 3
       THEN 'D' || CAST((o_custkey % 7 + 1) * 10 AS VARCHAR) END AS diagnosis_code,
  {_PROC} AS procedure_code,
  CAST({_BILLED} AS DECIMAL(18,2)) AS billed_amount,
  CASE WHEN l_orderkey % 53 <> 0 THEN CAST(l_shipdate AS DATE) END AS claim_date,
  'POL' || lpad(CAST(o_custkey % 8 + 1 AS VARCHAR), 3, '0') AS policy_id,
  lpad(CAST(l_partkey AS VARCHAR), 12, '0') || '|' || lpad(CAST(l_suppkey AS VARCHAR), 10, '0') || '|' ||
  lpad(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR), 16, '0') || '|' ||
  CAST(CAST(l_shipdate AS DATE) AS VARCHAR) || '|' ||
  lpad(CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR), 8, '0') || '|' ||
  lpad(CAST(CAST(l_discount AS DECIMAL(18,2)) AS VARCHAR), 5, '0') || '|' ||
  lpad(CAST(CAST(l_tax AS DECIMAL(18,2)) AS VARCHAR), 5, '0') || '|' ||
  l_returnflag || '|' || l_linestatus AS row_key,
  o_orderstatus AS order_status, l_returnflag AS return_flag, CAST(l_tax AS DECIMAL(18,2)) AS tax,
  o_orderdate + to_seconds((l_orderkey * 7 + l_linenumber) % 86400) AS submitted_at,
  'agent' || CAST(o_custkey % 7 AS VARCHAR) || '@example.com' AS submitted_by
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    ),
    "providers": (
        [],
        """SELECT 'PR' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS provider_id, s_name AS doctor_name,
  CASE s_suppkey % 5 WHEN 0 THEN 'Cardiology' WHEN 1 THEN 'General' WHEN 2 THEN 'Neurology'
       WHEN 3 THEN 'Orthopedic' END AS specialty,
  CASE WHEN s_suppkey % 6 <> 0 THEN n_name END AS location
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""",
    ),
    "diagnosis": ([], values(fixed.DIAGNOSIS_ROWS, "diagnosis_code, category, severity")),
    "cost": (
        [],
        f"""SELECT procedure_code, average_cost,
  CASE WHEN n % 11 <> 0 THEN average_cost END AS expected_cost, r_name AS region
FROM (SELECT {_PROC} AS procedure_code, l_partkey % 60 AS n,
        CAST((2 * CAST(sum({_BILLED}) * 100 AS HUGEINT) + count(*)) // (2 * count(*)) AS DECIMAL(18,0)) * 0.01 AS raw,
        CAST(CAST((2 * CAST(sum({_BILLED}) * 100 AS HUGEINT) + count(*)) // (2 * count(*)) AS DECIMAL(16,0))
             * CAST(0.01 AS DECIMAL(2,2)) AS DECIMAL(18,2)) AS average_cost
      FROM lineitem
      WHERE (l_orderkey + l_partkey * 3) % 4 <> 0 AND l_partkey % 60 < 58 AND ({_BILLED}) >= 0
      GROUP BY 1, 2)
LEFT JOIN region ON n % 5 = r_regionkey""",
    ),
    "policies": (
        [],
        """SELECT 'POL' || lpad(CAST(n + 1 AS VARCHAR), 3, '0') AS policy_id, 'Plan ' || CAST(n + 1 AS VARCHAR) AS policy_name,
  list_transform(list_filter(range(60), lambda p: p % 6 <> n), lambda p: 'PROC' || CAST(p AS VARCHAR)) AS covered,
  CAST(DATE '1995-06-01' + CAST(n * 90 AS INTEGER) AS DATE) AS policy_start_date,
  CASE WHEN n % 2 = 1 THEN DATE '2001-01-31' END AS policy_end_date
FROM (SELECT unnest(range(6)) AS n)""",
    ),
    "history": (
        ["claims"],
        """SELECT claim_id, patient_id, provider_id, diagnosis_code, procedure_code, billed_amount, claim_date,
  policy_id, row_key, submitted_at, submitted_by FROM claims WHERE order_status = 'F'""",
    ),
    "batch": (
        ["claims"],
        """SELECT CASE WHEN return_flag = 'A' AND tax = 0 THEN 'C9' || substr(claim_id, 2) ELSE claim_id END AS claim_id,
  patient_id, provider_id, diagnosis_code, procedure_code,
  CASE WHEN return_flag = 'R' THEN CAST(billed_amount + 1 AS DECIMAL(18,2)) ELSE billed_amount END AS billed_amount,
  CAST(claim_date AS VARCHAR) AS service_date, policy_id, claim_id || '|' || row_key AS row_key
FROM claims""",
    ),
    "silver_providers": (
        ["providers"],
        f"""SELECT upper(trim(provider_id)) AS provider_id, {initcap('trim(doctor_name)')} AS doctor_name,
  coalesce({initcap('trim(specialty)')}, 'Unknown') AS specialty,
  coalesce({initcap('trim(location)')}, 'Unknown') AS location FROM providers""",
    ),
    "silver_diagnosis": (
        ["diagnosis"],
        f"""SELECT upper(trim(diagnosis_code)) AS diagnosis_code, {initcap('trim(category)')} AS category,
  CASE WHEN upper(trim(severity)) IN ('MILD','LOW') THEN 'Mild'
       WHEN upper(trim(severity)) IN ('MODERATE','MEDIUM') THEN 'Moderate'
       WHEN upper(trim(severity)) IN ('SEVERE','HIGH','CRITICAL') THEN 'Severe' ELSE 'Unknown' END AS severity
FROM diagnosis""",
    ),
    "silver_cost": (
        ["cost"],
        f"""SELECT upper(trim(c.procedure_code)) AS procedure_code,
  coalesce(c.average_cost, m.avg_m, (SELECT quantile_disc(average_cost, 0.5) FROM cost)) AS average_cost,
  coalesce(c.expected_cost, m.exp_m, (SELECT quantile_disc(expected_cost, 0.5) FROM cost)) AS expected_cost,
  coalesce({initcap('trim(c.region)')}, 'Unknown') AS region
FROM cost c LEFT JOIN (SELECT region, quantile_disc(expected_cost, 0.5) AS exp_m,
                              quantile_disc(average_cost, 0.5) AS avg_m FROM cost GROUP BY region) m
  ON c.region IS NOT DISTINCT FROM m.region""",
    ),
    "standard_claims": (
        ["claims"],
        """SELECT upper(trim(claim_id)) AS claim_id, upper(trim(patient_id)) AS patient_id,
  upper(trim(provider_id)) AS provider_id, upper(trim(diagnosis_code)) AS diagnosis_code,
  upper(trim(procedure_code)) AS procedure_code,
  CASE WHEN billed_amount >= 0 THEN billed_amount END AS billed_amount, claim_date, policy_id
FROM claims QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY row_key) = 1""",
    ),
    "silver_claims": (
        ["standard_claims", "silver_providers"],
        """SELECT s.claim_id, s.patient_id, coalesce(s.provider_id, 'UNKNOWN') AS provider_id,
  coalesce(s.diagnosis_code, 'UNKNOWN') AS diagnosis_code, coalesce(s.procedure_code, 'UNKNOWN') AS procedure_code,
  coalesce(s.billed_amount, m.m, (SELECT quantile_disc(billed_amount, 0.5) FROM standard_claims)) AS billed_amount,
  s.claim_date, s.policy_id,
  s.billed_amount IS NULL AS is_billed_missing, s.procedure_code IS NULL AS is_proc_missing,
  s.diagnosis_code IS NULL AS is_diag_missing, s.provider_id IS NULL AS is_provider_missing,
  s.claim_date IS NULL AS is_date_missing,
  s.billed_amount IS NULL AND s.procedure_code IS NULL AS is_both_missing,
  s.procedure_code IS NULL AND s.provider_id IS NULL AS is_total_blackout,
  p.location AS provider_location,
  CASE WHEN s.procedure_code IS NULL THEN coalesce(p.location, 'Unknown') END AS recovered_region,
  CASE WHEN s.billed_amount IS NULL AND s.procedure_code IS NULL THEN 5
       WHEN s.procedure_code IS NULL THEN 3 WHEN s.billed_amount IS NULL THEN 2 ELSE 0 END
  + CASE WHEN s.procedure_code IS NULL AND s.provider_id IS NULL THEN 1 ELSE 0 END
  + CASE WHEN s.diagnosis_code IS NULL THEN 2 ELSE 0 END + CASE WHEN s.provider_id IS NULL THEN 2 ELSE 0 END
  + CASE WHEN s.claim_date IS NULL THEN 1 ELSE 0 END AS pre_risk_score
FROM standard_claims s
LEFT JOIN (SELECT procedure_code, quantile_disc(billed_amount, 0.5) AS m FROM standard_claims GROUP BY 1) m
  ON s.procedure_code IS NOT DISTINCT FROM m.procedure_code
LEFT JOIN silver_providers p ON s.provider_id = p.provider_id""",
    ),
    "scored": (
        ["silver_claims", "silver_cost"],
        f"""SELECT *, CASE WHEN base_denied <> flipped THEN 0 ELSE 1 END AS denial_flag FROM (
SELECT *, final_risk_score >= 5 AS base_denied, sha256(claim_id || ':42') < '051eb851' AS flipped,
  CASE WHEN final_risk_score = 0 THEN 'None' WHEN final_risk_score <= 2 THEN 'Low'
       WHEN final_risk_score <= 4 THEN 'Medium' WHEN final_risk_score <= 6 THEN 'High' ELSE 'Critical' END AS risk_tier
FROM (SELECT *, pre_risk_score + billing_points AS final_risk_score FROM (
SELECT *, CASE WHEN billing_ratio > 2 THEN 4 WHEN billing_ratio > CAST(1.5 AS DOUBLE) THEN 2 ELSE 0 END AS billing_points
FROM (SELECT s.*, c.expected_cost, CASE WHEN c.expected_cost > 0 THEN {ratio('s.billed_amount', 'c.expected_cost', 4)} END AS billing_ratio
      FROM silver_claims s LEFT JOIN silver_cost c ON s.procedure_code = c.procedure_code))))""",
    ),
    "base": (
        ["scored", "silver_providers", "silver_diagnosis", "silver_cost"],
        """SELECT g.claim_id, g.patient_id, g.provider_id, g.diagnosis_code, g.procedure_code, g.billed_amount,
  g.is_billed_missing, g.claim_date, g.denial_flag, p.specialty AS provider_specialty, d.category AS diag_category,
  d.severity AS diag_severity, co.average_cost, co.expected_cost, co.region AS proc_region
FROM scored g LEFT JOIN silver_providers p ON g.provider_id = p.provider_id
LEFT JOIN silver_diagnosis d ON g.diagnosis_code = d.diagnosis_code
LEFT JOIN silver_cost co ON g.procedure_code = co.procedure_code""",
    ),
    "all_features": (
        ["base"],
        f"""SELECT b.claim_id,
  CASE WHEN expected_cost > 0 THEN {ratio('billed_amount', 'expected_cost', 4)} ELSE CAST(1 AS DOUBLE) END AS billing_ratio,
  CASE WHEN expected_cost > 0 THEN CAST(billed_amount - expected_cost AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS cost_diff,
  CASE WHEN expected_cost > 0 AND {ratio('billed_amount', 'expected_cost', 4)} > CAST(1.5 AS DOUBLE) THEN 1 ELSE 0 END AS high_cost_flag,
  pv.n AS provider_claim_count, {half_up('CAST(pv.denied AS DOUBLE) / pv.n', 4)} AS provider_denial_rate,
  {half_up('CAST(pv.billed AS DOUBLE) / pv.n', 4)} AS provider_avg_billed,
  coalesce(sp.code, 0) AS provider_specialty_enc,
  CASE WHEN upper(diag_severity) = 'MILD' THEN 1 WHEN upper(diag_severity) = 'SEVERE' THEN 3 ELSE 2 END AS severity_score,
  dg.n AS diag_claim_count, coalesce(ca.code, 0) AS diag_category_enc, coalesce(rg.code, -1) AS proc_region_enc,
  CAST(is_billed_missing AS INTEGER) AS is_billed_missing,
  CASE WHEN b.procedure_code = 'UNKNOWN' THEN 1 ELSE 0 END AS is_proc_missing,
  CASE WHEN b.diagnosis_code = 'UNKNOWN' THEN 1 ELSE 0 END AS is_diag_missing,
  coalesce(date_diff('day', claim_date, (SELECT max(claim_date) FROM base)), 0) AS claim_age_days,
  coalesce(month(claim_date), 0) AS claim_month, denial_flag
FROM base b
LEFT JOIN (SELECT provider_id, count(*) AS n, sum(CASE WHEN denial_flag = 0 THEN 1 ELSE 0 END) AS denied,
                  sum(billed_amount) AS billed FROM base GROUP BY 1) pv ON b.provider_id = pv.provider_id
LEFT JOIN (SELECT diagnosis_code, count(*) AS n FROM base GROUP BY 1) dg ON b.diagnosis_code = dg.diagnosis_code
LEFT JOIN (SELECT specialty, row_number() OVER (ORDER BY specialty) - 1 AS code
           FROM (SELECT DISTINCT specialty FROM silver_providers)) sp ON b.provider_specialty = sp.specialty
LEFT JOIN (SELECT category, row_number() OVER (ORDER BY category) - 1 AS code
           FROM (SELECT DISTINCT category FROM silver_diagnosis)) ca ON b.diag_category = ca.category
LEFT JOIN (SELECT region, row_number() OVER (ORDER BY region) - 1 AS code
           FROM (SELECT DISTINCT region FROM silver_cost)) rg ON b.proc_region = rg.region""",
    ),
}


def query(body: str, *ctes: str) -> str:
    """``body`` with the named common tables, and what they need, in front."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in CTES[name][0]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in ctes:
        add(name)
    if not ordered:
        return body
    listed = ",\n".join(f"{name} AS (\n{CTES[name][1]}\n)" for name in ordered)
    if body.lstrip().upper().startswith("WITH "):
        return f"WITH {listed},\n{body.lstrip()[5:]}"
    return f"WITH {listed}\n{body}"
