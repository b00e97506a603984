"""Format checks, the rule engine and the billing verdict."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import fixed_values as fixed
from claimloom.functions.numeric import thousands
from claimloom.functions.skew import enrich
from claimloom.functions.texts import filled, present
from claimloom.operators.features import mean_expected_cost

CLAIM_FORMAT, PATIENT_FORMAT = r"^C\d{4,}$", r"^P\d{3,}$"
STRICT_CLAIM_FORMAT, STRICT_PATIENT_FORMAT = r"^C\d{4}$", r"^P\d{3}$"


def row_errors(strict: bool = False) -> Column:
    """Joined format errors of the two ids; ``Valid`` when there are none."""
    claim, patient = present(F.col("claim_id")), present(F.col("patient_id"))
    claim_ok = claim.rlike(STRICT_CLAIM_FORMAT if strict else CLAIM_FORMAT)
    patient_ok = patient.rlike(STRICT_PATIENT_FORMAT if strict else PATIENT_FORMAT)
    errors = F.concat_ws(
        "; ",
        F.when(claim.isNull(), F.lit("claim_id missing")).when(~claim_ok, filled("claim_id '{x}' invalid (need CXXXX)", x=claim)),
        F.when(patient.isNull(), F.lit("patient_id missing")).when(
            ~patient_ok, filled("patient_id '{x}' invalid (need PXXX)", x=patient)
        ),
    )
    return F.when(errors == "", F.lit("Valid")).otherwise(errors)


def with_references(
    claims: DataFrame, providers: DataFrame, diagnosis: DataFrame, cost: DataFrame, policies: DataFrame
) -> DataFrame:
    """Claims with what the rules need of each dimension; unknown keys leave NULLs.

    ``expected`` falls back to the mean benchmark when the procedure has none.
    """
    codes = F.transform(F.split("procedures_covered", ","), lambda p: F.upper(F.trim(p)))
    df = enrich(claims, providers.select("provider_id", F.lit(True).alias("provider_known")), "provider_id", "claim_id")
    df = enrich(df, diagnosis.select("diagnosis_code", F.lit(True).alias("diagnosis_known")), "diagnosis_code", "claim_id")
    df = enrich(
        df, cost.select("procedure_code", F.lit(True).alias("procedure_known"), F.col("expected_cost").cast("double").alias("__e")),
        "procedure_code", "claim_id",
    )
    df = enrich(
        df,
        policies.select("policy_id", F.filter(codes, lambda p: p != "").alias("covered"), "policy_start_date", "policy_end_date"),
        "policy_id", "claim_id",
    )
    return df.withColumn("expected", F.coalesce(F.col("__e"), mean_expected_cost(cost))).drop("__e")


def uncovered() -> Column:
    """A known policy that does not list the procedure."""
    return present(F.col("procedure_code")).isNotNull() & ~F.array_contains("covered", F.upper("procedure_code"))


def before_start() -> Column:
    return F.col("claim_date") < F.col("policy_start_date")


def after_end() -> Column:
    return F.col("claim_date") > F.col("policy_end_date")


def coverage_violation() -> Column:
    """The override of the model: claims breaking a known policy's terms."""
    return F.coalesce(uncovered(), F.lit(False)) | F.coalesce(before_start(), F.lit(False)) | F.coalesce(after_end(), F.lit(False))


def _missing_amount() -> Column:
    return F.coalesce(F.col("billed_amount").cast("double"), F.lit(0.0)) == 0


def _too_high() -> Column:
    return ~_missing_amount() & (F.col("billed_amount").cast("double") > F.col("expected") * 1.75)


def billing_verdict() -> Column:
    share = F.try_divide(F.col("billed_amount").cast("double"), F.col("expected"))
    return (
        F.when(_missing_amount(), "AUTO_REJECT_MISSING").when(_too_high(), "AUTO_REJECT_HIGH")
        .when(~(F.col("expected") > 0), "ACCEPT").when(share > 1.25, "CONDITIONAL").when(share > 1.15, "FLAG_HIGH_WARN")
        .when(share < 0.50, "FLAG_VERY_LOW").when(share < 0.75, "FLAG_LOW").when(share < 0.85, "FLAG_LOW_WARN").otherwise("ACCEPT")
    )


def violations(as_of: datetime.date | None = None) -> Column:
    """All rule violations of a claim with references, in rule order, as structs.

    With ``as_of`` a later service date violates too, as in the single-claim form.
    """
    text = fixed.RULE_MESSAGES
    gone = lambda c: present(F.col(c)).isNull()
    date = F.col("claim_date")

    def hit(condition: Column, rule: str, field: str, message: str, **parts: Column) -> Column:
        entry = F.struct(
            F.lit(rule).alias("rule_id"), F.lit(field).alias("field"), filled(text[message], **parts).alias("message")
        )
        return F.when(condition, entry)

    diagnosis, procedure, policy = F.col("diagnosis_code"), F.col("procedure_code"), F.col("policy_id")
    checks = [
        hit(gone("claim_id"), "R01", "claim_id", "claim_missing"),
        hit(gone("patient_id"), "R08", "patient_id", "patient_missing"),
        hit(gone("diagnosis_code"), "R03", "diagnosis_code", "diagnosis_missing"),
        hit(~gone("diagnosis_code") & F.col("diagnosis_known").isNull(), "R06", "diagnosis_code", "diagnosis_unknown", diagnosis_code=diagnosis),
        hit(gone("procedure_code"), "R04", "procedure_code", "procedure_missing"),
        hit(~gone("procedure_code") & F.col("procedure_known").isNull(), "R07", "procedure_code", "procedure_unknown", procedure_code=procedure),
        hit(gone("provider_id"), "R05", "provider_id", "provider_missing"),
        hit(~gone("provider_id") & F.col("provider_known").isNull(), "R05", "provider_id", "provider_unknown"),
        hit(gone("policy_id"), "R12", "policy_id", "policy_missing"),
        hit(~gone("policy_id") & F.col("covered").isNull(), "R12", "policy_id", "policy_unknown", policy_id=policy),
        hit(date.isNull(), "R09", "service_date", "date_missing"),
        *([hit(date > F.lit(as_of), "R09", "service_date", "date_future")] if as_of else []),
        hit(uncovered(), "R10", "policy_id", "not_covered", procedure_code=procedure, policy_id=policy),
        hit(before_start(), "R11", "service_date", "before_start", service_date=date, policy_start_date=F.col("policy_start_date")),
        hit(after_end(), "R11", "service_date", "after_end", service_date=date, policy_end_date=F.col("policy_end_date")),
        hit(_missing_amount(), "R02", "billed_amount", "billed_missing"),
        hit(_too_high(), "R02b", "billed_amount", "billed_high", billed=thousands(F.col("billed_amount")), expected=thousands(F.col("expected"))),
    ]
    return F.array_compact(F.array(*checks))


def apply_rules(referenced: DataFrame, as_of: datetime.date | None = None) -> DataFrame:
    return referenced.withColumns({"violations": violations(as_of), "billing_verdict": billing_verdict()})
