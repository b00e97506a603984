"""Outcomes, explanations and fixes of scored claims."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import fixed_values as fixed
from claimloom.functions.numeric import thousands
from claimloom.functions.texts import chosen, filled, looked_up
from claimloom.operators import attribution as at


def granular_outcome() -> Column:
    """Operational level from model status, probability and billing verdict."""
    p, verdict = F.col("denial_prob"), F.col("billing_verdict")
    approved = (
        F.when(verdict == "CONDITIONAL", "MANUAL_REVIEW")
        .when(verdict.isin("FLAG_LOW", "FLAG_VERY_LOW", "FLAG_HIGH_WARN", "FLAG_LOW_WARN"), "APPROVED_WITH_WARNING")
        .when(p < 0.20, "APPROVED").when(p < 0.35, "APPROVED_WITH_WARNING").otherwise("MANUAL_REVIEW")
    )
    denied = F.when(p < 0.65, "MANUAL_REVIEW").when(p < 0.80, "AT_RISK").otherwise("HOLD_FOR_CORRECTION")
    status = F.col("predicted_status")
    return F.when(status == "ERROR", "INVALID_INPUT").when(status == "APPROVED", approved).otherwise(denied)


def batch_status() -> Column:
    """One status per row: invalid, blocked, rejected by rule, revised, review, then the outcome."""
    return (
        F.when(F.col("input_error").isNotNull(), "INVALID_INPUT")
        .when(F.col("is_blocked"), "DUPLICATE_BLOCKED")
        .when(F.size("violations") > 0, "REJECTED")
        .when(F.col("outcome") == "INVALID_INPUT", "INVALID_INPUT")
        .when(F.col("is_revised"), "REVISED_RESUBMISSION")
        .when(F.col("force_review"), "MANUAL_REVIEW")
        .when(F.col("outcome") == "HOLD_FOR_CORRECTION", "REJECTED")
        .otherwise(F.col("outcome"))
    )


def with_batch_texts(df: DataFrame) -> DataFrame:
    """Next action, policy match and primary reason of each batch row."""
    dup_reason = looked_up({k: v[0] for k, v in fixed.DUPLICATE_TEXTS.items()}, F.col("duplicate_type"))
    dup_reason = F.replace(dup_reason, F.lit("{matched}"), F.coalesce("matched_claim_id", F.lit("")))
    dup_action = looked_up({k: v[1] for k, v in fixed.DUPLICATE_TEXTS.items()}, F.col("duplicate_type"))
    status = F.col("status")
    unscored = F.col("error_code").isNotNull()
    invalid, blocked = status == "INVALID_INPUT", status == "DUPLICATE_BLOCKED"
    by_rule = (status == "REJECTED") & (F.size("violations") > 0)
    action = (
        F.when(unscored, fixed.SCORING_FAILED[1])
        .when(invalid & F.col("bad_date"), "Ensure the service date is a valid date (e.g. YYYY-MM-DD or DD/MM/YYYY).")
        .when(invalid, "Correct formatting errors and re-upload.")
        .when(blocked, dup_action)
        .when(by_rule, "Correct rule violations and resubmit.")
        .when(F.col("is_revised") | F.col("force_review"), dup_action)
        .otherwise(looked_up(fixed.BATCH_ACTIONS, status))
    )
    match = (
        F.when(invalid | blocked | by_rule, "N/A")
        .when(status.contains("APPROVED") | status.contains("RESUBMISSION"), "RAG Match: Approved Policy Criteria")
        .otherwise("RAG Match: Policy Exception Detected")
    )
    messages = F.array_join(F.transform("violations", lambda v: v["message"]), "; ")
    reason = (
        F.when(unscored, fixed.SCORING_FAILED[0]).when(invalid, F.col("input_error")).when(blocked, dup_reason).when(by_rule, messages)
        .otherwise(F.coalesce(dup_reason, F.get(F.col("reasons"), 0)["explanation"], F.lit("")))
    )
    return df.withColumns({"next_action": action, "policy_match": match, "primary_reason": reason})


def denial_category() -> Column:
    """Category from the violations of a rule denial, else from the strongest denial driver."""
    v = F.col("violations")
    field_in = lambda *names: F.exists(v, lambda e: e["field"].isin(*names))
    by_rule = (
        F.when(F.exists(v, lambda e: F.contains(F.lower(e["message"]), F.lit("missing"))), "Documentation / Completeness")
        .when(field_in("provider_id", "patient_id", "policy_id"), "Eligibility / Administrative")
        .when(field_in("diagnosis_code", "procedure_code"), "Coding")
        .otherwise("Administrative")
    )
    strongest = at.strongest_denial()
    by_driver = F.when(strongest.isNull(), fixed.CLEAN_CATEGORY).otherwise(at.driver_category(strongest))
    return F.when(F.size(v) > 0, by_rule).otherwise(by_driver)


def timely_issue(as_of: datetime.date) -> Column:
    late = F.coalesce(F.datediff(F.lit(as_of), F.col("claim_date")) > 90, F.lit(False))
    return late | F.exists(at.denial_drivers(), lambda r: r["feature"] == "claim_age_days")


def billing_issue() -> Column:
    negative = F.exists(at.denial_drivers(), lambda r: r["feature"].isin(*fixed.BILLING_DRIVERS))
    return (F.col("billing_verdict") != "ACCEPT") | negative


def policy_references(df: DataFrame, as_of: datetime.date) -> DataFrame:
    """Which standing policy clauses a claim has to be shown."""
    return df.withColumns({"timely_filing_reference": timely_issue(as_of), "billing_alignment_reference": billing_issue()})


def outcome_action(as_of: datetime.date) -> Column:
    """Struct of title, description and steps, with timeliness and billing overrides."""
    outcome, verdict = F.col("outcome"), F.col("billing_verdict")
    softer = outcome.isin("APPROVED_WITH_WARNING", "MANUAL_REVIEW")
    category = F.col("denial_category")
    shows = lambda *names: F.exists(F.col("reasons"), lambda r: r["feature"].isin(*names))
    late = F.coalesce(F.datediff(F.lit(as_of), F.col("claim_date")) > 90, F.lit(False))
    timely = softer & (late | (category == "Eligibility / Timeliness") | shows("claim_age_days"))
    billing = softer & ((verdict != "ACCEPT") | (category == "Billing / Financial") | shows(*fixed.BILLING_DRIVERS))
    low = verdict.isin(*fixed.LOW_VERDICTS)
    high_variance = (outcome == "MANUAL_REVIEW") & (verdict == "CONDITIONAL")
    money = {"billed": thousands(F.col("billed_amount")), "expected": thousands(F.col("expected"))}
    both_text = (
        "Service date is more than 90 days in the past, and billing amount (₹{billed}) deviates from the expected cost (₹{expected})."
    )
    low_text = (
        "Billed amount (₹{billed}) is less than expected cost (₹{expected}). Recheck billing details for under-coding or missing line items."
    )
    high_text = "Billed amount (₹{billed}) exceeds the expected cost (₹{expected}). Recheck billing details to avoid an overbilling audit."
    variance = (
        "Route to Supervisor: High Billing Variance",
        "Billed amount (₹{billed}) is 1.25x-1.75x the expected benchmark cost (₹{expected}), representing high risk of overbilling.",
        "1. Route to supervisor or peer reviewer for manual review.<br>2. Request supporting medical necessity documents if needed to justify"
        " high-level billing.",
    )

    def part(i):
        both = (F.lit(fixed.TIMELY_AND_BILLING_TITLE), filled(both_text, **money), F.lit(fixed.TIMELY_AND_BILLING_STEPS))[i]
        under = (F.lit(fixed.UNDERBILLED_TITLE), filled(low_text, **money), F.lit(fixed.UNDERBILLED_STEPS))[i]
        over = (F.lit(fixed.OVERBILLED_TITLE), filled(high_text, **money), F.lit(fixed.OVERBILLED_STEPS))[i]
        plain = F.coalesce(
            looked_up({k: v[i] for k, v in fixed.OUTCOME_ACTIONS.items()}, outcome), F.lit(fixed.OUTCOME_ACTIONS["HOLD_FOR_CORRECTION"][i])
        )
        return (
            F.when(timely & billing, both).when(timely, F.lit(fixed.TIMELY_ACTION[i])).when(billing & low, under).when(billing, over)
            .when(high_variance, filled(variance[i], **money)).otherwise(plain)
        )

    return F.struct(part(0).alias("title"), part(1).alias("description"), part(2).alias("steps"))


def fix_list() -> Column:
    """What to do about each denial driver: label, impact tag and action."""
    parts = {
        "billed": thousands(F.coalesce(F.col("billed_amount").cast("double"), F.lit(0.0))),
        "expected": thousands(F.col("expected")),
        "diagnosis": F.coalesce("diagnosis_code", F.lit("MISSING")),
        "procedure": F.coalesce("procedure_code", F.lit("MISSING")),
        "provider_id": F.coalesce("provider_id", F.lit("")),
        "diagnosis_code": F.coalesce("diagnosis_code", F.lit("")),
        "procedure_code": F.coalesce("procedure_code", F.lit("")),
    }
    hold = F.col("outcome") == "HOLD_FOR_CORRECTION"

    def fix(r):
        tag = F.when(hold, "CRITICAL").when(F.abs(r["impact_score"]) > 0.1, "HIGH").otherwise("MEDIUM")
        action = chosen({k: filled(t, **parts) for k, t in fixed.FIX_ACTIONS.items()}, r["feature"], F.col("recommended")["next_action"])
        return F.struct(at.driver_label(r["feature"]).alias("label"), tag.alias("impact"), action.alias("action"))

    return F.transform(F.slice(at.denial_drivers(), 1, 4), fix)


def completeness() -> Column:
    """Valid fields out of seven after a rule denial."""
    return F.greatest(F.lit(7) - F.size("violations"), F.lit(0))


def factors(df: DataFrame, top: int = 5) -> DataFrame:
    """Reasons split into denial and approval factors, each as display lines."""
    line = lambda r: F.concat(r["explanation"], F.lit(" — "), at.driver_label(r["feature"]))
    return df.withColumns(
        {
            "denial_factors": F.transform(F.slice(at.denial_drivers(), 1, top), line),
            "approval_factors": F.transform(F.slice(at.approval_factors(), 1, top), line),
        }
    )


def claim_report() -> Column:
    """The downloadable report of one claim as a JSON text."""
    top = F.transform(
        F.col("reasons"), lambda r: F.struct(r["feature"].alias("feature"), r["explanation"].alias("explanation"), r["impact_score"].alias("impact"))
    )
    return F.to_json(
        F.struct(
            F.trim("claim_id").alias("claim_id"), "outcome", F.col("denial_prob").alias("denial_probability"),
            F.round(F.lit(1.0) - F.col("denial_prob"), 4).alias("approval_probability"), "risk_level", "billing_verdict",
            F.col("billed_amount").cast("double").alias("billed_amount"), F.col("expected").alias("expected_cost"), top.alias("top_reasons"),
            F.col("recommended")["recommendation"].alias("recommendation"), F.col("recommended")["next_action"].alias("next_action"),
        )
    )


def summary_row(df: DataFrame) -> DataFrame:
    """Display texts of a claim joined to its dimensions; an em dash where nothing is known."""
    dash = F.lit("—")
    priced = F.col("procedure_code").isNotNull()
    billed = F.col("billed_amount").cast("double")
    share = F.when(priced & (F.col("expected") > 0) & billed.isNotNull(), F.concat(F.format_number(billed / F.col("expected") * 100, 0), F.lit("%")))
    return df.select(
        "claim_id", "row_key", F.coalesce("patient_id", dash).alias("patient"),
        F.when(F.col("doctor_name").isNotNull(), F.concat("doctor_name", F.lit(" ("), F.coalesce("specialty", dash), F.lit(")")))
        .otherwise(F.coalesce("provider_id", dash)).alias("provider"),
        F.when(F.col("category").isNotNull(), F.concat("diagnosis_code", F.lit(" — "), "category", F.lit(" (Severity: "), "severity", F.lit(")")))
        .otherwise(F.coalesce("diagnosis_code", dash)).alias("diagnosis"),
        F.coalesce("procedure_code", dash).alias("procedure"), F.coalesce("region", dash).alias("region"),
        F.coalesce(F.concat(F.lit("₹"), thousands(billed)), dash).alias("billed"),
        F.when(priced, F.concat(F.lit("₹"), thousands(F.col("expected")))).otherwise(dash).alias("expected_text"),
        F.when(priced, F.regexp_replace(F.coalesce(share, F.lit("N/A")), ",", "")).otherwise(dash).alias("ratio_text"),
        F.coalesce(F.col("claim_date").cast("string"), dash).alias("date_text"),
    )
