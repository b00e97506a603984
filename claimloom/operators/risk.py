"""Risk points, tiers and labels."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import fixed_values as fixed
from claimloom.functions.numeric import percent, ratio
from claimloom.functions.skew import enrich
from claimloom.operators import clean

DENY_FROM = 5
POINTS_DENY_FROM = 3
LABELED_COLUMNS = [
    "claim_id", "patient_id", "provider_id", "diagnosis_code", "procedure_code",
    "billed_amount", "is_billed_missing", "claim_date", "denial_flag",
]


def _points(flag: Column, points: int) -> Column:
    return F.when(flag, F.lit(points)).otherwise(F.lit(0))


def pre_risk_score() -> Column:
    no_bill, no_proc = F.col("is_billed_missing"), F.col("is_proc_missing")
    base = F.when(no_bill & no_proc, F.lit(5)).when(no_proc, F.lit(3)).when(no_bill, F.lit(2)).otherwise(F.lit(0))
    return (
        base
        + _points(no_proc & F.col("is_provider_missing"), 1)
        + _points(F.col("is_diag_missing"), 2)
        + _points(F.col("is_provider_missing"), 2)
        + _points(F.col("is_date_missing"), 1)
    )


def billing_ratio() -> Column:
    """Billed over expected, 4 places; NULL without a positive benchmark."""
    return F.when(F.col("expected_cost") > 0, ratio(F.col("billed_amount"), F.col("expected_cost"), 4))


def billing_points(value: Column) -> Column:
    return F.when(value > 2.0, F.lit(4)).when(value > 1.5, F.lit(2)).otherwise(F.lit(0))


def score_tier(score: Column) -> Column:
    return (
        F.when(score == 0, "None").when(score <= 2, "Low").when(score <= 4, "Medium").when(score <= 6, "High")
        .otherwise("Critical")
    )


def noise_flip(key: Column, seed: int = fixed.NOISE_SEED, below: str = fixed.NOISE_BELOW) -> Column:
    """A flip that depends on the row's own key, so any partitioning gives the same rows."""
    return F.sha2(F.concat(key, F.lit(f":{seed}")), 256) < F.lit(below)


def score_claims(silver: DataFrame, silver_cost: DataFrame) -> DataFrame:
    """Silver claims with ratio, points, tier and the noisy threshold label.

    ``denial_flag`` keeps the training encoding: 0 denied, 1 approved.
    """
    priced = enrich(
        silver, silver_cost.select("procedure_code", "expected_cost"), "procedure_code", "claim_id", fixed.UNKNOWN_CODE
    )
    scored = (
        priced.withColumn("billing_ratio", billing_ratio())
        .withColumn("billing_points", billing_points(F.col("billing_ratio")))
        .withColumn("final_risk_score", F.col("pre_risk_score") + F.col("billing_points"))
    )
    denied = F.col("final_risk_score") >= DENY_FROM
    return scored.withColumns(
        {
            "risk_tier": score_tier(F.col("final_risk_score")),
            "denial_flag": F.when(denied != noise_flip(F.col("claim_id")), F.lit(0)).otherwise(F.lit(1)),
        }
    )


def labeled_claims(scored: DataFrame) -> DataFrame:
    """Only columns known before adjudication, plus the label."""
    return scored.select(*LABELED_COLUMNS)


# --- rule variant: points on standardised codes ------------------------------------------


def denial_points() -> Column:
    return (
        _points(F.col("diagnosis_code") == fixed.UNKNOWN_CODE, 3)
        + _points(F.col("procedure_code") == fixed.UNKNOWN_CODE, 3)
        + _points(F.col("billed_amount") == 0, 2)
    )


def reason_code() -> Column:
    return (
        F.when(F.col("diagnosis_code") == fixed.UNKNOWN_CODE, "R01_MISSING_DIAGNOSIS")
        .when(F.col("procedure_code") == fixed.UNKNOWN_CODE, "R02_MISSING_PROCEDURE")
        .when(F.col("billed_amount") == 0, "R03_MISSING_BILLED_AMOUNT")
        .otherwise("NONE")
    )


def points_label(points: Column) -> Column:
    """1 denied, 0 approved: the rule variant's encoding."""
    return F.when(points >= POINTS_DENY_FROM, F.lit(1)).otherwise(F.lit(0))


def points_probability(points: Column) -> Column:
    ladder = F.array(*[F.lit(p) for p in fixed.POINT_PROBABILITY])
    return F.element_at(ladder, F.least(points, F.lit(6)).cast("int") + 1)


def probability_tier(probability: Column) -> Column:
    return F.when(probability >= 0.70, "HIGH").when(probability >= 0.40, "MEDIUM").otherwise("LOW")


def with_point_outcome(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "denial_flag": points_label(F.col("denial_points")),
            "denial_probability": points_probability(F.col("denial_points")),
        }
    ).withColumn("risk_tier", probability_tier(F.col("denial_probability")))


def overbilling_rule(df: DataFrame) -> DataFrame:
    """Two more points above twice the average cost, then label, probability and tier again."""
    over = (F.col("average_cost") > 0) & (F.col("billed_amount") > F.col("average_cost") * 2)
    raised = df.withColumns(
        {
            "denial_points": F.col("denial_points") + _points(over, 2),
            "denial_reason_code": F.when((F.col("denial_reason_code") == "NONE") & over, "R04_EXTREME_OVERBILLING")
            .otherwise(F.col("denial_reason_code")),
        }
    )
    return with_point_outcome(raised)


def rule_claims_base(claims: DataFrame, order: list[str]) -> DataFrame:
    """Deduplicated claims in the rule variant's conventions: UNKNOWN codes, missing money 0."""
    cleaned = clean.keep_first(clean.standardise(claims, clean.CODE_COLUMNS), "claim_id", order)
    return clean.fill(cleaned, ["diagnosis_code", "procedure_code", "provider_id"], fixed.UNKNOWN_CODE).withColumn(
        "billed_amount", clean.missing_to_zero(F.col("billed_amount"))
    )


def wide_claims(
    claims: DataFrame, providers: DataFrame, diagnosis: DataFrame, cost: DataFrame, order: list[str], as_of: datetime.date
) -> DataFrame:
    """The rule variant end to end: points, three enrichments, overbilling, age."""
    pointed = with_point_outcome(
        rule_claims_base(claims, order)
        .withColumn("denial_points", denial_points())
        .withColumn("denial_reason_code", reason_code())
    )
    # The doctor's name stays behind: later layers do not need it.
    with_provider = clean.enrich_with_defaults(
        pointed, providers.select("provider_id", "specialty", "location"), "provider_id", ["specialty", "location"], []
    )
    with_diagnosis = clean.enrich_with_defaults(
        with_provider,
        diagnosis.select(
            "diagnosis_code", F.col("category").alias("diagnosis_category"), F.col("severity").alias("diagnosis_severity")
        ),
        "diagnosis_code", ["diagnosis_category", "diagnosis_severity"], [],
    )
    with_cost = clean.enrich_with_defaults(
        with_diagnosis, cost.select("procedure_code", "average_cost", "expected_cost"), "procedure_code", [],
        ["average_cost", "expected_cost"],
    )
    final = overbilling_rule(with_cost).withColumns(
        {
            "claim_age_days": claim_age(F.col("claim_date"), as_of),
            "is_diagnosis_missing": (F.col("diagnosis_code") == fixed.UNKNOWN_CODE).cast("int"),
            "is_procedure_missing": (F.col("procedure_code") == fixed.UNKNOWN_CODE).cast("int"),
            "_silver_timestamp": F.current_timestamp(),
            "_silver_layer": F.lit("silver"),
        }
    )
    return final.select(*fixed.WIDE_CLAIM_COLUMNS)


def claim_age(date: Column, as_of: datetime.date) -> Column:
    return F.datediff(F.lit(as_of), date)


def label_guardrails(df: DataFrame, flag: str, denied_value: int) -> DataFrame:
    """Label rate with its alarm: below 20 % or above 45 % denied."""
    counted = df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col(flag) == denied_value).alias("denied")
    ).withColumn("denial_rate", percent(F.col("denied"), F.col("total"), 2))
    return counted.withColumn(
        "status",
        F.when(F.col("denial_rate") < 20, "BELOW_TARGET").when(F.col("denial_rate") > 45, "ABOVE_TARGET").otherwise("OK"),
    )
