"""Scores, probabilities and reasons of claims with serving features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import fixed_values as fixed
from claimloom.functions.numeric import half_up
from claimloom.functions.texts import looked_up

DRIVER_ORDER = [
    "is_diag_missing", "is_proc_missing", "is_billed_missing", "billing_ratio", "cost_diff", "high_cost_flag",
    "provider_claim_count", "provider_specialty_enc", "severity_score", "diag_claim_count", "diag_category_enc", "claim_age_days",
]
POLICY_IMPACT = -999.0


def logistic_probability(weights: dict[str, float], intercept: float) -> Column:
    """P(approved) of a fitted linear model as one expression, inside the scan's codegen."""
    z = F.lit(intercept)
    for name, weight in weights.items():
        z = z + F.col(name).cast("double") * F.lit(weight)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def proxy_scores(importances: dict[str, float] | None, mean_cost: Column) -> Column:
    """Struct of the importance-weighted score per feature; below zero pushes to denial.

    Ratios from .50 up to 1.25 other than exactly 1 give a small unweighted warning.
    """
    weight = {f: (1.0 / len(fixed.FEATURES) if importances is None else importances.get(f, 0.0)) for f in fixed.FEATURES}
    x = {f: F.col(f).cast("double") for f in fixed.FEATURES}
    w = {f: F.lit(v) for f, v in weight.items()}
    minus = {f: F.lit(-v) for f, v in weight.items()}
    one = F.lit(1.0)

    def completeness(f):
        return minus[f] * x[f] + w[f] * (one - x[f]) * 0.6

    r, age = x["billing_ratio"], x["claim_age_days"]
    scores = {
        **{f: completeness(f) for f in ("is_diag_missing", "is_proc_missing", "is_billed_missing")},
        "billing_ratio": F.when(r > 1.75, minus["billing_ratio"] * F.least(r - 1.75, one))
        .when(r > 1.25, minus["billing_ratio"] * (r - 1.25) / 0.5 * 0.4)
        .when(r == 1.0, w["billing_ratio"] * 0.9)
        .when(r >= 0.5, F.lit(-0.03) - F.abs(r - 1.0) * 0.15)
        .otherwise(minus["billing_ratio"] * 0.5),
        "cost_diff": minus["cost_diff"] * F.tanh(x["cost_diff"] / F.greatest(mean_cost, one)),
        "high_cost_flag": w["high_cost_flag"] * (F.lit(0.5) - x["high_cost_flag"]),
        "provider_claim_count": w["provider_claim_count"] * F.tanh((x["provider_claim_count"] - 50.0) / 50.0),
        "provider_specialty_enc": F.lit(0.0),
        "severity_score": minus["severity_score"] * (x["severity_score"] - 2.0) / 2.0,
        "diag_claim_count": w["diag_claim_count"] * F.tanh((x["diag_claim_count"] - 20.0) / 20.0),
        "diag_category_enc": F.lit(0.0),
        "claim_age_days": F.when(age <= 90, w["claim_age_days"] * (one - age / 90.0) * 0.4)
        .otherwise(minus["claim_age_days"] * F.tanh((age - 90.0) / 90.0)),
    }
    return F.struct(*[half_up(scores[f], 4).alias(f) for f in DRIVER_ORDER])


def risk_level(probability: Column) -> Column:
    return (
        F.when(probability >= 0.80, "CRITICAL").when(probability >= 0.55, "HIGH").when(probability >= 0.35, "MEDIUM").otherwise("LOW")
    )


def inference_risk(probability: Column) -> Column:
    """The coarser scale of batch inference."""
    return F.when(probability > 0.6, "HIGH").when(probability > 0.35, "MEDIUM").otherwise("LOW")


def calibrated_denial(p_approved: Column) -> Column:
    """Denial probability pushed away from .5: approvals into [.75, 1], the rest into [0, .25)."""
    pushed = F.when(p_approved >= 0.5, F.lit(0.75) + (p_approved - 0.5) * 0.5).otherwise(p_approved * 0.5)
    return half_up(F.lit(1.0) - pushed, 4)


def squashed_denial(denial: Column) -> Column:
    """Clean claims below .5 shrink further with how close the ratio is to 1."""
    ratio = F.col("billing_ratio")
    blocked = (
        (F.col("is_proc_missing") == 1) | (F.col("is_billed_missing") == 1) | (F.col("is_diag_missing") == 1)
        | (F.col("claim_age_days") > 90) | (ratio > 1.25) | (ratio < 0.5)
    )
    scale = F.least(F.lit(0.10) + F.abs(ratio - 1.0) * 0.50, F.lit(1.0))
    return F.when((denial < 0.5) & ~blocked, half_up(denial * scale, 4)).otherwise(denial)


def with_prediction(df: DataFrame, p_approved: Column, violation: Column) -> DataFrame:
    """Denial probability, status and risk level; a coverage violation overrides the model."""
    model = df.withColumns({"policy_violation": violation, "__denial": calibrated_denial(p_approved)})
    denial = F.when(F.col("policy_violation"), F.lit(1.0)).otherwise(squashed_denial(F.col("__denial")))
    return (
        model.withColumn("denial_prob", denial).drop("__denial")
        .withColumns(
            {
                "predicted_status": F.when(F.col("denial_prob") >= 0.5, "DENIED").otherwise("APPROVED"),
                "risk_level": risk_level(F.col("denial_prob")),
            }
        )
    )


def drivers() -> Column:
    """Scores as an array of (position, feature, impact), the policy violation last."""
    entries = [
        F.struct(F.lit(i).alias("position"), F.lit(f).alias("feature"), F.col("scores")[f].alias("impact")) for i, f in enumerate(DRIVER_ORDER)
    ]
    policy = F.struct(F.lit(len(DRIVER_ORDER)).alias("position"), F.lit("policy_violation").alias("feature"), F.lit(POLICY_IMPACT).alias("impact"))
    return F.array_compact(F.array(*entries, F.when(F.col("policy_violation"), policy)))


def reason_text(feature: Column, impact: Column) -> Column:
    table = {}
    for name, (denial, approval) in fixed.REASON_TEXTS.items():
        table[f"{name}-"] = denial
        table[f"{name}+"] = approval
    sign = F.when(impact < 0, F.lit("-")).otherwise(F.lit("+"))
    generic = F.when(impact < 0, "Feature contributed to denial risk.").otherwise("Feature contributed to approval.")
    return F.coalesce(looked_up(table, F.concat(feature, sign)), generic)


def ranked_drivers(top: int = 3) -> Column:
    """The strongest drivers of a claim, in the order they are shown; ``left_out`` marks what is not.

    Drivers under 1e-4 are left out. Approved claims leave severity out and show what speaks against
    them first; denied claims go by strength alone. Ties keep the driver order.
    """
    approved = F.col("predicted_status") == "APPROVED"

    def keyed(i, feature, impact, present=None):
        shown = F.abs(impact) > 0.0001
        if feature == "severity_score":
            shown = shown & ~approved
        return F.struct(
            F.when(shown if present is None else present, F.lit(0)).otherwise(F.lit(1)).alias("left_out"),
            F.when(approved & (impact >= 0), F.lit(1)).otherwise(F.lit(0)).alias("side"),
            (-F.abs(impact)).alias("strength"), F.lit(i).alias("position"), F.lit(feature).alias("feature"), impact.alias("impact"),
        )

    entries = [keyed(i, f, F.col("scores")[f]) for i, f in enumerate(DRIVER_ORDER)]
    entries.append(keyed(len(DRIVER_ORDER), "policy_violation", F.lit(POLICY_IMPACT), F.col("policy_violation")))
    # Plain columns and sort_array are compiled, functions of arrays interpreted: only the few at the front meet them.
    return F.slice(F.sort_array(F.array(*entries)), 1, top)


def reasons(policy_of: Column | None = None, top: int = 3, ranked: Column | None = None) -> Column:
    """Ranked reasons with texts and, from a map of reason text to passage, the best policy.

    ``ranked``: a column that already holds ``ranked_drivers``.
    """
    ratio = F.col("billing_ratio")

    def build(d, i):
        billing_warning = (d["feature"] == "billing_ratio") & (d["impact"] < 0)
        base = reason_text(d["feature"], d["impact"])
        shown = F.when(billing_warning & (ratio < 1), F.lit(fixed.BILLED_LESS_TEXT)).when(
            billing_warning & (ratio > 1), F.lit(fixed.BILLED_MORE_TEXT)
        ).otherwise(base)
        # The passage is retrieved for the plain reason text, before the billing wording.
        policy = F.try_element_at(policy_of, base) if policy_of is not None else None
        empty = F.lit(None).cast("string")
        return F.struct(
            (i + 1).alias("rank"), d["feature"].alias("feature"), shown.alias("explanation"), d["impact"].alias("impact_score"),
            (policy["policy_text"] if policy is not None else empty).alias("policy_text"),
            (policy["policy_source"] if policy is not None else empty).alias("policy_source"),
        )

    front = ranked_drivers(top) if ranked is None else ranked
    return F.transform(F.filter(front, lambda d: d["left_out"] == 0), build)


def denial_drivers() -> Column:
    return F.filter(F.col("reasons"), lambda r: r["impact_score"] < 0)


def approval_factors() -> Column:
    return F.filter(F.col("reasons"), lambda r: r["impact_score"] > 0)


def recommendation() -> Column:
    """Struct of recommendation and next action for the claim's top driver."""
    ratio, age = F.col("billing_ratio"), F.col("claim_age_days")
    against = denial_drivers()
    first = F.coalesce(F.get(against, 0)["feature"], F.get(F.col("reasons"), 0)["feature"], F.lit("is_diag_missing"))
    guarded = F.when((first == "billing_ratio") & (ratio <= 1.5), "cost_diff").when(
        (first == "claim_age_days") & (age <= 90), "severity_score"
    ).otherwise(first)

    def part(i):
        table = {name: pair[i] for name, pair in fixed.RECOMMENDATIONS.items()}
        denied = F.coalesce(looked_up(table, guarded), F.lit(fixed.DEFAULT_RECOMMENDATION[i]))
        approved = (
            F.when(F.size(against) == 0, fixed.CLEAN_RECOMMENDATION[i]).when(ratio < 1, fixed.UNDERBILLED_RECOMMENDATION[i])
            .otherwise(fixed.OVERBILLED_RECOMMENDATION[i])
        )
        return F.when(F.col("predicted_status") == "APPROVED", approved).otherwise(denied)

    return F.struct(part(0).alias("recommendation"), part(1).alias("next_action"))


def driver_category(feature: Column) -> Column:
    table = {f: name for name, members in fixed.DRIVER_CATEGORIES.items() for f in members}
    return F.coalesce(looked_up(table, feature), F.lit(fixed.OTHER_CATEGORY))


def driver_label(feature: Column) -> Column:
    return F.coalesce(looked_up(fixed.DRIVER_LABELS, feature), feature)


def strongest_denial() -> Column:
    """Feature of the reason with the lowest impact below zero."""
    lowest = F.array_min(
        F.transform(denial_drivers(), lambda r: F.struct(r["impact_score"].alias("i"), r["rank"].alias("k"), r["feature"].alias("f")))
    )
    return lowest["f"]


