"""The batch adjudication job and the scoring chain."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.skew import HOT_ROWS, apart
from claimloom.functions.texts import service_date
from claimloom.operators import adjudicate, attribution, duplicates, rules
from claimloom.operators.features import mean_expected_cost, serving_features
from claimloom.sources.scratch import noted, remove_tables, written


@dataclass(frozen=True)
class Dimensions:
    providers: DataFrame
    diagnosis: DataFrame
    cost: DataFrame
    policies: DataFrame


def score(
    claims: DataFrame,
    dims: Dimensions,
    p_approved: Column,
    as_of: datetime.date,
    importances: dict[str, float] | None = None,
    policy_of: Column | None = None,
) -> DataFrame:
    """Claims with features, prediction, ranked reasons, verdict and recommendation.

    One plan for any number of claims. A claim with an unusable input becomes a row with
    ``predicted_status = 'ERROR'`` and an ``error_code``; it never stops the others.
    """
    referenced = apart(rules.with_references(claims, dims.providers, dims.diagnosis, dims.cost, dims.policies))
    featured = apart(serving_features(referenced, dims.providers, dims.diagnosis, dims.cost, as_of))
    broken = F.coalesce(F.col("billed_amount") < 0, F.lit(False)) | F.col("claim_id").isNull()
    predicted = apart(attribution.with_prediction(featured, p_approved, rules.coverage_violation()))
    # A function of arrays interprets what is written into it: scores and reasons are columns before it reads them.
    scored = apart(predicted.withColumn("scores", attribution.proxy_scores(importances, mean_expected_cost(dims.cost))))
    ranked = apart(scored.withColumns({"drivers": attribution.drivers(), "__ranked": attribution.ranked_drivers()}))
    reasoned = apart(ranked.withColumn("reasons", attribution.reasons(policy_of, ranked=F.col("__ranked"))).drop("__ranked"))
    explained = apart(reasoned.withColumns({"recommended": attribution.recommendation(), "billing_verdict": rules.billing_verdict()}))
    return explained.withColumns(
        {
            "error_code": F.when(broken, F.lit("CDP-001-001")),
            "predicted_status": F.when(broken, F.lit("ERROR")).otherwise(F.col("predicted_status")),
        }
    )


def adjudicate_batch(
    batch: DataFrame,
    history: DataFrame,
    dims: Dimensions,
    p_approved: Column,
    as_of: datetime.date,
    importances: dict[str, float] | None = None,
    policy_of: Column | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Every row of an uploaded batch with its final status and texts.

    Rows that are invalid, blocked or rejected by rule skip scoring.
    """
    parsed = batch.withColumns({"claim_date": service_date(F.col("service_date")), "__errors": rules.row_errors()})
    bad_format = F.col("__errors") != "Valid"
    checked = parsed.withColumns(
        {
            "bad_date": ~bad_format & F.col("claim_date").isNull(),
            "input_error": F.when(bad_format, F.col("__errors")).when(
                F.col("claim_date").isNull(),
                F.concat(F.lit("Invalid service date: '"), F.coalesce("service_date", F.lit("")), F.lit("'")),
            ),
        }
    ).drop("__errors")
    valid = checked.where(F.col("input_error").isNull())
    invalid = checked.where(F.col("input_error").isNotNull())

    with noted() as of_marks:
        decided = duplicates.with_decision(duplicates.marked(valid, history, hot_rows))
    ruled = rules.apply_rules(rules.with_references(decided, dims.providers, dims.diagnosis, dims.cost, dims.policies))
    none = F.array().cast(ruled.schema["violations"].dataType)
    ruled = written(ruled.withColumn("violations", F.when(F.col("is_blocked"), none).otherwise(F.col("violations"))), "ruled_claims")
    remove_tables(batch.sparkSession, of_marks)
    stopped = F.col("is_blocked") | (F.size("violations") > 0)
    clean = ruled.where(~stopped).drop(
        "provider_known", "diagnosis_known", "procedure_known", "covered", "policy_start_date", "policy_end_date", "expected", "billing_verdict"
    )
    scored = score(clean, dims, p_approved, as_of, importances, policy_of).withColumn("outcome", adjudicate.granular_outcome())
    all_rows = scored.unionByName(ruled.where(stopped), allowMissingColumns=True).unionByName(invalid, allowMissingColumns=True)
    final = adjudicate.with_batch_texts(all_rows.withColumns(
        {
            "violations": F.coalesce("violations", none),
            "is_blocked": F.coalesce("is_blocked", F.lit(False)), "is_revised": F.coalesce("is_revised", F.lit(False)),
            "force_review": F.coalesce("force_review", F.lit(False)), "duplicate_type": F.coalesce("duplicate_type", F.lit("—")),
        }
    ).withColumn("status", adjudicate.batch_status()))
    by_rule = F.size("violations") > 0
    stopped_prob = F.when(F.col("status").isin("INVALID_INPUT", "DUPLICATE_BLOCKED"), F.lit(0.0)).when(by_rule, F.lit(1.0))
    return final.withColumns(
        {
            "outcome": F.when(F.col("status").isin("INVALID_INPUT", "DUPLICATE_BLOCKED"), F.col("status")).when(by_rule, "RULE_DENY").otherwise(F.col("outcome")),
            "denial_prob": F.coalesce(stopped_prob, F.col("denial_prob")),
            "risk_level": F.when(by_rule & (F.col("status") == "REJECTED"), "CRITICAL").otherwise(F.col("risk_level")),
        }
    )
