"""Analytical reports over the claim star.

Reports by a dimension attribute aggregate the claims by key first and join the few
aggregated rows, so the fact table is shuffled once, pre-combined, and never joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.numeric import exact_avg, half_up, percent, ratio
from claimloom.functions.quantiles import exact_quantiles
from claimloom.functions.skew import enrich

OVERPRICED = 1.5


def _rows() -> Column:
    return F.count(F.lit(1))


def _per_key(claims: DataFrame, key: str) -> DataFrame:
    """Combinable totals per key."""
    return claims.groupBy(key).agg(
        F.count("claim_id").alias("n"),
        F.count("billed_amount").alias("n_billed"),
        F.sum("billed_amount").alias("billed"),
    )


def _avg(total: Column, count: Column, places: int = 2) -> Column:
    return half_up(F.try_divide(total.cast("double"), count), places)


def _by_attribute(claims: DataFrame, dim: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    totals = _per_key(claims, key)
    joined = totals.join(dim.select(F.col(key).alias("__k"), *attributes), F.col(key) == F.col("__k"), "left")
    return joined.groupBy(*attributes).agg(
        F.sum("n").alias("n"), F.sum("n_billed").alias("n_billed"), F.sum("billed").alias("billed")
    )


def busiest_providers(claims: DataFrame, top: int = 20) -> DataFrame:
    return (
        claims.where(F.col("provider_id").isNotNull()).groupBy("provider_id").agg(_rows().alias("claim_count"))
        .orderBy(F.desc("claim_count"), "provider_id").limit(top)
    )


def costliest_providers(claims: DataFrame, top: int = 15) -> DataFrame:
    return (
        claims.where(F.col("provider_id").isNotNull()).groupBy("provider_id").agg(
            _rows().alias("total_claims"), exact_avg(F.col("billed_amount"), 2).alias("avg_billed"),
            F.min("billed_amount").cast("double").alias("min_billed"),
            F.max("billed_amount").cast("double").alias("max_billed"),
        ).orderBy(F.desc("avg_billed"), "provider_id").limit(top)
    )


def provider_volume(claims: DataFrame, providers: DataFrame) -> DataFrame:
    totals = _per_key(claims, "provider_id")
    dim = providers.withColumnRenamed("provider_id", "__k")
    return totals.join(dim, F.col("provider_id") == F.col("__k"), "left").select(
        "provider_id", "doctor_name", "specialty", "location", F.col("n").alias("total_claims"),
        _avg(F.col("billed"), F.col("n_billed")).alias("avg_billed"), F.col("billed").cast("double").alias("total_billed"),
    )


def severity_counts(diagnosis: DataFrame) -> DataFrame:
    return diagnosis.groupBy("severity").agg(_rows().alias("count")).orderBy(F.desc("count"), "severity")


def severity_cost(claims: DataFrame, diagnosis: DataFrame) -> DataFrame:
    known = _by_attribute(claims, diagnosis, "diagnosis_code", ["severity"]).where(F.col("severity").isNotNull())
    return known.select(
        "severity", F.col("n").alias("total_claims"), _avg(F.col("billed"), F.col("n_billed")).alias("avg_billed")
    ).orderBy(F.desc("avg_billed"))


def diagnosis_volume(claims: DataFrame, diagnosis: DataFrame) -> DataFrame:
    dim = diagnosis.withColumnRenamed("diagnosis_code", "__k")
    return _per_key(claims, "diagnosis_code").join(dim, F.col("diagnosis_code") == F.col("__k"), "left").select(
        "diagnosis_code", "category", "severity", F.col("n").alias("total_claims"),
        _avg(F.col("billed"), F.col("n_billed")).alias("avg_billed"),
    )


def with_provider(claims: DataFrame, providers: DataFrame) -> DataFrame:
    return enrich(claims, providers, "provider_id", "claim_id").select(
        "claim_id", "patient_id", "doctor_name", "specialty", "location", "billed_amount", "claim_date"
    )


def with_diagnosis(claims: DataFrame, diagnosis: DataFrame) -> DataFrame:
    return enrich(claims, diagnosis, "diagnosis_code", "claim_id").select(
        "claim_id", "procedure_code", "diagnosis_code", "category", "severity"
    )


def billing_gap(claims: DataFrame, cost: DataFrame) -> DataFrame:
    """Ratio and price flag of every claim that has a positive benchmark."""
    benchmark = cost.where(F.col("expected_cost") > 0).select(F.col("procedure_code").alias("__k"), "expected_cost")
    over = F.col("billed_amount") > F.col("expected_cost") * F.lit(OVERPRICED).cast("decimal(3,1)")
    return claims.join(benchmark, F.col("procedure_code") == F.col("__k"), "inner").select(
        "claim_id", "row_key", "procedure_code", "billed_amount", "expected_cost",
        ratio(F.col("billed_amount"), F.col("expected_cost"), 2).alias("billing_ratio"),
        F.when(over, "OVERPRICED").otherwise("NORMAL").alias("pricing_flag"),
    )


def top_billing_gaps(claims: DataFrame, cost: DataFrame, top: int = 25) -> DataFrame:
    return billing_gap(claims, cost).orderBy(F.desc_nulls_last("billing_ratio"), "claim_id", "row_key").limit(top)


def claims_by_specialty(claims: DataFrame, providers: DataFrame) -> DataFrame:
    return _by_attribute(claims, providers, "provider_id", ["specialty"]).select(
        "specialty", F.col("n").alias("total_claims"), _avg(F.col("billed"), F.col("n_billed")).alias("avg_billed"),
        F.col("billed").cast("double").alias("total_billed"),
        (F.col("n") - F.col("n_billed")).alias("missing_amount_count"),
    )


def claims_by_region(claims: DataFrame, cost: DataFrame) -> DataFrame:
    """Volume, money and the gap to the benchmark mean, weighted by claims."""
    totals = _per_key(claims, "procedure_code")
    dim = cost.select(F.col("procedure_code").alias("__k"), "region", "expected_cost")
    joined = totals.join(dim, F.col("procedure_code") == F.col("__k"), "left")
    grouped = joined.groupBy("region").agg(
        F.sum("n").alias("total_claims"), F.sum("n_billed").alias("nb"), F.sum("billed").alias("billed"),
        F.sum(F.col("expected_cost") * F.col("n")).cast("double").alias("expected"),
        F.sum(F.when(F.col("expected_cost").isNotNull(), F.col("n"))).alias("ne"),
    )
    avg_billed = F.try_divide(F.col("billed").cast("double"), F.col("nb"))
    avg_expected = F.try_divide(F.col("expected"), F.col("ne"))
    return grouped.select(
        "region", "total_claims", half_up(avg_billed, 2).alias("avg_billed"), half_up(avg_expected, 2).alias("avg_expected"),
        F.col("billed").cast("double").alias("total_billed"),
        half_up(F.try_divide((avg_billed - avg_expected) * F.lit(100.0), avg_expected), 1).alias("gap_pct"),
    )


def high_cost_claims(claims: DataFrame, providers: DataFrame, diagnosis: DataFrame, cost: DataFrame, p: float = 0.90) -> DataFrame:
    """Claims at or above a billed quantile with their attributes. The quantile is a scalar
    subquery; the filter runs before the three joins."""
    limit = exact_quantiles(claims, [], "billed_amount", {"limit": p}).scalar()
    high = claims.where(F.col("billed_amount") >= limit)
    joined = enrich(high, providers.select("provider_id", "doctor_name", "specialty"), "provider_id", "claim_id")
    joined = enrich(
        joined,
        diagnosis.select("diagnosis_code", F.col("category").alias("diagnosis_category"), F.col("severity").alias("diagnosis_severity")),
        "diagnosis_code", "claim_id",
    )
    joined = enrich(joined, cost.select("procedure_code", "expected_cost"), "procedure_code", "claim_id")
    return joined.select(
        "claim_id", "patient_id", "doctor_name", "specialty", "diagnosis_code", "diagnosis_category", "diagnosis_severity",
        "procedure_code", "billed_amount", "expected_cost",
        ratio(F.col("billed_amount"), F.col("expected_cost"), 2).alias("billing_ratio"), "claim_date",
    )


def missing_billed_claims(claims: DataFrame, cost: DataFrame) -> DataFrame:
    gone = claims.where(F.col("billed_amount").isNull())
    return enrich(gone, cost.select("procedure_code", "expected_cost"), "procedure_code", "claim_id").select(
        "claim_id", "patient_id", "provider_id", "procedure_code", "diagnosis_code", "billed_amount", "expected_cost",
        F.lit(True).alias("is_billed_missing"),
    )


def imputation_readiness(missing: DataFrame) -> DataFrame:
    can = F.count("expected_cost")
    return missing.agg(
        _rows().alias("total_missing_billed"), can.alias("can_impute_count"), (_rows() - can).alias("cannot_impute_count"),
        percent(can, _rows(), 1).alias("imputable_pct"),
    )


def category_severity(claims: DataFrame, diagnosis: DataFrame) -> DataFrame:
    return _by_attribute(claims, diagnosis, "diagnosis_code", ["category", "severity"]).where(
        F.col("category").isNotNull()
    ).select(
        "category", "severity", F.col("n").alias("total_claims"), _avg(F.col("billed"), F.col("n_billed")).alias("avg_billed")
    )


def monthly_volume(claims: DataFrame) -> DataFrame:
    return (
        claims.where(F.col("claim_date").isNotNull())
        .groupBy(F.date_format("claim_date", "yyyy-MM").alias("month"))
        .agg(F.count("claim_id").alias("total_claims"), half_up(F.sum("billed_amount").cast("double"), 0).alias("total_billed"))
        .orderBy("month")
    )


def overpriced_by_specialty(claims: DataFrame, providers: DataFrame, cost: DataFrame) -> DataFrame:
    """Pre-aggregated per (provider, procedure): the benchmark is constant there."""
    benchmark = cost.where(F.col("expected_cost") > 0).select(F.col("procedure_code").alias("__p"), "expected_cost")
    over = F.col("billed_amount") > F.col("expected_cost") * F.lit(OVERPRICED).cast("decimal(3,1)")
    priced = (
        claims.join(benchmark, F.col("procedure_code") == F.col("__p"), "inner")
        .groupBy("provider_id")
        .agg(
            F.count("claim_id").alias("n"), F.count_if(over).alias("over"), F.count("billed_amount").alias("nb"),
            # Rounded per claim to a fixed scale, so the sum is exact in any order.
            F.sum((F.col("billed_amount") / F.col("expected_cost")).cast("decimal(20,8)")).alias("ratios"),
        )
    )
    dim = providers.select(F.col("provider_id").alias("__k"), "specialty")
    return (
        priced.join(dim, F.col("provider_id") == F.col("__k"), "left").groupBy("specialty")
        .agg(F.sum("n").alias("total_claims"), F.sum("over").alias("overpriced_count"), F.sum("nb").alias("nb"), F.sum("ratios").alias("ratios"))
        .select(
            "specialty", "total_claims", _avg(F.col("ratios"), F.col("nb")).alias("avg_billing_ratio"), "overpriced_count",
            percent(F.col("overpriced_count"), F.col("total_claims"), 1).alias("overpriced_pct"),
        )
    )


def risk_categories(claims: DataFrame, cost: DataFrame) -> DataFrame:
    over = F.col("billed_amount") > F.col("expected_cost") * F.lit(OVERPRICED).cast("decimal(3,1)")
    joined = enrich(claims, cost.select("procedure_code", "expected_cost"), "procedure_code", "claim_id")
    category = (
        F.when(F.col("billed_amount").isNull(), "High Risk  — Missing Bill")
        .when(over, "High Risk  — Overpriced")
        .when(F.col("provider_id").isNull() | F.col("patient_id").isNull(), "Medium Risk — Missing Identity")
        .otherwise("Low Risk   — Normal")
    )
    return joined.groupBy(category.alias("risk_category")).agg(F.count("claim_id").alias("total_claims")).orderBy(F.desc("total_claims"))


def denial_rate_by_diagnosis(history: DataFrame, top: int = 15) -> DataFrame:
    return (
        history.where(F.coalesce(F.col("diagnosis_code"), F.lit("")) != "").groupBy("diagnosis_code")
        .agg(_rows().alias("total"), F.count_if(F.col("predicted_status") == "DENIED").alias("denied"))
        .withColumn("denial_rate_pct", percent(F.col("denied"), F.col("total"), 1))
        .orderBy(F.desc("total"), "diagnosis_code").limit(top)
    )


def ratio_histogram(history: DataFrame) -> DataFrame:
    return (
        history.where(F.col("billing_ratio").between(0, 5))
        .groupBy(half_up(F.col("billing_ratio"), 1).alias("ratio_bucket")).agg(_rows().alias("cnt")).orderBy("ratio_bucket")
    )


def top_rows(df: DataFrame, status: str, order: list, n: int) -> DataFrame:
    """Spot check: the first rows of one status, a bounded sort per task."""
    return df.where(F.col("predicted_status") == status).orderBy(*order).limit(n)


def status_counts(results: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    chosen = results if wanted is None else results.where(F.col("status").isin(wanted))
    return chosen.groupBy("status").agg(_rows().alias("claims"))


# --- request log ---------------------------------------------------------------------------


def request_log(events: DataFrame, codes: DataFrame) -> DataFrame:
    """Events as a request log: an error event is a failed request with a numbered error code."""
    number = F.get_json_object("props", "$.k").cast("int")
    failed = F.col("event_type") == "error"
    return events.select(
        "event_id", "ts", F.col("event_type").alias("endpoint"),
        F.when(failed, F.lit(500)).otherwise(F.lit(200)).alias("status_code"),
        F.when(failed, number % 19).alias("code_number"),
        F.col("value").alias("response_time_ms"),
        "props",
    ).join(codes.select(F.col("code_number").alias("__n"), "error_code"), F.col("code_number") == F.col("__n"), "left").drop("__n")


def request_metrics(log: DataFrame) -> DataFrame:
    failed = F.col("status_code") >= 400
    return log.agg(
        _rows().alias("total_requests"), F.count_if(failed).alias("total_errors"),
        percent(F.count_if(failed), _rows(), 2).alias("error_rate_pct"),
    )


def error_code_counts(log: DataFrame, descriptions: DataFrame) -> DataFrame:
    counts = log.where((F.col("status_code") >= 400) & F.col("error_code").isNotNull()).groupBy("error_code").agg(
        _rows().alias("errors")
    )
    return counts.join(descriptions.select(F.col("error_code").alias("__c"), "description"), F.col("error_code") == F.col("__c"), "left").drop("__c")


def claim_id_of_body(body: Column) -> Column:
    """The body's claim id as text; empty when absent or the body is not JSON."""
    return F.coalesce(F.get_json_object(body, "$.claim_id"), F.lit(""))
