"""Gold feature table: twelve inputs per claim and the label."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import fixed_values as fixed
from claimloom.functions.numeric import exact_sum, half_up, ratio
from claimloom.functions.skew import HOT_ROWS, enrich, lookup_totals


def claim_base(labeled: DataFrame, providers: DataFrame, diagnosis: DataFrame, cost: DataFrame) -> DataFrame:
    with_provider = enrich(
        labeled, providers.select("provider_id", F.col("specialty").alias("provider_specialty")),
        "provider_id", "claim_id", fixed.UNKNOWN_CODE,
    )
    with_diagnosis = enrich(
        with_provider,
        diagnosis.select("diagnosis_code", F.col("category").alias("diag_category"), F.col("severity").alias("diag_severity")),
        "diagnosis_code", "claim_id", fixed.UNKNOWN_CODE,
    )
    return enrich(
        with_diagnosis,
        cost.select("procedure_code", "average_cost", "expected_cost", F.col("region").alias("proc_region")),
        "procedure_code", "claim_id", fixed.UNKNOWN_CODE,
    )


def cost_features(df: DataFrame) -> DataFrame:
    known = F.col("expected_cost") > 0
    return df.withColumns(
        {
            "billing_ratio": F.when(known, ratio(F.col("billed_amount"), F.col("expected_cost"), 4)).otherwise(F.lit(1.0)),
            "cost_diff": F.when(known, (F.col("billed_amount") - F.col("expected_cost")).cast("double")).otherwise(F.lit(0.0)),
        }
    ).withColumn("high_cost_flag", F.when(F.col("billing_ratio") > 1.5, F.lit(1)).otherwise(F.lit(0)))


def provider_totals(df: DataFrame) -> DataFrame:
    """Volume, denial rate, mean billed and volume-weighted risk per provider."""
    totals = df.groupBy("provider_id").agg(
        F.count("claim_id").alias("provider_claim_count"),
        F.count_if(F.col("denial_flag") == 0).alias("__denied"),
        exact_sum(F.col("billed_amount")).alias("__billed"),
    )
    count = F.col("provider_claim_count")
    return (
        totals.withColumn("provider_denial_rate", half_up(F.col("__denied") / count, 4))
        .withColumn("provider_avg_billed", half_up(F.col("__billed") / count, 4))
        .withColumn("provider_risk_score", half_up(count * F.col("provider_denial_rate"), 4))
        .drop("__denied", "__billed")
    )


def with_provider_features(df: DataFrame, labeled: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Totals joined back instead of a window: a busy provider stays spread over tasks."""
    totals = provider_totals(labeled)
    return lookup_totals(df, totals, ["provider_id"], "provider_claim_count", F.col("claim_id"), hot_rows)


def with_diagnosis_volume(df: DataFrame, labeled: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    totals = labeled.groupBy("diagnosis_code").agg(F.count("claim_id").alias("diag_claim_count"))
    return lookup_totals(df, totals, ["diagnosis_code"], "diag_claim_count", F.col("claim_id"), hot_rows)


def severity_score(severity: Column) -> Column:
    word = F.upper(severity)
    return F.when(word == "MILD", F.lit(1)).when(word == "SEVERE", F.lit(3)).otherwise(F.lit(2))


def integrity_flags(df: DataFrame) -> DataFrame:
    def unknown(column: str) -> Column:
        return F.when(F.col(column).isNull() | (F.upper(F.col(column)) == fixed.UNKNOWN_CODE), F.lit(1)).otherwise(F.lit(0))

    flagged = df.withColumns(
        {
            "is_billed_missing": F.col("is_billed_missing").cast("int"),
            "is_proc_missing": unknown("procedure_code"),
            "is_diag_missing": unknown("diagnosis_code"),
        }
    )
    return flagged.withColumn(
        "missing_flag_count", F.col("is_billed_missing") + F.col("is_proc_missing") + F.col("is_diag_missing")
    )


def time_features(df: DataFrame, labeled: DataFrame) -> DataFrame:
    """Age against the newest claim in the data; claims without a date count as age 0."""
    newest = labeled.agg(F.max("claim_date")).scalar()
    return df.withColumns(
        {
            "claim_age_days": F.coalesce(F.datediff(newest, F.col("claim_date")), F.lit(0)),
            "claim_month": F.coalesce(F.month("claim_date"), F.lit(0)),
        }
    )


def label_code(value: Column, dim: DataFrame, column: str, unseen: int) -> Column:
    """Position of ``value`` among the sorted distinct values of a dimension column.

    Meant for short category lists; the list is a one-row subquery, evaluated once.
    """
    codes = dim.agg(F.array_sort(F.collect_set(column))).scalar()
    position = F.array_position(codes, value)
    return F.when(position > 0, (position - 1).cast("int")).otherwise(F.lit(unseen))


def encode(df: DataFrame, providers: DataFrame, diagnosis: DataFrame, cost: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "provider_specialty_enc": label_code(F.col("provider_specialty"), providers, "specialty", 0),
            "diag_category_enc": label_code(F.col("diag_category"), diagnosis, "category", 0),
            "proc_region_enc": label_code(F.col("proc_region"), cost, "region", -1),
        }
    )


def feature_table(labeled: DataFrame, providers: DataFrame, diagnosis: DataFrame, cost: DataFrame) -> DataFrame:
    """Every engineered column; ``gold_features`` selects the model's contract.

    The three totals read the labeled table itself, not the widened rows, so their scans touch
    two or three columns.
    """
    wide = cost_features(claim_base(labeled, providers, diagnosis, cost))
    wide = with_diagnosis_volume(with_provider_features(wide, labeled), labeled)
    wide = wide.withColumn("severity_score", severity_score(F.col("diag_severity")))
    return encode(time_features(integrity_flags(wide), labeled), providers, diagnosis, cost)


def gold_features(wide: DataFrame) -> DataFrame:
    return wide.select("claim_id", *fixed.FEATURES, "denial_flag")


def serving_features(
    claims: DataFrame,
    providers: DataFrame,
    diagnosis: DataFrame,
    cost: DataFrame,
    as_of: datetime.date,
    provider_counts: DataFrame | None = None,
    diagnosis_counts: DataFrame | None = None,
) -> DataFrame:
    """The twelve features of incoming claims, with the serving defaults for what is unknown.

    Dimensions are the raw ones. Optional count tables carry real volumes; without them the
    fixed serving counts apply.
    """
    specialty = providers.select("provider_id", F.col("specialty").alias("__specialty"))
    severity = diagnosis.select("diagnosis_code", F.col("category").alias("__category"), F.col("severity").alias("__severity"))
    benchmark = cost.where(F.col("expected_cost").isNotNull()).select(
        "procedure_code", F.col("expected_cost").alias("__expected")
    )
    mean_cost = mean_expected_cost(cost)
    df = enrich(claims, specialty, "provider_id", "claim_id")
    df = enrich(df, severity, "diagnosis_code", "claim_id")
    df = enrich(df, benchmark, "procedure_code", "claim_id")
    if provider_counts is not None:
        df = enrich(df, provider_counts.select("provider_id", F.col("provider_claim_count").alias("__pc")), "provider_id", "claim_id")
    if diagnosis_counts is not None:
        df = enrich(df, diagnosis_counts.select("diagnosis_code", F.col("diag_claim_count").alias("__dc")), "diagnosis_code", "claim_id")
    billed = F.coalesce(F.col("billed_amount").cast("double"), F.lit(0.0))
    level = F.upper(F.trim(F.col("__severity")))
    blank = lambda c: F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) == "", F.lit(1)).otherwise(F.lit(0))
    with_cost = df.withColumn("expected_cost", F.coalesce(F.col("__expected").cast("double"), mean_cost))
    out = with_cost.withColumns(
        {
            "billing_ratio": half_up(billed / F.greatest(F.col("expected_cost"), F.lit(1.0)), 4),
            "cost_diff": half_up(billed - F.col("expected_cost"), 4),
            "provider_claim_count": F.coalesce(
                F.col("__pc"), F.lit(fixed.DEFAULT_PROVIDER_COUNT)
            ) if provider_counts is not None else F.lit(fixed.DEFAULT_PROVIDER_COUNT),
            "provider_specialty_enc": F.when(
                F.col("__specialty").isNotNull(), label_code(F.col("__specialty"), providers, "specialty", 0)
            ).otherwise(F.lit(fixed.DEFAULT_SPECIALTY)),
            "severity_score": F.when(level.isin("HIGH", "SEVERE"), F.lit(3)).when(level.isin("LOW", "MILD"), F.lit(1))
            .otherwise(F.lit(fixed.DEFAULT_SEVERITY)),
            "diag_claim_count": F.coalesce(
                F.col("__dc"), F.lit(fixed.DEFAULT_DIAG_COUNT)
            ) if diagnosis_counts is not None else F.lit(fixed.DEFAULT_DIAG_COUNT),
            "diag_category_enc": label_code(F.col("__category"), diagnosis, "category", fixed.DEFAULT_CATEGORY),
            "is_billed_missing": F.when(F.col("billed_amount").isNull(), F.lit(1)).otherwise(F.lit(0)),
            "is_proc_missing": blank("procedure_code"),
            "is_diag_missing": blank("diagnosis_code"),
            "claim_age_days": F.coalesce(F.datediff(F.lit(as_of), F.col("claim_date")), F.lit(0)),
        }
    )
    out = out.withColumn("high_cost_flag", F.when(F.col("billing_ratio") > 1.5, F.lit(1)).otherwise(F.lit(0)))
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def mean_expected_cost(cost: DataFrame) -> Column:
    """Mean benchmark as a scalar subquery; the fixed mean when the cost table is empty."""
    return F.coalesce(
        cost.agg(F.try_divide(exact_sum(F.col("expected_cost")), F.count("expected_cost"))).scalar(),
        F.lit(fixed.DEFAULT_MEAN_COST),
    )
