"""Cleaning and conformance: bronze tables to silver tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import fixed_values as fixed
from claimloom.functions.quantiles import count_amounts, quantiles_of_counts
from claimloom.functions.skew import enrich

MONEY = "decimal(18,2)"
SILVER_VERSION = "1.0"
INGEST_COLUMNS = ["ingestion_time", "source_file", "_ingestion_timestamp", "_source_file", "_source_layer", "_is_phi"]
CODE_COLUMNS = ["claim_id", "patient_id", "provider_id", "diagnosis_code", "procedure_code"]


def drop_ingest_columns(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in INGEST_COLUMNS if c in df.columns])


def keep_first(df: DataFrame, key: str, order: list) -> DataFrame:
    """One row per key, the first in ``order``; pass a total order for a repeatable result.

    Spark pushes the ``= 1`` limit below the shuffle, so a task sends at most one row per key
    and a key with many copies costs no more than a rare one.
    """
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where(F.col("__rank") == 1).drop("__rank")


def keep_latest(df: DataFrame, key: str, ingested: str, tie_break: list[str]) -> DataFrame:
    """The most recently ingested row per key; ties fall to ``tie_break``."""
    return keep_first(df, key, [F.col(ingested).desc_nulls_last(), *tie_break])


def standard_code(column) -> Column:
    return F.upper(F.trim(column))


def standard_text(column) -> Column:
    return F.initcap(F.trim(column))


def standardise(df: DataFrame, codes: Iterable[str] = (), texts: Iterable[str] = ()) -> DataFrame:
    changed = {c: standard_code(F.col(c)) for c in codes if c in df.columns}
    changed |= {c: standard_text(F.col(c)) for c in texts if c in df.columns}
    return df.withColumns(changed) if changed else df


def severity_level(column: Column) -> Column:
    word = standard_code(column)
    level = F.lit(fixed.UNKNOWN_TEXT)
    for name, words in reversed(list(fixed.SEVERITY_WORDS.items())):
        level = F.when(word.isin(words), F.lit(name)).otherwise(level)
    return level


def fill(df: DataFrame, columns: Iterable[str], sentinel: str) -> DataFrame:
    return df.na.fill(sentinel, list(columns))


def parse_amount(column) -> Column:
    return F.col(column).try_cast(MONEY) if isinstance(column, str) else column.try_cast(MONEY)


def parse_date(column, pattern: str = "yyyy-MM-dd") -> Column:
    return F.try_to_date(F.col(column) if isinstance(column, str) else column, pattern)


def negative_to_null(amount: Column) -> Column:
    return F.when(amount >= 0, amount)


def missing_to_zero(amount: Column) -> Column:
    """The rule variant's convention: no positive amount counts as 0."""
    return F.when(amount > 0, amount).otherwise(F.lit(0).cast(MONEY))


def impute_median(df: DataFrame, group: str, amounts: list[str]) -> DataFrame:
    """Fill each amount with its group's median, then with the overall median.

    Rows without a group form a group of their own. Medians are exact and pre-aggregated, so
    only one row per group joins back.
    """
    for amount in amounts:
        counted = count_amounts(df, [group], amount)
        by_group = quantiles_of_counts(counted, [group], {"__median": 0.5}).withColumnRenamed(group, "__group")
        overall = quantiles_of_counts(counted, [], {"__median": 0.5}).scalar()
        df = (
            df.join(by_group, F.col(group).eqNullSafe(F.col("__group")), "left")
            .withColumn(amount, F.coalesce(F.col(amount), F.col("__median"), overall).cast(MONEY))
            .drop("__group", "__median")
        )
    return df


def impute_dimension_median(dim: DataFrame, group: str, amounts: list[str]) -> DataFrame:
    """The same fill for a dimension, whose groups are short enough for the built-in median."""
    median = lambda a: F.expr(f"percentile_disc(0.5) within group (order by {a})").cast(MONEY)
    by_group = dim.groupBy(F.col(group).alias("__group")).agg(*[median(a).alias(f"__{a}") for a in amounts])
    overall = dim.agg(F.struct(*[median(a).alias(a) for a in amounts])).scalar()
    return (
        dim.join(by_group, F.col(group).eqNullSafe(F.col("__group")), "left")
        .withColumns({a: F.coalesce(F.col(a), F.col(f"__{a}"), overall[a]).cast(MONEY) for a in amounts})
        .drop("__group", *[f"__{a}" for a in amounts])
    )


def flag_missing(df: DataFrame) -> DataFrame:
    """Missing flags of the raw state; call before any fill."""
    gone = {
        "is_billed_missing": F.col("billed_amount").isNull(),
        "is_proc_missing": F.col("procedure_code").isNull(),
        "is_diag_missing": F.col("diagnosis_code").isNull(),
        "is_provider_missing": F.col("provider_id").isNull(),
        "is_date_missing": F.col("claim_date").isNull(),
    }
    return df.withColumns(
        gone | {"is_both_missing": F.col("billed_amount").isNull() & F.col("procedure_code").isNull()}
    )


def recover_region(df: DataFrame, providers: DataFrame) -> DataFrame:
    """Provider location as region of claims without a procedure; the cost table's region
    applies later where the procedure is known."""
    place = providers.select("provider_id", F.col("location").alias("provider_location"))
    return enrich(df, place, "provider_id", "claim_id", fixed.UNKNOWN_CODE).withColumns(
        {
            "is_total_blackout": F.col("is_proc_missing") & F.col("is_provider_missing"),
            "recovered_region": F.when(
                F.col("is_proc_missing"), F.coalesce(F.col("provider_location"), F.lit(fixed.UNKNOWN_TEXT))
            ),
        }
    )


def final_region(cost_region: Column, provider_location: Column) -> Column:
    return F.coalesce(cost_region, provider_location, F.lit(fixed.UNKNOWN_TEXT))


def stamp(df: DataFrame, version: str = SILVER_VERSION, layer: str | None = None) -> DataFrame:
    df = df.withColumn("cleaned_at", F.current_timestamp()).withColumn("silver_version", F.lit(version))
    return df if layer is None else df.withColumn("_silver_layer", F.lit(layer))


def silver_providers(providers: DataFrame) -> DataFrame:
    cleaned = standardise(drop_ingest_columns(providers), ["provider_id"], ["doctor_name", "specialty", "location"])
    cleaned = keep_first(cleaned, "provider_id", ["doctor_name", "specialty", "location"])
    return fill(cleaned, ["specialty", "location"], fixed.UNKNOWN_TEXT)


def silver_diagnosis(diagnosis: DataFrame) -> DataFrame:
    cleaned = standardise(drop_ingest_columns(diagnosis), ["diagnosis_code"], ["category"])
    cleaned = cleaned.withColumn("severity", severity_level(F.col("severity")))
    cleaned = keep_first(cleaned, "diagnosis_code", ["category", "severity"])
    return fill(cleaned, ["category"], fixed.UNKNOWN_TEXT)


def silver_cost(cost: DataFrame) -> DataFrame:
    cleaned = standardise(drop_ingest_columns(cost), ["procedure_code"], ["region"]).withColumns(
        {"average_cost": parse_amount("average_cost"), "expected_cost": parse_amount("expected_cost")}
    )
    cleaned = keep_first(cleaned, "procedure_code", ["average_cost", "expected_cost", "region"])
    return fill(impute_dimension_median(cleaned, "region", ["expected_cost", "average_cost"]), ["region"], fixed.UNKNOWN_TEXT)


def standard_claims(claims: DataFrame, order: list[str]) -> DataFrame:
    """Deduplicated claims with canonical codes, typed dates and no negative amounts."""
    cleaned = standardise(drop_ingest_columns(claims), CODE_COLUMNS)
    cleaned = keep_first(cleaned, "claim_id", order)
    return cleaned.withColumn("billed_amount", negative_to_null(parse_amount("billed_amount")))


def silver_claims(standard: DataFrame, clean_providers: DataFrame) -> DataFrame:
    """Flags, imputation, sentinels, region and first risk score of standardised claims.

    ``standard`` is read three times (rows, group medians, overall median): pass a table, not
    the deduplication itself.
    """
    from claimloom.operators.risk import pre_risk_score

    imputed = impute_median(flag_missing(standard), "procedure_code", ["billed_amount"])
    filled = fill(imputed, ["diagnosis_code", "procedure_code", "provider_id"], fixed.UNKNOWN_CODE)
    return recover_region(filled, clean_providers).withColumn("pre_risk_score", pre_risk_score())


def enrich_with_defaults(
    claims: DataFrame, dim: DataFrame, key: str, text_defaults: list[str], amount_defaults: list[str]
) -> DataFrame:
    """Left join where unmatched texts become UNKNOWN and unmatched amounts 0.00."""
    joined = enrich(claims, dim, key, "claim_id", fixed.UNKNOWN_CODE)
    return joined.withColumns(
        {c: F.coalesce(F.col(c), F.lit(fixed.UNKNOWN_CODE)) for c in text_defaults}
        | {c: F.coalesce(F.col(c), F.lit(0).cast(MONEY)) for c in amount_defaults}
    )
