"""Profiling and data-quality checks: each is one pass over its table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.functions.numeric import exact_avg, half_up, percent
from claimloom.functions.quantiles import exact_quantiles
from claimloom.functions.skew import HOT_ROWS, lookup_totals

EXTREME_AMOUNT = 100_000


def _total() -> Column:
    return F.count(F.lit(1))


def _long(one_row: DataFrame, structs: list[Column]) -> DataFrame:
    """One row of wide aggregates to one row per entry."""
    return one_row.select(F.explode(F.array(*structs)).alias("__e")).select("__e.*")


QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def amount_profile(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, standard deviation, extremes and exact quartiles of an amount: one row."""
    value = F.col(column).cast("double")
    stats = df.agg(
        F.lit(column).alias("column_name"), F.count(column).alias("rows"), exact_avg(F.col(column), 4).alias("mean"),
        half_up(F.stddev_samp(value), 4).alias("stddev"), F.min(value).alias("smallest"), F.max(value).alias("largest"),
    )
    quartiles = exact_quantiles(df, [], column, QUARTILES).select(*[F.col(n).cast("double").alias(n) for n in QUARTILES], F.lit(column).alias("column_name"))
    return stats.join(quartiles, "column_name", "left")


def column_profile(df: DataFrame, exact: bool = False) -> DataFrame:
    """Rows, nulls, distinct count (approximate unless ``exact``), smallest and largest value of every column."""
    distinct = F.count_distinct if exact else F.approx_count_distinct
    wide = df.agg(
        _total().alias("rows"),
        *[F.count(c).alias(f"n_{c}") for c in df.columns],
        *[distinct(c).alias(f"d_{c}") for c in df.columns],
        *[F.min(c).cast("string").alias(f"lo_{c}") for c in df.columns],
        *[F.max(c).cast("string").alias(f"hi_{c}") for c in df.columns],
    )
    entries = [
        F.struct(
            F.lit(c).alias("column_name"), F.col("rows"), (F.col("rows") - F.col(f"n_{c}")).alias("null_count"),
            F.col(f"d_{c}").alias("distinct_count"), F.col(f"lo_{c}").alias("smallest"), F.col(f"hi_{c}").alias("largest"),
        )
        for c in df.columns
    ]
    return _long(wide, entries)


def range_checks(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count_if(F.col("billed_amount") < 0).alias("negative_billed_amounts"),
        F.count_if(F.col("billed_amount") > EXTREME_AMOUNT).alias("high_billed_amounts"),
    )


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return (
        df.groupBy(key).agg(_total().alias("duplicate_count")).where(F.col("duplicate_count") > 1)
        .orderBy(F.desc("duplicate_count"), key)
    )


def volume_overview(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Counts of rows and distinct ids, and the date span.

    Exact distinct counts shuffle every id; ``approximate`` trades about 2 % error for one
    small sketch per task.
    """
    distinct = (lambda c: F.approx_count_distinct(c, 0.02)) if approximate else F.countDistinct
    return df.agg(
        _total().alias("total_claims"),
        distinct("claim_id").alias("unique_claims"),
        distinct("patient_id").alias("unique_patients"),
        distinct("provider_id").alias("unique_providers"),
        F.min("claim_date").cast("string").alias("date_from"),
        F.max("claim_date").cast("string").alias("date_to"),
    )


def null_percentages(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row, one percentage per column."""
    return df.agg(*[percent(F.count_if(F.col(c).isNull()), _total(), 2).alias(f"{c}_null_pct") for c in columns])


def null_report(df: DataFrame, columns: list[str], places: int = 1) -> DataFrame:
    """One row per column from a single scan."""
    wide = df.agg(_total().alias("__rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    entries = [
        F.struct(
            F.lit(c).alias("column_name"), F.col(c).alias("null_count"),
            percent(F.col(c), F.col("__rows"), places).alias("null_pct"),
        )
        for c in columns
    ]
    return _long(wide, entries).orderBy(F.desc("null_pct"), "column_name")


def null_analysis(df: DataFrame, columns: list[str], high: float = 5.0) -> DataFrame:
    """Null report with a HIGH mark; an empty table raises when the result is read."""
    wide = df.agg(_total().alias("__rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    rows = F.when(F.col("__rows") > 0, F.col("__rows")).otherwise(F.raise_error(F.lit("table is empty")).cast("long"))
    entries = [
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_count"), percent(F.col(c), rows, 2).alias("null_pct"))
        for c in columns
    ]
    return _long(wide, entries).withColumn("status", F.when(F.col("null_pct") > high, "HIGH").otherwise("OK"))


def null_strategy(df: DataFrame, column: str) -> DataFrame:
    counted = df.agg(_total().alias("total_rows"), F.count_if(F.col(column).isNull()).alias("null_rows"))
    return counted.withColumn("null_pct", percent(F.col("null_rows"), F.col("total_rows"), 2)).withColumn(
        "decision", F.when(F.col("null_pct") < 5, "DROP").when(F.col("null_pct") <= 15, "IMPUTE").otherwise("ESCALATE")
    )


def amount_distribution(df: DataFrame, amount: str, approximate: bool = False) -> DataFrame:
    """Five-number summary with mean and alarms; quartiles are exact unless ``approximate``."""
    base = df.agg(
        F.count(amount).alias("claims_with_amount"),
        F.count_if(F.col(amount).isNull()).alias("missing_amount"),
        F.min(amount).cast("double").alias("min_billed"),
        exact_avg(F.col(amount), 2).alias("mean"),
        F.max(amount).cast("double").alias("max_billed"),
        F.count_if(F.col(amount) < 0).alias("negative_amounts"),
        F.count_if(F.col(amount) > EXTREME_AMOUNT).alias("extreme_outliers"),
        *([F.percentile_approx(amount, [0.25, 0.5, 0.75]).alias("__q")] if approximate else []),
    )
    if approximate:
        picks = {n: F.col("__q")[i].cast("double") for i, n in enumerate(["q1", "median", "q3"])}
        return base.withColumns(picks).drop("__q")
    quartiles = exact_quantiles(df, [], amount, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    one = quartiles.select(F.struct("q1", "median", "q3")).scalar()
    return base.withColumn("__q", one).withColumns(
        {n: F.col(f"__q.{n}").cast("double") for n in ["q1", "median", "q3"]}
    ).drop("__q")


def amount_histogram(df: DataFrame, amount: str, width: int) -> DataFrame:
    return (
        df.where(F.col(amount).isNotNull())
        .groupBy((F.floor(F.col(amount) / width).cast("long") * width).alias("bucket_from"))
        .agg(_total().alias("claims"))
        .orderBy("bucket_from")
    )


def duplicated_rows(df: DataFrame, key: str, spread_by: Column, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows whose key occurs more than once, with the number of copies."""
    totals = df.groupBy(key).agg(_total().alias("dupe_count"))
    return lookup_totals(df, totals, [key], "dupe_count", spread_by, hot_rows).where(F.col("dupe_count") > 1)


def invalid_amounts(df: DataFrame, amount: str) -> DataFrame:
    return df.agg(F.count_if(F.col(amount).isNull() | (F.col(amount) <= 0)).alias("invalid_amounts"))


def outliers(df: DataFrame, amount: str, times: float = 3.0) -> DataFrame:
    """Rows above a multiple of the mean; the mean is a scalar subquery, not a driver value."""
    mean = df.agg(exact_avg(F.col(amount))).scalar()
    return df.where(F.col(amount).cast("double") > mean * times)


def label_distribution(df: DataFrame, flag: str) -> DataFrame:
    """Rows per label with share, domain check and imbalance warning for the denied label 1."""
    counts = df.groupBy(flag).agg(_total().alias("claims"))
    # The window runs over one row per label value.
    counts = counts.withColumn("pct", percent(F.col("claims"), F.sum("claims").over(Window.partitionBy(F.lit(0))), 2))
    return counts.withColumns(
        {
            "in_domain": F.coalesce(F.col(flag).isin(0, 1), F.lit(False)),
            "warning": F.when(
                F.col(flag) == 1, F.when(F.col("pct") < 5, "LOW").when(F.col("pct") > 50, "HIGH").otherwise("NONE")
            ).otherwise("NONE"),
        }
    )


def code_format(df: DataFrame, column: str) -> DataFrame:
    code = F.col(column)
    return df.agg(
        F.count_if(code.rlike("[a-z]")).alias("lowercase_codes"),
        F.count_if(code != F.trim(code)).alias("whitespace_codes"),
        F.count_if(code.isNull()).alias("null_codes"),
    )


def code_format_samples(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    """The first few rows, by claim, whose code is missing or badly written."""
    code = F.col(column)
    wrong = code.isNull() | code.rlike("[a-z]") | (code != F.trim(code))
    return df.where(wrong).select("claim_id", "row_key", column).orderBy("claim_id", "row_key").limit(n)


def key_coverage(fact: DataFrame, dim: DataFrame, key: str, name: str) -> DataFrame:
    """Distinct fact keys and how many the dimension lacks; NULL is one unmatched key."""
    keys = fact.select(key).distinct()
    known = dim.select(F.col(key).alias("__known")).distinct()
    counted = keys.join(known, F.col(key) == F.col("__known"), "left").agg(
        _total().alias("fact_keys"), F.count_if(F.col("__known").isNull()).alias("unmatched")
    )
    return counted.select(
        F.lit(name).alias("dimension"), "fact_keys", "unmatched",
        percent(F.col("fact_keys") - F.col("unmatched"), F.col("fact_keys"), 2).alias("match_rate"),
    )


def key_overlap(fact: DataFrame, dim: DataFrame, key: str, name: str) -> DataFrame:
    """Distinct keys that both sides have, and rows of the fact table that have one of them."""
    rows = fact.groupBy(key).agg(_total().alias("__rows"))
    both = rows.join(dim.select(key).distinct(), key, "inner")
    return both.agg(F.lit(name).alias("dimension"), _total().alias("shared_keys"), F.coalesce(F.sum("__rows"), F.lit(0)).alias("matched_rows"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def summary_report(df: DataFrame, flag: str) -> DataFrame:
    return df.agg(
        _total().alias("total_claims"),
        F.count_if(F.col(flag) == 1).alias("denied_claims"),
        percent(F.count_if(F.col(flag) == 1), _total(), 2).alias("denial_rate"),
        F.countDistinct("diagnosis_code").alias("diagnosis_codes"),
        F.countDistinct("procedure_code").alias("procedure_codes"),
        F.countDistinct("provider_id").alias("providers"),
    )


def key_uniqueness(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Surplus rows per primary key of several tables."""
    return union_all(
        [
            df.agg((_total() - F.countDistinct(key)).alias("dupe_pks")).select(F.lit(name).alias("tbl"), "dupe_pks")
            for name, (df, key) in tables.items()
        ]
    )


def share_by(df: DataFrame, *columns: str, count: str = "claim_count", places: int = 1) -> DataFrame:
    """Rows per value and their share; the grand total is summed over the grouped rows."""
    counts = df.groupBy(*columns).agg(_total().alias(count))
    return counts.withColumn("pct", percent(F.col(count), F.sum(count).over(Window.partitionBy(F.lit(0))), places))


def imputation_counts(silver: DataFrame) -> DataFrame:
    """NULL, not 0, where nothing was imputed."""
    flagged = lambda c: F.sum(F.when(F.col(c), F.lit(1)))
    return silver.agg(
        _total().alias("total_claims"),
        flagged("is_billed_missing").alias("billed_imputed"),
        flagged("is_proc_missing").alias("proc_unknown"),
        flagged("is_diag_missing").alias("diag_unknown"),
        flagged("is_provider_missing").alias("provider_unknown"),
        flagged("is_both_missing").alias("both_bill_and_proc_missing"),
        F.sum(F.when(F.col("recovered_region").isNotNull(), F.lit(1))).alias("region_recovered_from_provider"),
    )


def require_no_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    """The same rows; reading one with a NULL in ``columns`` fails the job."""
    guarded = {
        c: F.coalesce(F.col(c), F.raise_error(F.lit(f"null in {c}")).cast(df.schema[c].dataType)) for c in columns
    }
    return df.withColumns(guarded)


def schema_differences(df: DataFrame, expected: T.StructType) -> DataFrame:
    """Contract columns that are missing or typed differently, one row each."""
    actual = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = [
        (f.name, f.dataType.simpleString(), actual.get(f.name, "missing"))
        for f in expected.fields
        if actual.get(f.name) != f.dataType.simpleString()
    ]
    return df.sparkSession.createDataFrame(rows, "column_name string, expected string, actual string")


def unique_dimension(dim: DataFrame, key: str) -> DataFrame:
    """The dimension, refusing a repeated key: a join with the result cannot multiply rows."""
    values = [c for c in dim.columns if c != key]
    grouped = dim.groupBy(key).agg(F.min(F.struct(*values)).alias("__v"), _total().alias("__n"))
    checked = F.when(F.col("__n") == 1, F.col(key)).otherwise(
        F.raise_error(F.concat(F.lit("dimension key repeats: "), F.coalesce(F.col(key).cast("string"), F.lit("NULL"))))
    )
    return grouped.select(checked.alias(key), *[F.col(f"__v.{v}").alias(v) for v in values])


def fan_out(fact: DataFrame, dims: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows before and after each left join, from key counts instead of the joins themselves."""
    parts = []
    for name, (dim, key) in dims.items():
        copies = dim.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(_total().alias("__copies"))
        per_key = fact.groupBy(key).agg(_total().alias("__rows"))
        parts.append(
            per_key.join(copies, F.col(key) == F.col("__k"), "left").agg(
                F.sum("__rows").alias("rows_before"),
                F.sum(F.col("__rows") * F.coalesce(F.col("__copies"), F.lit(1))).alias("rows_after"),
            ).select(F.lit(name).alias("dimension"), "rows_before", "rows_after",
                     (F.col("rows_before") == F.col("rows_after")).alias("safe"))
        )
    return union_all(parts)


def silver_report(df: DataFrame) -> DataFrame:
    """Report of the wide rule table (1 denied)."""
    return df.agg(
        _total().alias("total_rows"),
        F.count_if(F.col("denial_flag") == 1).alias("denied"),
        F.count_if(F.col("denial_flag") == 0).alias("approved"),
        percent(F.count_if(F.col("denial_flag") == 1), _total(), 2).alias("denial_rate"),
        F.count_if(F.col("diagnosis_code") == "UNKNOWN").alias("unknown_diagnosis"),
        F.count_if(F.col("procedure_code") == "UNKNOWN").alias("unknown_procedure"),
        exact_avg(F.col("billed_amount"), 2).alias("avg_billed"),
    )


def class_balance(df: DataFrame, flag: str) -> DataFrame:
    counted = df.agg(F.count_if(F.col(flag) == 0).alias("denied"), F.count_if(F.col(flag) == 1).alias("approved"))
    return counted.withColumn(
        "imbalance_ratio",
        half_up(F.try_divide(F.greatest("denied", "approved").cast("double"), F.least("denied", "approved").cast("double")), 4),
    )


def kpi_card(df: DataFrame) -> DataFrame:
    return df.agg(
        _total().alias("total_claims"),
        F.countDistinct("patient_id").alias("unique_patients"),
        F.countDistinct("provider_id").alias("unique_providers"),
        half_up(F.sum("billed_amount").cast("double"), 0).alias("total_billed"),
        exact_avg(F.col("billed_amount"), 0).alias("avg_billed_per_claim"),
        F.count_if(F.col("billed_amount").isNull()).alias("missing_billed_count"),
        percent(F.count_if(F.col("billed_amount").isNull()), _total(), 1).alias("missing_billed_pct"),
        percent(F.count("billed_amount"), _total(), 1).alias("data_completeness_pct"),
    )
