"""Cleaning and conformance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.functions import fixed_values as fixed
from claimloom.operators import clean as c
from claimloom.plans.catalog import Entry
from claimloom.plans.silver import AS_OF, COPY_ORDER, Medallion
from claimloom.plans.sql_text import query


def _plain(df):
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.select(
        *[
            F.col(n).cast("double").alias(n) if t.startswith("decimal") else F.col(n).cast("string").alias(n) if t in ("date", "timestamp_ntz") else F.col(n)
            for n, t in kinds.items()
        ]
    )


CODES = "claim_id, patient_id, provider_id, diagnosis_code, procedure_code"
FLAGS = "is_billed_missing, is_proc_missing, is_diag_missing, is_provider_missing, is_date_missing, is_both_missing"


def _messy(s):
    """Claims with padded, lower-cased codes and text amounts and dates, some unparseable."""
    return s.claims.select(
        F.concat(F.lit("  "), F.lower("claim_id"), F.lit(" ")).alias("claim_id"), "row_key",
        F.concat(F.lower("diagnosis_code"), F.lit(" ")).alias("diagnosis_code"),
        F.when(F.col("return_flag") == "R", F.lit("n/a")).otherwise(F.col("billed_amount").cast("string")).alias("billed_text"),
        F.when(F.col("order_status") == "P", F.date_format("claim_date", "dd/MM/yyyy")).otherwise(F.col("claim_date").cast("string")).alias("date_text"),
    )


ENTRIES = [
    Entry(
        "C1_drop_ingest_columns",
        lambda s: c.drop_ingest_columns(
            s.diagnosis.join(s.claims.select("diagnosis_code", "claim_id"), "diagnosis_code").withColumns(
                {"ingestion_time": F.current_timestamp(), "source_file": F.lit("claims.csv")}
            )
        ),
        query("SELECT c.diagnosis_code, category, severity, claim_id FROM diagnosis d JOIN claims c ON c.diagnosis_code = d.diagnosis_code", "claims", "diagnosis"),
    ),
    Entry(
        "C2_keep_first",
        lambda s: _plain(c.keep_first(s.claims, "claim_id", COPY_ORDER).select("claim_id", "row_key", "billed_amount", "claim_date")),
        query(
            "SELECT claim_id, row_key, CAST(billed_amount AS DOUBLE) AS billed_amount, CAST(claim_date AS VARCHAR) AS claim_date FROM claims"
            " QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY row_key) = 1",
            "claims",
        ),
    ),
    Entry(
        "C3_keep_latest",
        lambda s: c.keep_latest(s.claims, "claim_id", "submitted_at", COPY_ORDER).select("claim_id", "row_key"),
        query(
            "SELECT claim_id, row_key FROM claims QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY submitted_at DESC NULLS LAST, row_key) = 1",
            "claims",
        ),
    ),
    Entry(
        "C4_standardise",
        lambda s: c.standardise(_messy(s), ["claim_id", "diagnosis_code"]).select("claim_id", "diagnosis_code", "row_key"),
        query("SELECT claim_id, diagnosis_code, row_key FROM claims", "claims"),
    ),
    Entry(
        "C5_severity_level",
        lambda s: s.claims.select("claim_id", "row_key", c.severity_level(
            F.element_at(F.array(*[F.lit(w) for w in [" low", "Mild", "MEDIUM ", "moderate", "High", "critical", "Severe", "odd"]]),
                         (F.length("row_key") + F.ascii(F.substring("claim_id", -1, 1))).cast("int") % 8 + 1)).alias("severity")),
        query(
            "SELECT claim_id, row_key, CASE (length(row_key) + ascii(substr(claim_id, -1, 1))) % 8 WHEN 0 THEN 'Mild' WHEN 1 THEN 'Mild'"
            " WHEN 2 THEN 'Moderate' WHEN 3 THEN 'Moderate' WHEN 7 THEN 'Unknown' ELSE 'Severe' END AS severity FROM claims",
            "claims",
        ),
    ),
    Entry(
        "C6_sentinel_fill",
        lambda s: c.fill(s.claims.select("claim_id", "row_key", "provider_id", "diagnosis_code", "procedure_code"), ["provider_id", "diagnosis_code", "procedure_code"], "UNKNOWN"),
        query(
            "SELECT claim_id, row_key, coalesce(provider_id, 'UNKNOWN') AS provider_id, coalesce(diagnosis_code, 'UNKNOWN') AS diagnosis_code,"
            " coalesce(procedure_code, 'UNKNOWN') AS procedure_code FROM claims",
            "claims",
        ),
    ),
    Entry(
        "C7_typed_parse",
        lambda s: _plain(_messy(s).select("row_key", F.trim(F.upper("claim_id")).alias("claim_id"), c.parse_amount("billed_text").alias("billed_amount"), c.parse_date("date_text").alias("claim_date"))),
        query(
            "SELECT row_key, claim_id, CASE WHEN return_flag <> 'R' THEN CAST(billed_amount AS DOUBLE) END AS billed_amount,"
            " CASE WHEN order_status <> 'P' THEN CAST(claim_date AS VARCHAR) END AS claim_date FROM claims",
            "claims",
        ),
    ),
    Entry(
        "C8_negative_amounts",
        lambda s: _plain(s.claims.select(
            "claim_id", "row_key", c.negative_to_null(F.col("billed_amount")).alias("or_null"), c.missing_to_zero(F.col("billed_amount")).alias("or_zero"))),
        query(
            "SELECT claim_id, row_key, CAST(CASE WHEN billed_amount >= 0 THEN billed_amount END AS DOUBLE) AS or_null,"
            " CAST(CASE WHEN billed_amount > 0 THEN billed_amount ELSE 0 END AS DOUBLE) AS or_zero FROM claims",
            "claims",
        ),
    ),
    Entry(
        "C9_median_imputation",
        lambda s: _plain(c.impute_median(Medallion(s).standard, "procedure_code", ["billed_amount"]).select("claim_id", "billed_amount")),
        query("SELECT claim_id, CAST(billed_amount AS DOUBLE) AS billed_amount FROM silver_claims", "silver_claims"),
    ),
    Entry(
        "C9_cost_imputation",
        lambda s: _plain(Medallion(s).cost),
        query(
            "SELECT procedure_code, CAST(average_cost AS DOUBLE) AS average_cost, CAST(expected_cost AS DOUBLE) AS expected_cost, region FROM silver_cost",
            "silver_cost",
        ),
    ),
    Entry(
        "C10_missing_flags",
        lambda s: c.flag_missing(c.standard_claims(s.claims, COPY_ORDER)).select("claim_id", *FLAGS.split(", ")),
        query(f"SELECT claim_id, {FLAGS} FROM silver_claims", "silver_claims"),
    ),
    Entry(
        "C11_region_recovery",
        lambda s: Medallion(s).claims.select("claim_id", "provider_location", "recovered_region", "is_total_blackout"),
        query("SELECT claim_id, provider_location, recovered_region, is_total_blackout FROM silver_claims", "silver_claims"),
    ),
    Entry(
        "C11_final_region",
        lambda s: c.enrich(
            Medallion(s).claims.select("claim_id", "procedure_code", "provider_location"),
            Medallion(s).cost.select("procedure_code", F.col("region").alias("cost_region")), "procedure_code", "claim_id", fixed.UNKNOWN_CODE,
        ).select("claim_id", c.final_region(F.col("cost_region"), F.col("provider_location")).alias("final_region")),
        query(
            "SELECT claim_id, coalesce(co.region, provider_location, 'Unknown') AS final_region FROM silver_claims s"
            " LEFT JOIN silver_cost co ON s.procedure_code = co.procedure_code",
            "silver_claims", "silver_cost",
        ),
    ),
    Entry(
        "C12_enrich_with_defaults",
        lambda s: _plain(c.enrich_with_defaults(
            s.claims.select("claim_id", "row_key", "procedure_code"), s.cost, "procedure_code", ["region"], ["average_cost", "expected_cost"])),
        query(
            "SELECT claim_id, row_key, c.procedure_code, CAST(coalesce(average_cost, 0) AS DOUBLE) AS average_cost,"
            " CAST(coalesce(expected_cost, 0) AS DOUBLE) AS expected_cost, coalesce(region, 'UNKNOWN') AS region"
            " FROM claims c LEFT JOIN cost co ON c.procedure_code = co.procedure_code",
            "claims", "cost",
        ),
    ),
    Entry(
        "C13_version_stamp",
        lambda s: c.stamp(s.claims.select("claim_id", "row_key"), layer="silver").withColumn("stamped", F.col("cleaned_at").isNotNull()).drop("cleaned_at"),
        query("SELECT claim_id, row_key, '1.0' AS silver_version, 'silver' AS _silver_layer, true AS stamped FROM claims", "claims"),
    ),
]
