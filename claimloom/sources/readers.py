"""Scans of raw files, with lineage and privacy marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.functions import fixed_values as fixed

REJECTED = "_rejected"

CLAIMS_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("claim_id", "patient_id", "provider_id", "diagnosis_code", "procedure_code")]
    + [T.StructField("billed_amount", T.DoubleType()), T.StructField("claim_date", T.StringType()), T.StructField("denial_flag", T.IntegerType())]
)
PROVIDER_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("provider_id", "doctor_name", "specialty", "location")])
DIAGNOSIS_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("diagnosis_code", "category", "severity")])
COST_SCHEMA = T.StructType(
    [T.StructField("procedure_code", T.StringType()), T.StructField("average_cost", T.DoubleType()),
     T.StructField("expected_cost", T.DoubleType()), T.StructField("region", T.StringType())]
)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A CSV scan. With a schema, unreadable rows keep their text in ``_rejected``; without
    one Spark infers types, which costs a second pass over the files."""
    reader = spark.read.option("header", True)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    full = T.StructType([*schema.fields, T.StructField(REJECTED, T.StringType())])
    return reader.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", REJECTED).csv(path)


def with_lineage(df: DataFrame, layer: str = "bronze", phi: bool | None = None) -> DataFrame:
    """Ingestion time, source file and layer; files are known only directly after a scan."""
    marks: dict[str, Column] = {
        "_ingestion_timestamp": F.current_timestamp(), "_source_file": F.col("_metadata.file_path"), "_source_layer": F.lit(layer),
    }
    if phi is not None:
        marks["_is_phi"] = F.lit(phi)
    return df.withColumns(marks)


def tag_phi(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mark columns as protected in the schema, where it travels with the data."""
    return df.select(*[F.col(c).alias(c, metadata={"phi": True}) if c in columns else F.col(c) for c in df.columns])


def without_phi(df: DataFrame) -> DataFrame:
    return df.drop(*[f.name for f in df.schema.fields if f.metadata.get("phi")])


def normalise_headers(df: DataFrame) -> DataFrame:
    """Lower-cased, trimmed headers with ``member_id`` accepted for ``patient_id``; a missing
    required column raises before any row is read."""
    names = [c.strip().lower() for c in df.columns]
    if "member_id" in names and "patient_id" not in names:
        names[names.index("member_id")] = "patient_id"
    missing = [c for c in fixed.BATCH_COLUMNS if c not in names]
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))
    return df.toDF(*names)


def read_batch_file(spark: SparkSession, path: str) -> DataFrame:
    """An uploaded claim file, every column as text until it is checked."""
    return normalise_headers(spark.read.option("header", True).csv(path))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file with its whole content."""
    return spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True).select(
        F.element_at(F.split("_metadata.file_path", "/"), -1).alias("source_doc"), F.col("value").alias("text")
    )


def document_table(documents: DataFrame, name: str, text: str) -> DataFrame:
    """The same shape from a table of documents."""
    return documents.select(F.col(name).cast("string").alias("source_doc"), F.col(text).alias("text"))


def find_claims(gold: DataFrame, wanted: DataFrame) -> DataFrame:
    """Bulk point lookup: every wanted id with the claim's columns and whether it exists."""
    columns = ["claim_id", "provider_id", "diagnosis_code", "procedure_code", "billed_amount"]
    return wanted.join(gold.select(*columns, F.lit(True).alias("__hit")), "claim_id", "left").select(
        *columns, F.coalesce("__hit", F.lit(False)).alias("found")
    )


def find_claim(gold: DataFrame, claim_id: str) -> DataFrame:
    """One claim; the filter reaches the parquet scan and the limit stops it early."""
    return gold.where(F.col("claim_id") == claim_id).select(
        "claim_id", "provider_id", "diagnosis_code", "procedure_code", "billed_amount"
    ).limit(1)
