"""Source and sink queries: each writes the whole claims through a sink and reads them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from claimloom.plans.catalog import Entry
from claimloom.plans.catalog.adjudicate import BATCH, BATCH_TABLES, batch_result, dims
from claimloom.plans.catalog.history import adjudicated
from claimloom.plans.catalog.clean import _plain
from claimloom.operators import features, history, reports
from claimloom.plans.silver import Medallion
from claimloom.plans.sql_text import query
from claimloom.sources import readers, writers
from claimloom.sources.scratch import new_path, noted, remove_tables, written

COLUMNS = ["claim_id", "patient_id", "provider_id", "diagnosis_code", "procedure_code", "billed_amount", "claim_date"]
CONTENT = (
    "SELECT claim_id, patient_id, provider_id, diagnosis_code, procedure_code, CAST(billed_amount AS DOUBLE) AS billed_amount, CAST(claim_date AS VARCHAR) AS claim_date"
)


def _csv(s, df, name):
    path = new_path(s.spark, name)
    df.write.option("header", True).csv(path)
    return path


def _claims_csv(s):
    return _csv(s, s.claims.select(*COLUMNS, F.lit(0).alias("denial_flag")), "claims_csv")


def _bronze(s, schema):
    target = new_path(s.spark, "bronze")
    rows = writers.ingest(s.spark, _claims_csv(s), target, schema, phi=True)
    return s.spark.read.parquet(target), rows


def _managed(s):
    """A managed table, a persistent view over it, and the view's content."""
    name = "claims_" + uuid.uuid4().hex
    writers.save_table(s.claims.select(*COLUMNS), name)
    try:
        s.spark.sql(f"CREATE OR REPLACE VIEW v_{name} AS SELECT * FROM {name} WHERE billed_amount IS NOT NULL")
        content = written(s.spark.table(f"v_{name}"), "view_content")
        s.spark.sql(f"DROP VIEW v_{name}")
    finally:
        s.spark.sql(f"DROP TABLE {name}")
    return content


def _temp_view(s):
    name = "claims_" + uuid.uuid4().hex
    s.claims.createOrReplaceTempView(name)
    return s.spark.sql(f"SELECT claim_id, row_key, CAST(billed_amount AS DOUBLE) AS billed_amount FROM {name} WHERE billed_amount > 100000")


def _partitioned(s):
    path = new_path(s.spark, "by_label")
    writers.write_counted(Medallion(s).labeled, path, ["denial_flag"])
    return s.spark.read.parquet(path).where("denial_flag = 0").select("claim_id", "denial_flag")


def _batch_file(s):
    odd = s.batch.select(*[F.col(c).alias(f" {('member_id' if c == 'patient_id' else c).upper()} ") for c in (
        "claim_id", "patient_id", "provider_id", "diagnosis_code", "procedure_code", "billed_amount", "service_date", "policy_id")])
    return readers.read_batch_file(s.spark, _csv(s, odd, "upload"))


def _logs(s):
    """Adjudicated claims appended to the history and audit logs, counted per action."""
    # The action needs the log's id alone, so claims meet their totals before they carry reasons and JSON.
    keyed = s.claims.withColumns({"__sent_id": F.col("claim_id"), "claim_id": F.upper(F.trim("claim_id"))})
    claims = history.audit_actions(keyed, s.history).withColumn("claim_id", F.col("__sent_id")).drop("__sent_id")
    rows = history.history_rows(adjudicated(s, claims)).withColumn("outcome", F.get_json_object("full_response", "$.outcome"))
    acted = written(rows.withColumn("audit_details", history.audit_details()).drop("outcome"), "acted")
    h, a = new_path(s.spark, "history_log"), new_path(s.spark, "audit_log")
    for _ in range(2):  # a repeated batch adds nothing
        writers.append_logs(acted, h, a, "upload-1")
    return s.spark.read.parquet(a).groupBy("action").agg(F.count("*").alias("events"))


def _exports(s):
    dims(s)  # the star's own tables stay
    with noted() as of_batch:
        rows = batch_result(s)
    results = written(rows.select("claim_id", "row_key", "status", "duplicate_type", "primary_reason", "policy_match", "next_action"), "batch_results")
    remove_tables(s.spark, of_batch)
    paths = writers.export_results(results, new_path(s.spark, "exports"))
    counts = [s.spark.read.option("header", True).csv(p).agg(F.count("*").alias("exported")).select(F.lit(n).alias("export"), "exported") for n, p in paths.items()]
    return counts[0].unionAll(counts[1]).unionAll(counts[2])


ENTRIES = [
    Entry("S1_ingest_inferred", lambda s: _bronze(s, None)[0].select(*[F.col(c).cast("string").alias(c) if c == "claim_date" else F.col(c) for c in COLUMNS]), query(CONTENT + " FROM claims", "claims")),
    Entry("S2_ingest_with_schema", lambda s: _bronze(s, readers.CLAIMS_SCHEMA)[0].where(F.col(readers.REJECTED).isNull()).select(*COLUMNS), query(CONTENT + " FROM claims", "claims")),
    Entry(
        "S2_rejected_rows",
        lambda s: _bronze(s, readers.CLAIMS_SCHEMA)[0].agg(F.count("*").alias("rows"), F.count(readers.REJECTED).alias("rejected")),
        query("SELECT count(*) AS rows, 0 AS rejected FROM claims", "claims"),
    ),
    Entry(
        "S3_lineage_columns",
        lambda s: _bronze(s, readers.CLAIMS_SCHEMA)[0].groupBy("_source_layer", "_is_phi", F.col("_source_file").endswith(".csv").alias("csv"), F.col("_ingestion_timestamp").isNotNull().alias("stamped")).agg(F.count("*").alias("rows")),
        query("SELECT 'bronze' AS _source_layer, true AS _is_phi, true AS csv, true AS stamped, count(*) AS rows FROM claims", "claims"),
    ),
    Entry(
        "S4_phi_minimised",
        lambda s: readers.without_phi(readers.tag_phi(s.providers, ["doctor_name"])).join(s.claims.select("claim_id", "row_key", "provider_id"), "provider_id"),
        query("SELECT p.provider_id, specialty, location, claim_id, row_key FROM claims c JOIN providers p ON c.provider_id = p.provider_id", "claims", "providers"),
    ),
    Entry("S5_S10_table_and_view", lambda s: _plain(_managed(s)), query(CONTENT + " FROM claims WHERE billed_amount IS NOT NULL", "claims")),
    Entry("S6_S8_checked_write", lambda s: _plain(writers.checked_write(s.claims.select(*COLUMNS), new_path(s.spark, "silver"))), query(CONTENT + " FROM claims", "claims")),
    Entry("S7_partitioned_write", _partitioned, query("SELECT claim_id, denial_flag FROM scored WHERE denial_flag = 0", "scored")),
    Entry("S9_S10_scan_and_view", _temp_view, query("SELECT claim_id, row_key, CAST(billed_amount AS DOUBLE) AS billed_amount FROM claims WHERE billed_amount > 100000", "claims")),
    Entry(
        "S11_preview",
        lambda s: s.claims.orderBy("claim_id", "row_key").limit(20).select("claim_id", "row_key"),
        query("SELECT claim_id, row_key FROM claims ORDER BY 1, 2 LIMIT 20", "claims"),
    ),
    Entry(
        "S12_summary_table",
        lambda s: written(reports.diagnosis_volume(s.claims, s.diagnosis).select("diagnosis_code", "total_claims"), "summary_claims_per_diagnosis"),
        query("SELECT diagnosis_code, count(*) AS total_claims FROM claims GROUP BY 1", "claims"),
    ),
    Entry(
        "S13_batch_file",
        lambda s: _batch_file(s).withColumn("billed_amount", F.col("billed_amount").cast("double")),
        query(
            "SELECT claim_id, patient_id, provider_id, diagnosis_code, procedure_code, CAST(billed_amount AS DOUBLE) AS billed_amount, service_date, policy_id FROM batch",
            "batch",
        ),
    ),
    Entry(
        "S14_append_logs", _logs,
        query(
            "WITH n AS (SELECT *, row_number() OVER (PARTITION BY claim_id, submitted_by ORDER BY submitted_at, row_key) AS k FROM claims)"
            " SELECT CASE WHEN k > 1 OR EXISTS (SELECT 1 FROM history h WHERE h.claim_id = n.claim_id AND h.submitted_by = n.submitted_by)"
            " THEN 'Resubmitted claim' ELSE 'Submitted claim' END AS action, count(*) AS events FROM n GROUP BY 1",
            "claims", "history",
        ),
    ),
    Entry(
        "S15_exports", _exports,
        query(
            BATCH + "SELECT 'all' AS export, count(*) AS exported FROM final UNION ALL SELECT 'flagged', count(*) FILTER (status <> 'APPROVED') FROM final"
            " UNION ALL SELECT 'exceptions', count(*) FILTER (status IN ('DUPLICATE_BLOCKED', 'INVALID_INPUT')) FROM final",
            *BATCH_TABLES,
        ),
    ),
    Entry(
        "S16_whole_text_documents",
        lambda s: readers.document_table(s.table("documents"), "doc_id", "text").select("source_doc", F.sha2("text", 256).alias("text_sha"), F.length("text").alias("chars")),
        "SELECT CAST(doc_id AS VARCHAR) AS source_doc, sha256(text) AS text_sha, length(text) AS chars FROM documents",
    ),
    Entry(
        "S17_mean_cost_fallback",
        lambda s: s.claims.select("claim_id", "row_key", "procedure_code").join(
            s.cost.select(F.col("procedure_code").alias("__p"), "expected_cost"), F.col("procedure_code") == F.col("__p"), "left"
        ).select("claim_id", "row_key", F.coalesce(F.col("expected_cost").cast("double"), features.mean_expected_cost(s.cost)).alias("expected")),
        query(
            "SELECT claim_id, row_key, coalesce(CAST(expected_cost AS DOUBLE), (SELECT CAST(sum(expected_cost) AS DOUBLE) / count(expected_cost) FROM cost)) AS expected"
            " FROM claims c LEFT JOIN cost co ON c.procedure_code = co.procedure_code",
            "claims", "cost",
        ),
    ),
    Entry(
        "S18_bulk_lookup",
        lambda s: _plain(readers.find_claims(Medallion(s).labeled, s.batch.select("claim_id").distinct())),
        query(
            "SELECT b.claim_id, s.provider_id, s.diagnosis_code, s.procedure_code, CAST(s.billed_amount AS DOUBLE) AS billed_amount, s.claim_id IS NOT NULL AS found"
            " FROM (SELECT DISTINCT claim_id FROM batch) b LEFT JOIN scored s ON b.claim_id = s.claim_id",
            "batch", "scored",
        ),
    ),
]
