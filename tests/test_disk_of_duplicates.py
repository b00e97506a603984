"""Tables and shuffled rows of finished steps don't stay on disk beside those of later ones."""

import os
import time

from pyspark.sql import functions as F

from claimloom.operators import duplicates
from claimloom.plans.catalog import sources
from claimloom.sources import scratch

FIELDS = ["claim_id", "patient_id", "provider_id", "diagnosis_code", "procedure_code", "billed_amount", "claim_date", "policy_id"]


def _claims(spark, n):
    return spark.range(n).select(
        F.concat(F.lit("C"), F.col("id") % 50).alias("claim_id"), *[F.lit("x").alias(c) for c in FIELDS[1:5]], (F.col("id") % 7).cast("decimal(18,2)").alias("billed_amount"),
        F.lit("1996-01-02").alias("claim_date"), F.lit("POL001").alias("policy_id"), F.lit("1996-01-02").alias("service_date"), F.col("id").cast("string").alias("row_key"),
        F.lit("1996-01-03").alias("submitted_at"),
    )


def _names(paths):
    return sorted(p.rsplit("/", 1)[1] for p in paths if os.path.isdir(p.removeprefix("file:")))


def test_marks_leave_only_the_tables_that_are_still_read(spark):
    batch, history = _claims(spark, 300), _claims(spark, 30)
    by_steps = duplicates.with_decision(duplicates.mark_batch(duplicates.mark_history(batch, history)))
    with scratch.noted() as paths:
        got = duplicates.with_decision(duplicates.marked(batch, history))
    assert _names(paths) == ["hits", "marked_rows"]
    assert got.columns == by_steps.columns and got.exceptAll(by_steps).count() == by_steps.exceptAll(got).count() == 0 and got.where("is_blocked").count() >= 30
    with scratch.noted() as paths:
        checked = duplicates.single_check(batch, _claims(spark, 5))
    assert _names(paths) == ["checked_claims", "hits"]
    assert {r.duplicate_status for r in checked.collect()} == {"ENTIRE_DUPLICATE", "DUPLICATE_ID", "NEW"}


def test_exports_leave_their_results_and_shuffled_rows_go(spark, star):
    star.providers, star.diagnosis, star.cost
    with scratch.noted() as paths:
        counts = {r.export: r.exported for r in sources._exports(star).collect()}
    assert _names(paths) == ["batch_results"] and counts["all"] > counts["flagged"] > 0


def test_shuffled_rows_of_an_ended_write_are_removed(spark):
    folders = [str(f) for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: sum(n.startswith("shuffle_") for f in folders for _, _, names in os.walk(f) for n in names)
    scratch.remove_tables(spark, [])
    time.sleep(2)
    before = files()
    scratch.written(spark.range(20_000).repartition(7, "id").groupBy(F.col("id") % 10_000).count(), "shuffled")
    assert files() > before
    scratch.remove_tables(spark, [])
    until = time.time() + 20
    while files() > before and time.time() < until:
        time.sleep(0.2)
    assert files() <= before
