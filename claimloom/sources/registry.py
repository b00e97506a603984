"""Stored models: fitted once for the same rows and setting, then loaded.

A model lies in the shared folder under a hash of its name, its setting and the content of its training rows. Its card (a one-row table) is written after the
model, so a model whose writing broke off is not found and is fitted again.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.sources.scratch import new_path, shared_folder


def content(rows: DataFrame) -> str:
    """What the rows are, whatever their order: their number and the sum of their hashes."""
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).alias("h")).first()
    return f"{found.n}:{found.h}"


def fitted(spark: SparkSession, name: str, setting: dict, rows: DataFrame, fit: Callable[[], tuple[PipelineModel, dict]]) -> tuple[PipelineModel, dict]:
    """The model and the notes that ``fit`` returns for it; loaded if they were stored for the same name, setting and rows."""
    key = hashlib.sha256(json.dumps([name, setting, sorted(rows.columns), content(rows)], sort_keys=True, default=str).encode()).hexdigest()
    cards = f"{shared_folder(spark)}/claimloom/models/{key}"
    try:
        card = spark.read.schema("model string, notes string").parquet(cards).first()
    except AnalysisException:
        card = None
    if card is None:
        model, notes = fit()
        path = new_path(spark, name)
        model.write().save(path)
        spark.createDataFrame([(path, json.dumps(notes))], "model string, notes string").coalesce(1).write.mode("overwrite").parquet(cards)
        return model, notes
    return PipelineModel.load(card.model), json.loads(card.notes)
