"""Session settings the jobs are written for; a cluster's own settings win."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "claimloom", master: str | None = None, cores: int = 8, shared: str | None = None) -> SparkSession:
    """``shared``: the folder for intermediate tables, one that all machines see."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    if master:
        builder = (
            builder.master(master)
            .config("spark.sql.shuffle.partitions", str(cores))
            .config("spark.driver.memory", "12g")
        )
    return builder.getOrCreate()
