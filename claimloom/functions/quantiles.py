"""Exact discrete quantiles of money without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 100
"""Currency units per coarse bucket: at most 10 000 distinct cent values each."""


def count_amounts(rows: DataFrame, keys: list[str], amount: str) -> DataFrame:
    """Rows per (key, amount), NULL amounts left out: a hot key spreads over its amounts."""
    return (
        rows.where(F.col(amount).isNotNull())
        .groupBy(*keys, F.floor(F.col(amount) / BUCKET).alias("__b"), F.col(amount).alias("__v"))
        .agg(F.count(F.lit(1)).alias("__n"))
    )


def quantiles_of_counts(counted: DataFrame, keys: list[str], probabilities: dict[str, float]) -> DataFrame:
    """One row per key with the named discrete quantiles of already counted amounts.

    Rank selection over a two-level histogram: a running count over the coarse buckets finds
    the bucket holding each rank, and only that bucket's values are ordered. Both windows are
    bounded by the value range, not by the number of rows.
    """
    by_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    buckets = (
        counted.groupBy(*keys, "__b")
        .agg(F.sum("__n").alias("__rows"))
        .withColumn("__total", F.sum("__rows").over(by_key))
        .withColumn(
            "__before",
            F.sum("__rows").over(by_key.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)),
        )
        .withColumn("__before", F.coalesce(F.col("__before"), F.lit(0)))
    )
    wanted = F.explode(
        F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p")) for name, p in probabilities.items()])
    )
    ranks = (
        buckets.withColumn("__w", wanted)
        .withColumn("__rank", F.greatest(F.ceil(F.col("__w.p") * F.col("__total")), F.lit(1)))
        .where((F.col("__rank") > F.col("__before")) & (F.col("__rank") <= F.col("__before") + F.col("__rows")))
        .select(*[F.col(k).alias(f"__q_{k}") for k in keys], F.col("__b").alias("__q_b"),
                F.col("__w.name").alias("__name"), (F.col("__rank") - F.col("__before")).alias("__rank"))
    )
    same = F.col("__b") == F.col("__q_b")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__q_{k}"))
    inside = Window.partitionBy(*keys, "__b", "__name").orderBy("__v")
    picked = (
        counted.join(ranks, same, "inner")
        .groupBy(*keys, "__b", "__name", "__rank", "__v").agg(F.sum("__n").alias("__n"))
        .withColumn("__upto", F.sum("__n").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .where((F.col("__upto") >= F.col("__rank")) & (F.col("__upto") - F.col("__n") < F.col("__rank")))
    )
    outputs = [F.max(F.when(F.col("__name") == name, F.col("__v"))).alias(name) for name in probabilities]
    return picked.groupBy(*keys).agg(*outputs) if keys else picked.agg(*outputs)


def exact_quantiles(rows: DataFrame, keys: list[str], amount: str, probabilities: dict[str, float]) -> DataFrame:
    """One row per key with the named discrete quantiles of ``amount`` (NULLs ignored)."""
    return quantiles_of_counts(count_amounts(rows, keys, amount), keys, probabilities)
