"""Joins and numbering that stay balanced when one key holds a large share of the rows.

Nothing here drops or samples rows. Spark's adaptive execution already splits skewed
shuffle joins; these helpers cover the shapes it cannot split: joining rows back to an
aggregate of themselves, keys that can never match, and ordered numbering in a huge group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 2_000_000
"""Rows from which a key counts as hot. A table of N rows has at most N / HOT_ROWS hot keys."""

_SPREAD = 4096

_MANY = 1 << 24
"""More partitions than any table has."""


def _all(conditions):
    return reduce(lambda a, b: a & b, conditions)


def lookup_totals(
    rows: DataFrame,
    totals: DataFrame,
    keys: list[str],
    size: str,
    spread_by: Column,
    hot_rows: int = HOT_ROWS,
    null_safe: bool = False,
) -> DataFrame:
    """Left join ``rows`` to ``totals`` (one row per key, ``size`` = rows of that key).

    Hot keys come from a broadcast whose length is bounded by the definition of hot; the
    other keys use an ordinary shuffle join. A hot or null key gets a spread number there,
    so its rows land in many partitions instead of one. ``null_safe`` treats NULL as a value.
    """
    values = [c for c in totals.columns if c not in keys]
    same = (lambda a, b: a.eqNullSafe(b)) if null_safe else (lambda a, b: a == b)

    hot = totals.where(F.col(size) >= hot_rows).select(
        *[F.col(k).alias(f"__h_{k}") for k in keys],
        *[F.col(v).alias(f"__h_{v}") for v in values],
    )
    cold = totals.where(F.col(size) < hot_rows).select(
        *[F.col(k).alias(f"__c_{k}") for k in keys],
        *[F.col(v).alias(f"__c_{v}") for v in values],
        F.lit(0).alias("__c_spread"),
    )
    settled = F.col(f"__h_{size}").isNotNull()
    if not null_safe:
        settled = settled | reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    spread = F.when(settled, 1 + F.pmod(F.xxhash64(spread_by), F.lit(_SPREAD)).cast("int")).otherwise(0)
    return (
        rows.join(F.broadcast(hot), _all(same(F.col(k), F.col(f"__h_{k}")) for k in keys), "left")
        .join(
            cold,
            (spread == F.col("__c_spread")) & _all(same(F.col(k), F.col(f"__c_{k}")) for k in keys),
            "left",
        )
        .select(
            *[F.col(c) for c in rows.columns],
            *[F.coalesce(F.col(f"__h_{v}"), F.col(f"__c_{v}")).alias(v) for v in values],
        )
    )


def enrich(
    rows: DataFrame,
    dim: DataFrame,
    key: str,
    spread_by: str,
    sentinel: str | None = None,
) -> DataFrame:
    """Left join a dimension that is unique on ``key``.

    No broadcast hint: Spark broadcasts the dimension when its measured size is under the
    threshold and shuffles otherwise. Missing and sentinel keys cannot match, so they get
    their own join values and do not pile up in one partition of the shuffled form.
    """
    right = dim.withColumnRenamed(key, "__dim_key")
    lost = F.col(key).isNull()
    if sentinel is not None:
        lost = lost | (F.col(key) == sentinel)
    spread = F.concat(F.lit("\u0001"), F.pmod(F.xxhash64(F.col(spread_by)), F.lit(_SPREAD)).cast("string"))
    row_key = F.when(lost, spread).otherwise(F.col(key))
    return rows.join(right, row_key == F.col("__dim_key"), "left").drop("__dim_key")


def apart(rows: DataFrame) -> DataFrame:
    """``rows``, with what follows in generated code of its own.

    Spark turns a chain of joins and projections into one method, and the JVM only interprets a
    method of more than 8000 bytes of bytecode, which takes several times as long. Coalescing
    to no fewer partitions moves no row and ends the chain.
    """
    return rows.coalesce(_MANY)


def number_within(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    position: Column,
    out: str,
    total: str | None = None,
    hot_rows: int = HOT_ROWS,
    slices: int = 256,
) -> DataFrame:
    """``row_number`` per key in ``order``, with hot groups cut into ordered slices.

    ``position`` is a number that never decreases along ``order``. For a hot key its
    approximate quantiles give slice bounds; each slice is numbered on its own and shifted by
    the rows in earlier slices. Any bounds give the exact numbering, so the approximation
    only decides how evenly the work is split.
    """
    sized = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    named = [F.col(k).alias(f"__k_{k}") for k in keys]
    is_key = _all(F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys)
    hot_keys = sized.where(F.col("__n") >= hot_rows).select(*named)
    # Only hot keys are sketched; with none, the adaptive plan drops this branch.
    hot = (
        rows.withColumn("__pos", position)
        .join(F.broadcast(hot_keys), is_key, "inner")
        .groupBy(*[f"__k_{k}" for k in keys])
        .agg(F.percentile_approx("__pos", [i / slices for i in range(1, slices)], 1000).alias("__cuts"))
    )
    sliced = (
        rows.withColumn("__pos", position)
        .join(F.broadcast(hot), is_key, "left")
        .withColumn(
            "__slice",
            F.when(F.col("__cuts").isNull(), F.lit(-1)).otherwise(
                F.expr("size(filter(__cuts, c -> c < __pos))")
            ),
        )
        .drop("__cuts", *[f"__k_{k}" for k in keys])
    )
    within = Window.partitionBy(*keys, "__slice").orderBy(*order)
    numbered = sliced.withColumn(out, F.row_number().over(within))
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.where(F.col("__slice") >= 0)
        .groupBy(*keys, "__slice")
        .agg(F.count(F.lit(1)).alias("__rows"))
        .withColumn("__skip", F.coalesce(F.sum("__rows").over(before), F.lit(0)))
        .select(*[F.col(k).alias(f"__o_{k}") for k in keys], F.col("__slice").alias("__o_slice"), "__skip")
    )
    result = numbered.join(
        F.broadcast(offsets),
        _all(F.col(k).eqNullSafe(F.col(f"__o_{k}")) for k in keys) & (F.col("__slice") == F.col("__o_slice")),
        "left",
    ).withColumn(out, (F.col(out) + F.coalesce(F.col("__skip"), F.lit(0))).cast("long"))
    columns = [*rows.columns, out]
    if total is not None:
        # Cold groups sit whole in one partition already; hot totals come from the sizes above.
        hot_total = sized.where(F.col("__n") >= hot_rows).select(
            *[F.col(k).alias(f"__t_{k}") for k in keys], F.col("__n").alias("__hot_total")
        )
        result = (
            result.withColumn(total, F.count(F.lit(1)).over(Window.partitionBy(*keys, "__slice")))
            .join(F.broadcast(hot_total), _all(F.col(k).eqNullSafe(F.col(f"__t_{k}")) for k in keys), "left")
            .withColumn(total, F.coalesce(F.col("__hot_total"), F.col(total)))
        )
        columns.append(total)
    return result.select(*columns)
