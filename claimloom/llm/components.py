"""Connected components of a graph too large for one machine: alternating large and small stars.

Every step looks up a node's smallest neighbour, counted before the shuffle, and hangs the others below it; no
neighbourhood is gathered. Each step's edges are written to the shared folder. Before each step the edges are
looked at: stars need no further step, so stars to which few edges were added are soon stars again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.sources.scratch import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node hangs below one other at most, and has none below it if it does; ``a`` is the larger end of each edge."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("up")), F.struct(F.col("b").alias("node"), F.lit(None).alias("up")))).alias("e")).select("e.*")
    nodes = ends.groupBy("node").agg(F.min("up").alias("x"), F.max("up").alias("y"), F.max(F.col("up").isNull()).alias("above"))
    return not nodes.agg(F.count_if(F.expr("x <> y OR x IS NOT NULL AND above"))).first()[0]


def stars(edges: DataFrame) -> DataFrame:
    """a, b: every node that is connected with a smaller one, and the smallest of its component. ``edges`` (a, b) are read several times."""
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    steps = 0
    while not _all_stars(now):
        now = written(_small_star(_large_star(now)).where("a <> b").distinct(), "edges")
        steps += 1
    return now if steps else now.distinct()


def with_roots(found: DataFrame) -> DataFrame:
    """node, component of every node of ``stars``, the smallest ones included."""
    return found.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        found.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (its smallest node) of every node that has an edge to another."""
    return with_roots(stars(written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges")))
