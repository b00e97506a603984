"""Hot keys take other paths; results stay the same."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from claimloom.functions.quantiles import exact_quantiles
from claimloom.functions.skew import lookup_totals, number_within


def rows(spark, n=3000):
    rng = random.Random(7)
    data = [("hot" if i % 3 == 0 else None if i % 17 == 0 else f"k{rng.randrange(400)}", rng.randrange(500), i) for i in range(n)]
    return spark.createDataFrame(data, "k string, t long, id long")


def test_lookup_totals_matches_plain_join(spark):
    df = rows(spark)
    totals = df.groupBy("k").agg(F.count("*").alias("n"), F.sum("t").alias("s"))
    for limit in (1, 50, 10**9):
        got = {r.id: (r.n, r.s) for r in lookup_totals(df, totals, ["k"], "n", F.col("id"), limit).collect()}
        want = {r.id: (r.n, r.s) if r.k is not None else (None, None) for r in df.join(totals.withColumnRenamed("k", "kk"), F.col("k") == F.col("kk"), "left").collect()}
        assert got == want


def test_number_within_matches_row_number(spark):
    df = rows(spark)
    want = {r.id: r.rn for r in df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("t", "id"))).collect()}
    for limit in (100, 10**9):
        got = {r.id: r.rn for r in number_within(df, ["k"], ["t", "id"], F.col("t"), "rn", hot_rows=limit, slices=8).collect()}
        assert got == want


def test_exact_quantiles_match_sorted_ranks(spark):
    rng = random.Random(3)
    data = [(rng.choice(["a", "b", None]), round(rng.uniform(-5000, 90000), 2)) for _ in range(2000)]
    df = spark.createDataFrame(data, "g string, x double").withColumn("x", F.col("x").cast("decimal(18,2)"))
    got = {r.g: (float(r.q1), float(r.mid)) for r in exact_quantiles(df, ["g"], "x", {"q1": 0.25, "mid": 0.5}).collect()}
    for g in ("a", "b", None):
        xs = sorted(x for k, x in data if k == g)
        assert got[g] == (xs[-(-len(xs) // 4) - 1], xs[-(-len(xs) // 2) - 1])
