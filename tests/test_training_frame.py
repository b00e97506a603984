import random

from pyspark.sql import functions as F

from claimloom.functions import fixed_values as fixed
from claimloom.functions.quantiles import exact_quantiles
from claimloom.operators import models


def _gold(spark, n=4000):
    rng = random.Random(3)
    rows = [(f"C{rng.randrange(n):08d}", *[rng.choice([0, 1, 2, None]) for _ in fixed.FEATURES], rng.choice([0, 0, 1, 1, 1, None] if i % 50 == 0 else [0, 0, 1])) for i in range(n)]
    rows += rows[:40] + [(None, *r[1:]) for r in rows[:20]]
    return spark.createDataFrame(rows, "claim_id string, " + ", ".join(f"{f} int" for f in fixed.FEATURES) + ", denial_flag int")


def _by_steps(gold):
    typed = gold.select("claim_id", *[F.col(f).cast("double").alias(f) for f in fixed.FEATURES], "denial_flag")
    framed = models.with_validation(models.stratified_folds(models.stratified_split(typed), 5))
    return models.with_class_weight(framed).withColumn("label", F.col("denial_flag").cast("double"))


def test_the_frame_is_that_of_its_steps_and_reads_the_features_once(spark, tmp_path):
    _gold(spark).write.parquet(f"{tmp_path}/gold")
    gold = spark.read.parquet(f"{tmp_path}/gold")
    frame, steps = models.training_frame(gold), _by_steps(gold)
    assert frame.schema.simpleString() == steps.schema.simpleString()
    assert frame.exceptAll(steps).count() == steps.exceptAll(frame).count() == 0
    assert frame.where("is_train").count() > 3000 and frame.where("is_validation").count() > 300
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("Relation") <= 2
    empty = models.training_frame(gold.where("false"))
    assert empty.count() == 0


def test_cuts_are_the_exact_quantiles(spark):
    rows = [(k, random.Random(i).choice([i * 37 % 1000, 250, 999_999])) for i in range(700) for k in ((i % 3) or None,)] + [(5, 7), (6, None)]
    df = spark.createDataFrame(rows, "label int, place bigint")
    shares = {"low": 0.0, "half": 0.5, "most": 0.8, "all": 1.0}
    got = sorted(map(tuple, models._cuts(df, "place", "label", shares).collect()), key=str)
    assert got == sorted(map(tuple, exact_quantiles(df, ["label"], "place", shares).select("label", *shares).collect()), key=str) and len(got) == 4


def test_only_rows_near_the_limit_are_ordered_for_a_fit(spark, monkeypatch):
    df = spark.createDataFrame([(f"C{i:08d}", i) for i in range(5000)], "claim_id string, x int")
    ordered, order = [], type(df).orderBy
    monkeypatch.setattr(type(df), "orderBy", lambda self, *c: ordered.append(self) or order(self, *c))
    got = {r.claim_id for r in models.fit_rows(df, 200).collect()}
    first = ordered[0].count()
    place = models.hash_place(F.col("claim_id"), "fit")
    assert got == {r.claim_id for r in order(df, place, "claim_id").limit(200).collect()} and len(got) == 200
    assert first < 220
    assert models.fit_rows(df, 9000).count() == 5000 and models.fit_rows(df.where("false"), 10).count() == 0
