"""Random Fourier features against the kernel they stand for, and a margin that needs one."""

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVC
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from claimloom.functions import fixed_values as fixed
from claimloom.operators import models
from claimloom.operators.kernel import RandomFourierFeatures


def test_inner_products_come_near_the_kernel(spark):
    x = np.random.default_rng(2).normal(size=(12, 3))
    table = spark.createDataFrame([(i, Vectors.dense(v)) for i, v in enumerate(x)], ["id", "v"])
    mapped = RandomFourierFeatures(inputCol="v", outputCol="z", width=3, gamma=0.3, size=4096).transform(table).orderBy("id").collect()
    z = np.array([r.z.toArray() for r in mapped])
    want = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(z @ z.T - want).max() < 0.08


def test_a_ring_needs_the_kernel_and_the_model_is_stored(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        values = rng.normal(size=len(fixed.FEATURES)) * 0.05
        angle, inside = rng.uniform(0, 2 * np.pi), i % 2
        radius = rng.uniform(0, 0.8) if inside else rng.uniform(1.6, 2.2)
        values[0], values[1] = radius * np.cos(angle), radius * np.sin(angle)
        rows.append((f"c{i}", *map(float, values), float(inside), 1.0, i % 5))
    df = spark.createDataFrame(rows, ["claim_id", *fixed.FEATURES, "label", "weight", "fold"]).withColumn("fold", F.col("fold").cast("int"))
    by_name = {c.name: c for c in models.candidates()}
    kernel = models.kernel_margin()
    assert len(models.draws(kernel.grid, 15)) == 15
    kernel.grid = {"C": [100.0], "gamma": ["scale", 0.1]}
    model, f1, params = models._kernel_fit(kernel, df, 2, 5, 2)
    linear = models._pipeline(by_name["linear_svc"], LinearSVC(featuresCol="features", labelCol="label", regParam=0.001)).fit(df)
    right = lambda m: models.predict(m, df).where("prediction = label").count() / len(rows)
    assert right(model) > 0.9 > 0.75 > right(linear) and f1 > 0.85
    model.write().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    a, b = (models.predict(m, df).agg(F.sum("p_approved")).first()[0] for m in (model, again))
    assert a == b
