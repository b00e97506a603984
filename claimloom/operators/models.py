"""Training, evaluation and attribution of denial classifiers with Spark ML.

The label is ``approved`` (1.0) against denied (0.0); scores are P(approved). Splits and folds
come from exact quantiles of a hash of the claim id, per class, so they are the same on any
cluster.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import fixed_values as fixed
from claimloom.functions.numeric import half_up
from claimloom.operators import tree_search
from claimloom.operators.attribution import reason_text
from claimloom.operators.kernel import RandomFourierFeatures
from claimloom.sources import registry
from claimloom.sources.scratch import new_path, written

SEED = 42
HASH_SPACE = 1_000_000
#: Neighbouring places that are first counted together: 10 000 counts at most, whatever the number of claims.
PLACES = 100


def hash_place(key: Column, salt: str) -> Column:
    """A place in [0, HASH_SPACE) that depends only on the key."""
    return (F.conv(F.substring(F.sha2(F.concat(key, F.lit(f":{salt}")), 256), 1, 8), 16, 10).cast("long") % HASH_SPACE).cast("long")


def _cuts(df: DataFrame, place: str, label: str, shares: dict[str, float]) -> DataFrame:
    """The shares' places per class. Only the places of the buckets where they lie are counted one by one: all claims would make as many counts."""
    bucket = F.floor(F.col(place) / PLACES)
    of_class = Window.partitionBy(label)
    counts = df.where(F.col(place).isNotNull()).groupBy(label, bucket.alias("__b")).agg(F.count(F.lit(1)).alias("__n"))
    upto = counts.withColumn("__upto", F.sum("__n").over(of_class.orderBy("__b"))).withColumn("__all", F.sum("__n").over(of_class))
    named = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p")) for name, p in shares.items()]))
    ranks = upto.withColumn("__w", named).withColumn("__rank", F.greatest(F.ceil(F.col("__w.p") * F.col("__all")), F.lit(1)))
    ranks = ranks.where("__rank <= __upto AND __rank > __upto - __n").select(
        F.col(label).alias("__label"), F.col("__b").alias("__at"), F.col("__w.name").alias("__name"), (F.col("__rank") - F.col("__upto") + F.col("__n")).alias("__rank")
    )
    rows = df.select(label, F.col(place).alias("__v"), bucket.alias("__b"))
    inside = rows.join(F.broadcast(ranks), F.col(label).eqNullSafe(F.col("__label")) & (F.col("__b") == F.col("__at")))
    each = inside.groupBy("__label", "__name", "__rank", "__v").agg(F.count(F.lit(1)).alias("__n"))
    each = each.withColumn("__upto", F.sum("__n").over(Window.partitionBy("__label", "__name").orderBy("__v"))).where("__rank <= __upto AND __rank > __upto - __n")
    return each.groupBy("__label").agg(*[F.max(F.when(F.col("__name") == name, F.col("__v"))).alias(name) for name in shares])


def stratified_split(df: DataFrame, label: str = "denial_flag", share: float = 0.8, salt: str = str(SEED)) -> DataFrame:
    """Adds ``is_train``: the given share of each class by hash order."""
    placed = df.withColumn("__place", hash_place(F.col("claim_id"), salt))
    cuts = _cuts(placed, "__place", label, {"__cut": share})
    return (
        placed.join(F.broadcast(cuts), F.col(label) == F.col("__label"), "left")
        .withColumn("is_train", F.col("__place") <= F.col("__cut")).drop("__place", "__cut", "__label")
    )


def stratified_folds(df: DataFrame, folds: int = 5, label: str = "denial_flag", salt: str = "fold") -> DataFrame:
    """Adds ``fold`` 0 … folds-1 with equal class shares."""
    placed = df.withColumn("__place", hash_place(F.col("claim_id"), salt))
    names = {f"__c{i}": i / folds for i in range(1, folds)}
    cuts = _cuts(placed, "__place", label, names)
    fold = reduce(lambda a, b: a + b, [F.when(F.col("__place") > F.col(c), F.lit(1)).otherwise(F.lit(0)) for c in names])
    return (
        placed.join(F.broadcast(cuts), F.col(label) == F.col("__label"), "left")
        .withColumn("fold", fold).drop("__place", "__label", *names)
    )


def with_class_weight(df: DataFrame, label: str = "denial_flag") -> DataFrame:
    """Balanced weights: training rows / (2 × training rows of the class). Held-out rows get theirs from the training rows too."""
    counts = df.where("is_train").groupBy(label).agg(F.count(F.lit(1)).alias("__n")).withColumnRenamed(label, "__label")
    total = df.where("is_train").agg(F.count(F.lit(1))).scalar()
    return df.join(F.broadcast(counts), F.col(label) == F.col("__label"), "left").withColumn(
        "weight", total / (F.col("__n") * 2.0)
    ).drop("__n", "__label")


def with_validation(df: DataFrame, label: str = "denial_flag", share: float = 0.9) -> DataFrame:
    """Marks the last tenth, by hash order, of each class's training rows: boosted trees stop early by them."""
    placed = df.withColumn("__place", hash_place(F.col("claim_id"), "inner"))
    cuts = _cuts(placed.where("is_train"), "__place", label, {"__cut": share})
    return (
        placed.join(F.broadcast(cuts), F.col(label) == F.col("__label"), "left")
        .withColumn("is_validation", F.col("is_train") & (F.col("__place") > F.col("__cut"))).drop("__place", "__cut", "__label")
    )


def training_frame(gold: DataFrame, folds: int = 5) -> DataFrame:
    """Gold features as doubles with split, fold, weight and a validation mark for early stopping.

    The same as ``stratified_split``, ``stratified_folds``, ``with_validation`` and ``with_class_weight`` in turn. Classes and places alone are written first: all cuts and counts
    come from that narrow table, and the features are read once.
    """
    places = {"__split": hash_place(F.col("claim_id"), str(SEED)), "__fold": hash_place(F.col("claim_id"), "fold"), "__inner": hash_place(F.col("claim_id"), "inner")}
    narrow = written(gold.select("denial_flag", *[p.cast("int").alias(n) for n, p in places.items()]), "places")
    names = {f"__c{i}": i / folds for i in range(1, folds)}
    split = written(_cuts(narrow, "__split", "denial_flag", {"__cut": 0.8}), "split_cuts")
    train = narrow.join(F.broadcast(split), F.col("denial_flag") == F.col("__label")).where("__split <= __cut").select("denial_flag", "__inner")
    counts = train.groupBy(F.col("denial_flag").alias("__label")).agg(F.count(F.lit(1)).alias("__n"))
    inner = _cuts(train, "__inner", "denial_flag", {"__inner_cut": 0.9})
    cuts = split.join(_cuts(narrow, "__fold", "denial_flag", names), "__label", "left").join(inner, "__label", "left").join(counts, "__label", "left")
    cuts = written(cuts.withColumn("__total", counts.agg(F.sum("__n")).scalar()), "cuts")
    typed = gold.select("claim_id", *[F.col(f).cast("double").alias(f) for f in fixed.FEATURES], "denial_flag")
    placed = typed.withColumns(places).join(F.broadcast(cuts), F.col("denial_flag") == F.col("__label"), "left")
    fold = reduce(lambda a, b: a + b, [F.when(F.col("__fold") > F.col(c), F.lit(1)).otherwise(F.lit(0)) for c in names])
    is_train = F.col("__split") <= F.col("__cut")
    return placed.select(
        *typed.columns, is_train.alias("is_train"), fold.alias("fold"), (is_train & (F.col("__inner") > F.col("__inner_cut"))).alias("is_validation"),
        (F.col("__total") / (F.col("__n") * 2.0)).alias("weight"), F.col("denial_flag").cast("double").alias("label"),
    )


@dataclass
class Candidate:
    """An estimator with the values a random search draws from."""

    name: str
    estimator: object
    grid: dict[str, list] = field(default_factory=dict)
    scaled: bool = False
    early_stop: bool = False
    #: Inverse strength of the penalty over all rows together; Spark's is per row.
    inverse_penalty: float | None = None
    #: Radial kernel by random Fourier features; the grid holds C and gamma.
    kernel: bool = False


def candidates() -> list[Candidate]:
    common = {"labelCol": "label", "weightCol": "weight"}
    boost = {"maxDepth": [3, 4, 5, 6], "stepSize": [0.03, 0.05, 0.1], "subsamplingRate": [0.6, 0.7, 0.8, 1.0], "maxIter": [50, 100, 200], "minInstancesPerNode": [1, 3, 5, 7]}
    leafy = {"maxDepth": [5, 7, 9], "stepSize": [0.03, 0.05, 0.1], "subsamplingRate": [0.7, 0.8, 1.0], "maxIter": [50, 100, 200], "minInstancesPerNode": [10, 20, 40]}
    return [
        Candidate("logistic_regression", LogisticRegression(featuresCol="features", maxIter=100, **common), {}, scaled=True, inverse_penalty=1.0),
        Candidate(
            "random_forest", RandomForestClassifier(featuresCol="features", seed=SEED, **common),
            {"numTrees": [100, 200, 300], "maxDepth": [5, 10, 15], "minInstancesPerNode": [1, 2, 4], "featureSubsetStrategy": ["sqrt", "log2", "0.5"], "minInfoGain": [0.0, 0.001], "subsamplingRate": [0.8, 1.0]},
        ),
        Candidate("boosted_trees", GBTClassifier(featuresCol="features", seed=SEED, validationTol=0.001, **common), boost, early_stop=True),
        Candidate("linear_svc", LinearSVC(featuresCol="features", maxIter=50, **common), {"regParam": [0.0001, 0.001, 0.01, 0.1]}, scaled=True),
        Candidate("boosted_trees_leafy", GBTClassifier(featuresCol="features", seed=SEED, validationTol=0.001, **common), leafy, early_stop=True),
    ]


def kernel_margin() -> Candidate:
    """A margin with a radial kernel, for ``search`` with 15 draws; no registered query waits for it."""
    estimator = LinearSVC(featuresCol="features", labelCol="label", weightCol="weight", maxIter=50, standardization=False)
    grid = {"C": [0.01, 0.1, 1.0, 10.0, 50.0, 100.0], "gamma": ["scale", "auto", 0.001, 0.01, 0.1]}
    return Candidate("kernel_svc", estimator, grid, scaled=True, kernel=True)


def _pipeline(candidate: Candidate, estimator, kernel: RandomFourierFeatures | None = None) -> Pipeline:
    assembled = VectorAssembler(inputCols=fixed.FEATURES, outputCol="raw_features" if candidate.scaled else "features")
    scaler = [StandardScaler(inputCol="raw_features", outputCol="scaled_features" if kernel else "features", withMean=True)] if candidate.scaled else []
    return Pipeline(stages=[assembled, *scaler, *([kernel] if kernel else []), estimator])


def draws(grid: dict[str, list], n: int, seed: int = SEED) -> list[dict]:
    """``n`` distinct settings drawn from the grid; one empty setting for an empty grid."""
    space = [dict(zip(grid, values)) for values in product(*grid.values())]
    return random.Random(seed).sample(space, min(n, len(space)))


@dataclass
class Fitted:
    name: str
    model: PipelineModel
    cv_f1: float
    params: dict


#: Rows of a task of a linear fit: a pass over fewer takes less time than its scheduling, and a handful of tasks add up without another stage.
LINEAR_ROWS = 125_000


def fit_rows(train: DataFrame, limit: int | None = None) -> DataFrame:
    """What a fit reads in every pass: all rows, over as many tasks as there are cores at least. With a limit, so many rows at most, first by a hash of the claim, written.

    Only rows up to the bucket of places that reaches the limit are ordered: the first rows of each of many tasks would meet in one.
    """
    cores = train.sparkSession.sparkContext.defaultParallelism
    if limit is None:
        return train if train.rdd.getNumPartitions() >= cores else train.repartition(cores)
    place = hash_place(F.col("claim_id"), "fit")
    counts = train.groupBy(F.floor(place / PLACES).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    least = counts.withColumn("upto", F.sum("n").over(Window.orderBy(F.asc_nulls_first("b")))).where(F.col("upto") >= limit).agg(F.min("b")).first()[0]
    first = train if least is None else train.where(place.isNull() | (place < (least + 1) * PLACES))
    return written(first.orderBy(place, "claim_id").limit(limit), "fit_rows").repartition(cores)


def search(candidate: Candidate, train: DataFrame, n_draws: int, folds: int = 5, parallelism: int = 4) -> Fitted:
    """Random search by F1 of the denied class over stratified folds, then the final fit; both on all training rows.

    Tree ensembles are scored by ``tree_search``, others, and those over more different rows than it holds, by Spark's cross-validation. Boosted trees stop early by the validation rows. A model
    that was fitted for the same rows and setting is loaded.
    """
    setting = {"grid": candidate.grid, "draws": n_draws, "folds": folds, "seed": SEED}

    def fit() -> tuple[PipelineModel, dict]:
        rows = fit_rows(train)
        by_trees = isinstance(candidate.estimator, (GBTClassifier, RandomForestClassifier))
        model, f1, params = (_tree_fit if by_trees else _kernel_fit if candidate.kernel else _cross_validated)(candidate, rows, n_draws, folds, parallelism)
        return model, {"cv_f1": f1, "params": params}

    model, notes = registry.fitted(train.sparkSession, candidate.name, setting, train, fit)
    return Fitted(candidate.name, model, notes["cv_f1"], notes["params"])


def _tree_fit(candidate: Candidate, rows: DataFrame, n_draws: int, folds: int, parallelism: int) -> tuple[PipelineModel, float, dict]:
    shared = tree_search.shared(rows, fixed.FEATURES)
    if shared is None:
        return _cross_validated(candidate, rows, n_draws, folds, parallelism)
    settings = draws(candidate.grid, n_draws)
    defaults = {k: candidate.estimator.getOrDefault(k) for k in ("maxDepth", "minInstancesPerNode", "subsamplingRate", "minInfoGain")}
    more = {"maxIter": candidate.estimator.getMaxIter(), "stepSize": candidate.estimator.getStepSize()} if candidate.early_stop else {"numTrees": 20, "featureSubsetStrategy": "sqrt"}
    scored = tree_search.scores(rows.sparkSession, shared, [{**defaults, **more, **s} for s in settings], folds, candidate.early_stop, SEED)
    best = scored.orderBy(F.desc("cv_f1"), "setting").first()
    final = candidate.estimator.copy()
    final.setParams(**settings[best.setting], **({"validationIndicatorCol": "is_validation"} if candidate.early_stop else {}))
    return _pipeline(candidate, final).fit(rows), float(best.cv_f1), settings[best.setting]


def _few_tasks(rows: DataFrame) -> tuple[DataFrame, int]:
    n = rows.count()
    return rows.coalesce(max(1, -(-n // LINEAR_ROWS))), n


def _cross_validated(candidate: Candidate, rows: DataFrame, n_draws: int, folds: int, parallelism: int) -> tuple[PipelineModel, float, dict]:
    estimator = candidate.estimator.copy()
    if candidate.scaled:
        rows, n = _few_tasks(rows)
    if candidate.inverse_penalty:
        estimator.setParams(regParam=1 / (candidate.inverse_penalty * max(1, n)))
    if candidate.early_stop:
        estimator.setParams(validationIndicatorCol="is_validation")
    settings = draws(candidate.grid, n_draws)
    maps = [{estimator.getParam(k): v for k, v in setting.items()} for setting in settings] or ParamGridBuilder().build()
    scorer = MulticlassClassificationEvaluator(labelCol="label", metricName="fMeasureByLabel", metricLabel=0.0)
    cv = CrossValidator(
        estimator=_pipeline(candidate, estimator), estimatorParamMaps=maps, evaluator=scorer, numFolds=folds, foldCol="fold", parallelism=parallelism, seed=SEED
    ).fit(rows)
    best = int(np.argmax(cv.avgMetrics))
    return cv.bestModel, float(cv.avgMetrics[best]), settings[best] if settings else {}


def _kernel_fit(candidate: Candidate, rows: DataFrame, n_draws: int, folds: int, parallelism: int) -> tuple[PipelineModel, float, dict]:
    """Settings of C and gamma are scored on all rows, scaled once and mapped once for each gamma. On scaled features "scale" and "auto" are 1 / width."""
    width = len(fixed.FEATURES)
    kernel = RandomFourierFeatures(inputCol="scaled_features", outputCol="features", width=width, seed=SEED)
    estimator = candidate.estimator.copy()
    settings = draws(candidate.grid, n_draws)

    def gamma(setting: dict) -> float:
        return 1 / width if isinstance(setting["gamma"], str) else setting["gamma"]

    def penalty(setting: dict, n: float) -> float:
        return 1 / (setting["C"] * max(1, n))

    rows, in_all = _few_tasks(rows)
    n = in_all * (folds - 1) / folds
    scaled = Pipeline(stages=_pipeline(candidate, estimator, kernel).getStages()[:2]).fit(rows).transform(rows)
    scorer = MulticlassClassificationEvaluator(labelCol="label", metricName="fMeasureByLabel", metricLabel=0.0)
    metrics = {}
    for g in sorted({gamma(x) for x in settings}):
        mapped, _ = _few_tasks(written(kernel.copy({kernel.gamma: g}).transform(scaled).select("features", "label", "weight", "fold"), "mapped"))
        tried = [i for i, x in enumerate(settings) if gamma(x) == g]
        maps = [{estimator.regParam: penalty(settings[i], n)} for i in tried]
        cv = CrossValidator(estimator=estimator, estimatorParamMaps=maps, evaluator=scorer, numFolds=folds, foldCol="fold", parallelism=parallelism, seed=SEED).fit(mapped)
        metrics.update(zip(tried, cv.avgMetrics, strict=True))
    best = max(metrics, key=lambda i: (metrics[i], -i))
    chosen = {estimator.regParam: penalty(settings[best], in_all), kernel.gamma: gamma(settings[best])}
    return _pipeline(candidate, estimator, kernel).fit(rows, chosen), float(metrics[best]), settings[best]


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds ``prediction`` and ``p_approved``; a margin model's score passes a sigmoid."""
    scored = model.transform(df)
    if "probability" in scored.columns:
        p = vector_to_array("probability")[1]
    else:
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-vector_to_array("rawPrediction")[1]))
    return scored.withColumn("p_approved", p)


def confusion(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    denied, called = F.col(label) == 0, F.col(prediction) == 0
    return predictions.agg(
        F.count_if(denied & called).alias("denied_as_denied"), F.count_if(denied & ~called).alias("denied_as_approved"),
        F.count_if(~denied & called).alias("approved_as_denied"), F.count_if(~denied & ~called).alias("approved_as_approved"),
    )


def classification_metrics(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy and the denied class's precision, recall and F1; 0 where undefined."""
    c = confusion(predictions, label, prediction)
    hit, missed, wrong, right = (F.col(x).cast("double") for x in c.columns)
    div = lambda a, b: half_up(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)
    return c.withColumns(
        {
            "accuracy": div(hit + right, hit + missed + wrong + right), "precision": div(hit, hit + wrong), "recall": div(hit, hit + missed),
            "f1": div(hit * 2.0, hit * 2.0 + wrong + missed),
        }
    )


def class_report(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support of both classes, one row each."""
    per = predictions.groupBy(F.col(label).cast("int").alias("l"), F.col(prediction).cast("int").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    rows = []
    for cls, name in ((0, "Denied(0)"), (1, "Approved(1)")):
        of = F.col("l") == cls
        called = F.col("p") == cls
        tp, fp, fn = (F.coalesce(F.sum(F.when(x, F.col("n"))), F.lit(0)).cast("double") for x in (of & called, ~of & called, of & ~called))
        div = lambda a, b: half_up(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)
        rows.append(per.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn")).select(
            F.lit(name).alias("class"), div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
            div(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
            div(F.col("tp") * 2.0, F.col("tp") * 2.0 + F.col("fp") + F.col("fn")).alias("f1"), (F.col("tp") + F.col("fn")).cast("long").alias("support")))
    return rows[0].unionAll(rows[1])


AUC_BUCKETS = 4096


def area_under_curve(predictions: DataFrame, score: str, label: str = "label") -> DataFrame:
    """Exact ROC AUC: counts per distinct score, summed up within score buckets and over the buckets."""
    counts = predictions.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    counts = counts.withColumn("bucket", F.floor(F.col("s") * AUC_BUCKETS))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = counts.groupBy("bucket").agg(F.sum("neg").alias("n")).select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("below"))
    inside = Window.partitionBy("bucket").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("lower", F.coalesce(F.sum("neg").over(inside), F.lit(0))).join(buckets, "bucket")
    wins = F.sum((F.col("pos") * (F.col("lower") + F.col("below"))).cast("double") + F.col("pos") * F.col("neg") * 0.5)
    return ranked.agg(half_up(F.try_divide(wins, F.sum("pos").cast("double") * F.sum("neg")), 6).alias("roc_auc"))


def evaluate(fitted: Fitted, test: DataFrame) -> DataFrame:
    """One leaderboard row of a fitted model on held-out claims."""
    scored = predict(fitted.model, test)
    auc = area_under_curve(scored, "p_approved").scalar()
    gap = F.lit(fitted.cv_f1) - F.col("f1")
    return classification_metrics(scored).select(
        F.lit(fitted.name).alias("model"), auc.alias("roc_auc"), "f1", "precision", "recall", "accuracy", F.lit(fitted.cv_f1).alias("cv_f1"),
        gap.alias("overfit_gap"), F.when(F.abs(gap) < 0.05, "healthy").otherwise("check").alias("gap_status"),
    )


def leaderboard(rows: list[DataFrame]) -> DataFrame:
    """Models ranked by ROC AUC; one row per model, so the window is a handful of rows."""
    table = reduce(DataFrame.unionAll, rows)
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("roc_auc"), "model")
    return table.withColumn("rank", F.row_number().over(order)).withColumn("selected", F.col("rank") == 1)


def importances(model: PipelineModel, spark) -> DataFrame:
    """Feature ranking of a tree model, or by |coefficient| of a linear one."""
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else np.abs(last.coefficients.toArray())
    rows = sorted(zip(fixed.FEATURES, map(float, values)), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame([(i + 1, n, v) for i, (n, v) in enumerate(rows)], "rank int, feature string, importance double")


# --- attribution ------------------------------------------------------------------------------


def linear_attribution(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Adds ``impacts``: exact contributions of a linear model, weight × (value − mean)."""
    means = df.agg(F.struct(*[F.avg(F.col(f).cast("double")).alias(f) for f in weights])).scalar()
    return df.withColumn("impacts", F.struct(*[
        half_up(F.lit(w) * (F.col(f).cast("double") - means[f]), 4).alias(f) for f, w in weights.items()
    ]))


Leaf = tuple[float, dict[int, tuple[float, float, float]]]


def _paths(nodes: dict[int, dict], value) -> list[Leaf]:
    """Leaves of a tree from its stored nodes: (value, {feature: (low, high, cover share)})."""
    leaves = []

    def visit(node: dict, bounds: dict) -> None:
        if node["leftChild"] < 0:
            leaves.append((value(node), bounds))
            return
        feature, limit = node["split"]["featureIndex"], node["split"]["leftCategoriesOrThreshold"][0]
        for child, low, high in ((nodes[node["leftChild"]], -np.inf, limit), (nodes[node["rightChild"]], limit, np.inf)):
            old = bounds.get(feature, (-np.inf, np.inf, 1.0))
            visit(child, {**bounds, feature: (max(old[0], low), min(old[1], high), old[2] * child["cover"] / node["cover"])})

    visit(nodes[0], {})
    return leaves


def ensemble_leaves(model: PipelineModel, spark) -> list[Leaf]:
    """All leaves of a random forest, worth their share of P(approved), or of boosted trees, worth their part of the margin.

    The nodes are read from the stored model; they are small plain data that ships with the tasks.
    """
    last, path = model.stages[-1], new_path(spark, "ensemble")
    last.write().save(path)
    trees: dict[int, dict[int, dict]] = {}
    boosted = isinstance(last, GBTClassificationModel)
    for row in spark.read.parquet(f"{path}/data").collect():
        node = row.nodeData.asDict(recursive=True)
        node["cover"] = node["impurityStats"][0] if boosted else sum(node["impurityStats"])
        trees.setdefault(row.treeID, {})[node["id"]] = node
    out = []
    for i, nodes in sorted(trees.items()):
        weight = last.treeWeights[i] if boosted else 1 / len(trees)
        out += _paths(nodes, lambda n, w=weight: w * (n["prediction"] if boosted else n["impurityStats"][1] / n["cover"]))
    return out


def shapley_of_leaf(x: np.ndarray, value: float, bounds: dict, out: np.ndarray) -> None:
    """Add one leaf's exact Shapley contributions for all rows of ``x`` to ``out``.

    A leaf's game is a product over its path's features: a present feature contributes whether
    the row satisfies its bounds, an absent one its cover share. The Shapley sum over subsets
    groups by size, so it needs the coefficients of a product of linear factors.
    """
    features = list(bounds)
    m = len(features)
    if m == 0:
        return
    inside = [((x[:, f] > bounds[f][0]) & (x[:, f] <= bounds[f][1])).astype(float) for f in features]
    share = [bounds[f][2] for f in features]
    weight = [1.0]
    for size in range(1, m):
        weight.append(weight[-1] * size / (m - size))
    for i, f in enumerate(features):
        poly = [np.ones(len(x))] + [np.zeros(len(x))] * (m - 1)
        for j in range(m):
            if j != i:
                poly = [share[j] * poly[0]] + [share[j] * poly[d] + inside[j] * poly[d - 1] for d in range(1, m)]
        total = sum(weight[d] * poly[d] for d in range(m)) / m
        out[:, f] += value * (inside[i] - share[i]) * total


#: Rows and leaves whose contributions are worked out together.
ROWS_AT_ONCE, LEAVES_AT_ONCE = 256, 512
#: Longest path whose contributions are tabled for every pattern of satisfied bounds: 64 patterns of 6 features, 3 KB a leaf.
TABLED_FEATURES = 6


def _leaf_tables(leaves: list[Leaf]) -> list[tuple[np.ndarray, ...]]:
    """Leaves with equally many features on their path as arrays: features, low and high bounds, cover shares, values."""
    by_size: dict[int, list[Leaf]] = {}
    for leaf in leaves:
        if leaf[1]:
            by_size.setdefault(len(leaf[1]), []).append(leaf)
    out = []
    for same in by_size.values():
        for i in range(0, len(same), LEAVES_AT_ONCE):
            part = same[i : i + LEAVES_AT_ONCE]
            low, high, share = (np.array([[b[k] for b in bounds.values()] for _, bounds in part]) for k in range(3))
            out.append((np.array([list(bounds) for _, bounds in part]), low, high, share, np.array([value for value, _ in part])))
    return out


def shapley_of_leaves(x: np.ndarray, features: np.ndarray, low: np.ndarray, high: np.ndarray, share: np.ndarray, value: np.ndarray, out: np.ndarray) -> None:
    """Add the contributions of a table of leaves to ``out``, in (leaves x path length squared) steps for a row.

    As in ``shapley_of_leaf``, but the product over all of a path's factors ``share + inside z`` is formed once, and each feature's own factor is divided out of it.
    """
    m = features.shape[1]
    at = x[:, features]
    inside = ((at > low) & (at <= high)).astype(np.float64)
    product = np.zeros((m + 1, *inside.shape[:2]))
    product[0] = 1.0
    for j in range(m):
        product[1 : j + 2] = share[:, j] * product[1 : j + 2] + inside[:, :, j] * product[: j + 1]
        product[0] *= share[:, j]
    weight = [1 / m]
    for size in range(1, m):
        weight.append(weight[-1] * size / (m - size))
    for i in range(m):
        held = inside[:, :, i] > 0
        # by share + z from the highest power down, or by share alone
        q, total = product[m], weight[m - 1] * np.where(held, product[m], product[m - 1] / share[:, i])
        for d in range(m - 1, 0, -1):
            q = product[d] - share[:, i] * q
            total = total + weight[d - 1] * np.where(held, q, product[d - 1] / share[:, i])
        given = value * (inside[:, :, i] - share[:, i]) * total
        for feature in np.unique(features[:, i]):
            out[:, feature] += given[:, features[:, i] == feature].sum(axis=1)


def pattern_table(features: np.ndarray, low: np.ndarray, high: np.ndarray, share: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, ...]:
    """The contributions of a table of leaves for every pattern of satisfied bounds: they depend on nothing else of a row.

    Returns features, bounds, contributions (leaf, pattern, place on the path) and the places' features as a 0/1 matrix.
    """
    n, m = features.shape
    patterns = (np.arange(2**m)[:, None] >> np.arange(m)) & 1
    given = np.zeros((n, 2**m, m))
    for leaf in range(n):
        held = {j: (0.0, 1.0, share[leaf, j]) for j in range(m)}  # satisfied where the pattern has a one
        shapley_of_leaf(patterns.astype(np.float64), value[leaf], held, given[leaf])
    places = np.zeros((n * m, len(fixed.FEATURES)))
    places[np.arange(n * m), features.ravel()] = 1.0
    return features, low, high, given, places


def shapley_by_pattern(x: np.ndarray, features: np.ndarray, low: np.ndarray, high: np.ndarray, given: np.ndarray, places: np.ndarray, out: np.ndarray) -> None:
    """Add the contributions of a ``pattern_table`` to ``out``: bounds are compared, the rest is looked up."""
    n, m = features.shape
    at = x[:, features]
    pattern = ((at > low) & (at <= high)) @ (1 << np.arange(m))
    out += given[np.arange(n), pattern].reshape(len(x), n * m) @ places


def tree_attribution(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Exact path-dependent Shapley values of a forest's P(approved) or of boosted trees' margin: one column ``shap_<feature>`` each, and
    ``base``, the value without any feature known. The leaves are broadcast: as many as the fitted trees have, whatever the number of claims."""
    spark = df.sparkSession
    leaves = ensemble_leaves(model, spark)
    names = [f"shap_{f}" for f in fixed.FEATURES]
    base = float(sum(value * np.prod([b[2] for b in bounds.values()]) for value, bounds in leaves))
    tables = _leaf_tables(leaves)
    tabled = [pattern_table(*t) for t in tables if t[0].shape[1] <= TABLED_FEATURES]
    shipped = spark.sparkContext.broadcast((tabled, [t for t in tables if t[0].shape[1] > TABLED_FEATURES]))

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = batch[fixed.FEATURES].to_numpy(dtype=np.float64)
            out = np.zeros_like(x)
            for start in range(0, len(x), ROWS_AT_ONCE):
                rows, given = x[start : start + ROWS_AT_ONCE], out[start : start + ROWS_AT_ONCE]
                for table in shipped.value[0]:
                    shapley_by_pattern(rows, *table, given)
                for table in shipped.value[1]:
                    shapley_of_leaves(rows, *table, given)
            yield pd.concat([batch[["claim_id"]].reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1).assign(base=base)

    schema = "claim_id string, " + ", ".join(f"{n} double" for n in names) + ", base double"
    rows = df.select("claim_id", *[F.col(f).cast("double").alias(f) for f in fixed.FEATURES])
    # few files would leave most cores idle: the work for a row is large
    return rows.repartition(spark.sparkContext.defaultParallelism * 4).mapInPandas(explain, schema)


def additivity(df: DataFrame, model: PipelineModel, name: str, tolerance: float = 1e-9) -> DataFrame:
    """Claims, and how many of them have contributions that add up to what the model gives."""
    scored = model.transform(df)
    column = "rawPrediction" if isinstance(model.stages[-1], GBTClassificationModel) else "probability"
    given = scored.select("claim_id", vector_to_array(column)[1].alias("__given"))
    total = reduce(Column.__add__, [F.col(f"shap_{f}") for f in fixed.FEATURES], F.col("base"))
    both = tree_attribution(df, model).select("claim_id", total.alias("__sum")).join(given, "claim_id")
    return both.agg(F.lit(name).alias("model"), F.count(F.lit(1)).alias("claims"), F.count_if(F.abs(F.col("__sum") - F.col("__given")) < tolerance).alias("additive"))


def top_reasons_wide(df: DataFrame, impacts: Column, features: list[str], top: int = 3) -> DataFrame:
    """The strongest features by |impact| as ``reason_<n>_*`` columns; ties keep feature order."""
    entries = F.array(*[
        F.struct((-F.abs(impacts[f])).alias("s"), F.lit(i).alias("i"), F.lit(f).alias("feature"), impacts[f].alias("impact")) for i, f in enumerate(features)
    ])
    ranked = df.withColumn("__top", F.slice(F.array_sort(entries), 1, top))
    columns = {}
    for n in range(top):
        entry = F.col("__top")[n]
        columns[f"reason_{n + 1}_feature"] = entry["feature"]
        columns[f"reason_{n + 1}_text"] = reason_text(entry["feature"], entry["impact"])
        columns[f"reason_{n + 1}_impact"] = entry["impact"]
    return ranked.withColumns(columns).drop("__top")
