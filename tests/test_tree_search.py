"""Shared prefixes of the model search, stored models, and attribution by tables of leaves."""

import itertools

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml import Pipeline

from claimloom.operators import models, tree_search
from claimloom.sources import registry


def _rows(n=400, seed=2):
    rng = np.random.default_rng(seed)
    bins = rng.integers(0, 8, (n, 4)).astype(np.uint8)
    label = (bins[:, 0] + bins[:, 1] + rng.integers(0, 4, n) > 8).astype(float)
    return tree_search.Rows(bins, label, np.where(label > 0, 0.7, 1.6), np.arange(n) % 3, rng.random(n) < 0.2)


def _by_hand(bins, target, w, rows, depth, least_rows):
    """A tree by trying every split of every node."""
    value = np.average(target[rows], weights=w[rows])
    best = None
    if depth:
        for f in range(bins.shape[1]):
            for cut in range(8):
                left, right = rows[bins[rows, f] <= cut], rows[bins[rows, f] > cut]
                if min(len(left), len(right)) >= least_rows:
                    fall = sum((w[p] * target[p]).sum() ** 2 / w[p].sum() for p in (left, right)) - (w[rows] * target[rows]).sum() ** 2 / w[rows].sum()
                    if best is None or fall > best[0] + 1e-9:
                        best = fall, left, right
    if best is None or 2 * best[0] / w[rows].sum() <= 1e-12:
        return [(rows, value)]
    return _by_hand(bins, target, w, best[1], depth - 1, least_rows) + _by_hand(bins, target, w, best[2], depth - 1, least_rows)


@pytest.mark.parametrize("least_rows", [1, 12])
def test_a_tree_and_its_shallower_prefixes_equal_trees_by_hand(least_rows):
    r = _rows()
    found = tree_search.grown(r.bins, r.label, r.weight, np.ones(len(r.label)), [1, 2, 4], least_rows, 0.0, 4, np.random.default_rng(1))
    for depth, values in found.items():
        for rows, value in _by_hand(r.bins, r.label, r.weight, np.arange(len(r.label)), depth, least_rows):
            assert np.allclose(values[rows], value)


def test_a_shared_run_scores_as_runs_of_their_own():
    r = _rows()
    shared = {"maxDepth": 3, "stepSize": 0.1, "subsamplingRate": 0.8, "minInstancesPerNode": 2}
    together = tree_search.boosted_scores(r, 0, shared, [5, 10, 40], 7)
    assert together == {n: tree_search.boosted_scores(r, 0, shared, [n], 7)[n] for n in (5, 10, 40)}
    assert min(together.values()) > 0.6
    forest = {"minInstancesPerNode": 1, "minInfoGain": 0.0, "subsamplingRate": 1.0, "featureSubsetStrategy": "all"}
    together = tree_search.forest_scores(r, 1, forest, [(5, 3), (20, 3), (20, 6)], 7)
    assert set(together) == {(5, 3), (20, 3), (20, 6)} and min(together.values()) > 0.6
    assert together[5, 3] == tree_search.forest_scores(r, 1, forest, [(5, 3)], 7)[5, 3]


def test_boosting_stops_by_the_validation_rows():
    r = _rows()
    r.label[r.validation] = np.random.default_rng(3).integers(0, 2, r.validation.sum())
    shared = {"maxDepth": 4, "stepSize": 0.5, "subsamplingRate": 1.0, "minInstancesPerNode": 1}
    found = tree_search.boosted_scores(r, 0, shared, [20, 100, 200], 7)
    assert found[100] == found[200]


def test_every_setting_is_scored_on_every_fold(spark):
    settings = [{"maxDepth": d, "stepSize": 0.1, "subsamplingRate": 1.0, "minInstancesPerNode": 1, "maxIter": n} for d, n in itertools.product((2, 3), (5, 9))]
    got = tree_search.scores(spark, _rows(), settings, 3, True, 1).collect()
    assert sorted((r.setting, r.folds) for r in got) == [(i, 3) for i in range(4)]


def test_a_model_is_fitted_once_for_the_same_rows_and_setting(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, x double")
    fits = []

    def fit():
        fits.append(1)
        return Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="v")]).fit(rows), {"n": len(fits)}

    again = rows.orderBy("x", ascending=False).repartition(3)
    for name, setting, data, expected in (("m", {"d": 1}, rows, 1), ("m", {"d": 1}, again, 1), ("m", {"d": 2}, rows, 2), ("o", {"d": 1}, rows, 3), ("m", {"d": 1}, rows.limit(1), 4)):
        model, notes = registry.fitted(spark, name, setting, data, fit)
        assert notes == {"n": expected} and model.transform(rows).count() == 2


def test_tables_of_leaves_give_what_single_leaves_give():
    rng = np.random.default_rng(8)
    leaves = []
    for _ in range(40):
        names = rng.choice(6, rng.integers(0, 6), replace=False)
        bounds = {int(f): (float(lo), float(lo + rng.uniform(0.2, 1)), float(rng.uniform(0.05, 1))) for f, lo in zip(names, rng.uniform(-0.3, 0.7, len(names)), strict=True)}
        leaves.append((float(rng.normal()), bounds))
    x = rng.uniform(0, 1, (50, 6))
    want, got = np.zeros_like(x), np.zeros_like(x)
    for value, bounds in leaves:
        models.shapley_of_leaf(x, value, bounds, want)
    for table in models._leaf_tables(leaves):
        models.shapley_of_leaves(x, *table, got)
    assert np.allclose(got, want, atol=1e-10)
