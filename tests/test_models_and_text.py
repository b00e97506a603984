"""Attribution and passages against brute force."""

import itertools
import math
import re
from types import SimpleNamespace

import numpy as np
from pyspark.sql import functions as F

from claimloom.operators import models, policy_text
from claimloom.operators.extract import extract_fields


def test_leaf_contributions_match_subset_sum():
    rng = np.random.default_rng(5)
    x = rng.uniform(0, 1, (6, 4))
    bounds = {0: (-np.inf, 0.5, 0.3), 2: (0.2, np.inf, 0.8), 3: (0.1, 0.9, 0.6)}
    out = np.zeros_like(x)
    models.shapley_of_leaf(x, 2.0, bounds, out)
    names = list(bounds)
    for row in range(len(x)):
        def game(present):
            return 2.0 * math.prod(
                float(bounds[f][0] < x[row, f] <= bounds[f][1]) if f in present else bounds[f][2] for f in names)

        for f in names:
            rest = [g for g in names if g != f]
            want = sum(
                math.factorial(len(s)) * math.factorial(len(names) - len(s) - 1) / math.factorial(len(names)) * (game({*s, f}) - game(set(s)))
                for n in range(len(rest) + 1) for s in itertools.combinations(rest, n)
            )
            assert abs(out[row, f] - want) < 1e-12


def test_forest_attribution_sums_to_prediction(spark):
    from claimloom.functions import fixed_values as fixed

    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        v = [float(a) for a in rng.integers(0, 6, 12)]
        y = int(v[0] + v[9] > 5)
        rows.append((f"C{i}", *v, y, float(y), 1.0, i % 2, i % 5 == 0))
    schema = "claim_id string, " + ", ".join(f"{f} double" for f in fixed.FEATURES) + ", denial_flag int, label double, weight double, fold int, is_validation boolean"
    df = spark.createDataFrame(rows, schema)
    candidate = next(c for c in models.candidates() if c.name == "random_forest")
    candidate.grid = {"numTrees": [5], "maxDepth": [3]}
    model = models.search(candidate, df, 1, 2, 1).model
    shap = {r.claim_id: sum(r[f"shap_{f}"] for f in fixed.FEATURES) for r in models.tree_attribution(df, model).collect()}
    predicted = {r.claim_id: r.p_approved for r in models.predict(model, df).collect()}
    gaps = [predicted[k] - shap[k] for k in shap]
    assert max(gaps) - min(gaps) < 1e-9


def test_registered_queries_search_all_draws_folds_and_models(spark, monkeypatch):
    from claimloom.plans.catalog import models as registered

    class Rows:
        def where(self, condition):
            return self

    rows, searched = Rows(), {}
    grids = {c.name: c.grid for c in models.candidates()}

    def search(candidate, train, n_draws, folds=5):
        searched[candidate.name] = n_draws, folds, candidate.grid == grids[candidate.name], train is rows
        return candidate.name

    monkeypatch.setattr(models, "search", search)
    monkeypatch.setattr(models, "evaluate", lambda fitted, test: fitted)
    monkeypatch.setattr(models, "leaderboard", lambda board: board)
    monkeypatch.setattr(registered, "frame", lambda s: rows)
    monkeypatch.setattr(registered, "F", SimpleNamespace(col=lambda name: False))
    assert sorted(registered._leaderboard(None)) == sorted(grids)
    assert searched == {n: (d, 5, True, True) for n, d in {"logistic_regression": 1, "random_forest": 20, "boosted_trees": 30, "linear_svc": 15, "boosted_trees_leafy": 30}.items()}


def pack(text, limit, overlap):
    """Passages by word lists: a closed passage lends its last words to the next one."""
    def level(segment, seps):
        parts = [p.strip() for p in segment.split(seps[0]) if p.strip()]
        done, current = [], []
        for part in (p.split() for p in parts):
            if len(current) + len(part) <= limit:
                current = current + part
            elif current:
                done.append(current)
                current = (current[-overlap:] if overlap else []) + part
            else:
                done += level(" ".join(part) if len(seps) == 1 else next(p for p in parts if p.split() == part), seps[1:])
        return done + ([current] if current else [])

    return [" ".join(w) for w in level(re.sub(" {2,}", " ", text.strip()), ["\n\n", "\n", ". ", " "])]


def test_passages_match_word_lists(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = docs.select("doc_id", "text", policy_text.passages_of(F.col("text"), 20, 4).alias("p")).collect()
    assert len(got) == 200
    for r in got:
        assert [" ".join(p.split()) for p in r.p] == pack(r.text, 20, 4)


def test_extraction_of_a_letter(spark):
    text = "claim #: c12345\nPatient ID: P206\nProcedure Code: PROC1 (Echo)\nTotal Charged: $1,200.50\nDate: 03/15/2024\n"
    e = extract_fields(spark.createDataFrame([(text,)], "text string")).first().extracted
    assert (e.claim_id.value, e.patient_id.value, e.procedure_code.value) == ("c12345", "P206", "PROC1")
    assert (e.billed_amount.value, e.date.value, e.policy_id.value, e.policy_id.confidence) == (1200.5, "2024-03-15", None, 0.0)
