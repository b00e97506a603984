"""Model training, evaluation and attribution queries.

Trained models run their whole search here: every draw of DRAWS over the grids of ``models.candidates`` and five stratified
folds, on all training rows. A model is fitted once for the same rows and setting, and loaded by the other queries.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.functions import fixed_values as fixed
from claimloom.functions.numeric import half_up as spark_half_up
from claimloom.operators import attribution as at
from claimloom.operators import models as m
from claimloom.plans.catalog import Entry
from claimloom.plans.scoring_sql import INTERCEPT, WEIGHTS, case, d
from claimloom.plans.silver import Medallion
from claimloom.plans.sql_text import half_up, query, quote
from claimloom.functions.fixed_values import REASON_TEXTS
from claimloom.sources.scratch import written


def frame(s):
    return written(m.training_frame(written(Medallion(s).gold, "gold_features")), "training_frame")


def gold(s):
    return written(Medallion(s).gold, "gold_features")


def _find(name):
    return next(c for c in m.candidates() if c.name == name)


#: Draws of each random search; a grid with fewer settings is searched whole, one without a grid is fitted as it is.
DRAWS = {"logistic_regression": 1, "random_forest": 20, "boosted_trees": 30, "linear_svc": 15, "boosted_trees_leafy": 30}
N_FOLDS = 5


def fit(df, name):
    return m.search(_find(name), df.where("is_train"), DRAWS[name], N_FOLDS)


def board_row(name):
    def run(s):
        df = frame(s)
        return m.evaluate(fit(df, name), df.where(~F.col("is_train")))

    return run


def _leaderboard(s):
    df = frame(s)
    test = df.where(~F.col("is_train"))
    return m.leaderboard([m.evaluate(fit(df, n), test) for n in DRAWS])


def _importances(s):
    return m.importances(fit(frame(s), "random_forest").model, s.spark)


def _inference(s):
    df = frame(s)
    scored = m.predict(fit(df, "logistic_regression").model, df)
    denial = F.lit(1.0) - F.col("p_approved")
    return scored.select("claim_id", denial.alias("denial_probability"), at.inference_risk(denial).alias("risk_level"), F.when(F.col("prediction") == 0, "DENIED").otherwise("APPROVED").alias("decision"))


def _tree_attribution(s):
    df = frame(s)
    return m.tree_attribution(df, fit(df, "boosted_trees").model)


def _shallow_forest(df):
    """A forest small enough to explain for every claim: the searched one has leaves by the hundred thousand."""
    shallow = _find("random_forest")
    shallow.grid = {"numTrees": [50], "maxDepth": [5]}
    return m.search(shallow, df.where("is_train"), 1, N_FOLDS)


def _additivity(s):
    df = frame(s)
    return m.additivity(df, _shallow_forest(df).model, "random_forest").unionAll(m.additivity(df, fit(df, "boosted_trees").model, "boosted_trees"))


def _rule_predictions(s):
    p = at.logistic_probability(WEIGHTS, INTERCEPT)
    return gold(s).withColumns({"p_approved": p, "label": F.col("denial_flag").cast("double")}).withColumn("prediction", F.when(F.col("p_approved") >= 0.5, 1.0).otherwise(0.0))


PLACE = "CAST(('0x' || substr(sha256(claim_id || ':{salt}'), 1, 8)) AS BIGINT) % 1000000"
SPLIT = f"WITH x AS (SELECT claim_id, denial_flag, {PLACE.format(salt=42)} AS v FROM scored), c AS (SELECT denial_flag, quantile_disc(v, 0.8) AS cut FROM x GROUP BY 1)"
FOLDS = f"WITH x AS (SELECT claim_id, denial_flag, {PLACE.format(salt='fold')} AS v FROM scored), c AS (SELECT denial_flag, {', '.join(f'quantile_disc(v, {i / 5}) AS c{i}' for i in range(1, 5))} FROM x GROUP BY 1)"
_Z = d(INTERCEPT) + "".join(f" + {d(n)} * {d(w)}" for n, w in WEIGHTS.items())
PREDICTED = f"WITH p AS (SELECT *, {d(1)} / ({d(1)} + exp(-({_Z}))) AS p_approved FROM all_features), q AS (SELECT *, denial_flag AS label, CASE WHEN p_approved >= 0.5 THEN 1 ELSE 0 END AS prediction FROM p)"
CONFUSION = (
    "c AS (SELECT count(*) FILTER (label = 0 AND prediction = 0) AS denied_as_denied, count(*) FILTER (label = 0 AND prediction = 1) AS denied_as_approved,"
    " count(*) FILTER (label = 1 AND prediction = 0) AS approved_as_denied, count(*) FILTER (label = 1 AND prediction = 1) AS approved_as_approved FROM q)"
)


def _rate(a: str, b: str) -> str:
    return half_up(f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0)", 4)


IMPACTS = ", ".join(f"{half_up(f'{d(w)} * ({d(f)} - (SELECT avg({d(f)}) FROM all_features))', 4)} AS {f}" for f, w in WEIGHTS.items())
_TEXTS = {f"{f}{sign}": quote(REASON_TEXTS[f][i]) for f in WEIGHTS for i, sign in ((0, "-"), (1, "+"))}

ENTRIES = [
    Entry(
        "M1_stratified_split",
        lambda s: m.stratified_split(Medallion(s).labeled).select("claim_id", "is_train"),
        query(SPLIT + " SELECT claim_id, v <= cut AS is_train FROM x JOIN c USING (denial_flag)", "scored"),
    ),
    Entry(
        "M2_scaling_statistics",
        lambda s: gold(s).agg(*[spark_half_up(F.avg(F.col(f).cast("double")), 4).alias(f"mean_{f}") for f in fixed.FEATURES], *[spark_half_up(F.stddev_samp(F.col(f).cast("double")), 4).alias(f"std_{f}") for f in fixed.FEATURES]),
        query("SELECT " + ", ".join(f"{half_up(f'avg({d(f)})', 4)} AS mean_{f}, {half_up(f'stddev_samp({d(f)})', 4)} AS std_{f}" for f in fixed.FEATURES) + " FROM all_features", "all_features"),
    ),
    Entry("M3_logistic_regression", board_row("logistic_regression")),
    Entry("M4_random_forest", board_row("random_forest")),
    Entry("M5_boosted_trees", board_row("boosted_trees")),
    Entry("M6_linear_margin", board_row("linear_svc")),
    Entry("M7_boosted_trees_leafy", board_row("boosted_trees_leafy")),
    Entry(
        "M8_stratified_folds",
        lambda s: m.stratified_folds(Medallion(s).labeled).select("claim_id", "fold"),
        query(FOLDS + " SELECT claim_id, (v > c1)::INTEGER + (v > c2)::INTEGER + (v > c3)::INTEGER + (v > c4)::INTEGER AS fold FROM x JOIN c USING (denial_flag)", "scored"),
    ),
    Entry(
        "M9_metrics",
        lambda s: m.classification_metrics(_rule_predictions(s)),
        query(
            PREDICTED + ", " + CONFUSION + " SELECT *, " + _rate("denied_as_denied + approved_as_approved", "denied_as_denied + denied_as_approved + approved_as_denied + approved_as_approved")
            + " AS accuracy, " + _rate("denied_as_denied", "denied_as_denied + approved_as_denied") + " AS precision, "
            + _rate("denied_as_denied", "denied_as_denied + denied_as_approved") + " AS recall, "
            + _rate("2 * denied_as_denied", "2 * denied_as_denied + approved_as_denied + denied_as_approved") + " AS f1 FROM c",
            "all_features",
        ),
    ),
    Entry(
        "M9_roc_auc",
        lambda s: m.area_under_curve(_rule_predictions(s), "p_approved"),
        query(
            PREDICTED + ", s AS (SELECT p_approved AS s, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM q GROUP BY 1),"
            " r AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lower FROM s) SELECT "
            + half_up("sum(CAST(pos AS DOUBLE) * lower + CAST(pos AS DOUBLE) * neg * CAST(0.5 AS DOUBLE)) / (CAST(sum(pos) AS DOUBLE) * sum(neg))", 6) + " AS roc_auc FROM r",
            "all_features",
        ),
    ),
    Entry(
        "M9_class_report",
        lambda s: m.class_report(_rule_predictions(s)),
        query(
            PREDICTED + " " + " UNION ALL ".join(
                f"SELECT '{n}' AS class, {_rate('tp', 'tp + fp')} AS precision, {_rate('tp', 'tp + fn')} AS recall, {_rate('2 * tp', '2 * tp + fp + fn')} AS f1, tp + fn AS support FROM"
                f" (SELECT count(*) FILTER (label = {c} AND prediction = {c}) AS tp, count(*) FILTER (label <> {c} AND prediction = {c}) AS fp, count(*) FILTER (label = {c} AND prediction <> {c}) AS fn FROM q)"
                for c, n in ((0, "Denied(0)"), (1, "Approved(1)"))
            ),
            "all_features",
        ),
    ),
    Entry("M10_feature_importance", _importances),
    Entry("M11_leaderboard", _leaderboard),
    Entry("M12_batch_inference", _inference),
    Entry(
        "M12_fixed_weight_inference",
        lambda s: _rule_predictions(s).withColumn("d", F.lit(1.0) - F.col("p_approved")).select(
            "claim_id", spark_half_up(F.col("d"), 6).alias("denial_probability"), at.inference_risk(F.col("d")).alias("risk_level"), F.when(F.col("prediction") == 0, "DENIED").otherwise("APPROVED").alias("decision")),
        query(
            PREDICTED + ", r AS (SELECT *, CAST(1 AS DOUBLE) - p_approved AS dp FROM q) SELECT claim_id, " + half_up("dp", 6) + " AS denial_probability,"
            " CASE WHEN dp > CAST(0.6 AS DOUBLE) THEN 'HIGH' WHEN dp > CAST(0.35 AS DOUBLE) THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,"
            " CASE WHEN prediction = 0 THEN 'DENIED' ELSE 'APPROVED' END AS decision FROM r",
            "all_features",
        ),
    ),
    Entry("M13_tree_attribution", _tree_attribution),
    Entry(
        "M13_additivity",
        _additivity,
        query("SELECT unnest(['random_forest', 'boosted_trees']) AS model, claims, claims AS additive FROM (SELECT count(*) AS claims FROM all_features)", "all_features"),
    ),
    Entry(
        "M13_linear_attribution",
        lambda s: m.linear_attribution(gold(s), WEIGHTS).select("claim_id", "impacts.*"),
        query(f"SELECT claim_id, {IMPACTS} FROM all_features", "all_features"),
    ),
    Entry(
        "M14_top_reasons",
        lambda s: m.top_reasons_wide(m.linear_attribution(gold(s), WEIGHTS), F.col("impacts"), list(WEIGHTS)).select(
            "claim_id", *[f"reason_{n}_{x}" for n in (1, 2, 3) for x in ("feature", "text", "impact")]),
        query(
            f"WITH i AS (SELECT claim_id, {IMPACTS} FROM all_features), u AS (SELECT claim_id, e.p AS p, e.f AS f, e.i AS i FROM (SELECT claim_id, unnest(["
            + ", ".join(f"{{'p': {n}, 'f': '{f}', 'i': {f}}}" for n, f in enumerate(WEIGHTS)) + "]) AS e FROM i)),"
            " r AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY abs(i) DESC, p) AS n, " + case(_TEXTS, "f || CASE WHEN i < 0 THEN '-' ELSE '+' END", "NULL") + " AS t FROM u)"
            " SELECT claim_id, " + ", ".join(f"max(f) FILTER (n = {n}) AS reason_{n}_feature, max(t) FILTER (n = {n}) AS reason_{n}_text, max(i) FILTER (n = {n}) AS reason_{n}_impact" for n in (1, 2, 3))
            + " FROM r GROUP BY 1",
            "all_features",
        ),
    ),
]
