"""Language, quality and toxicity: accuracy on held-out rows, and what edge cases give."""

import random

from pyspark.sql import functions as F

from claimloom.llm import language, quality, toxicity

FOLDER = "/root/testdata/sf0.01"


def _edge(spark):
    rows = [(1, None, "a", 1.0), (2, "", "a", 1.0), (3, "12 ?! 34", "a", 1.0), (4, "the same", "b", 2.0), (4, "the same", "b", 2.0), (None, "the " * 30_000, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang_pred string, score double")


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("held", language.held_out(F.col("doc_id"), 3, 1))
    learned = language.prototypes(docs.where("NOT held"), "text", "lang")
    found = language.identified(docs, "text", learned)
    right, rows, low, high = found.where("held AND lang IS NOT NULL").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.min("score"), F.max("score")).first()
    assert rows > 250 and right > 0.97 and 0 <= low <= high <= 1
    edge = {r.doc_id: r for r in language.identified(_edge(spark), "text", learned).collect()}
    assert all(edge[i].lang_pred == "und" and edge[i].score == 0 and edge[i].rejected for i in (1, 2, 3))
    assert edge[4].lang_pred in learned and edge[None].lang_pred == "en"
    assert language.identified(_edge(spark).limit(0), "text", learned).collect() == []
    none = language.prototypes(docs.limit(0), "text", "lang")
    assert none == {} and {r.lang_pred for r in language.identified(_edge(spark), "text", none).collect()} == {"und"}


def test_prototypes_do_not_depend_on_the_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a, b = (language.prototypes(docs.repartition(n), "text", "lang") for n in (1, 3))
    assert a.keys() == b.keys() and all((a[k] == b[k]).all() for k in a)


def test_quality_and_toxicity_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = language.held_out(F.col("doc_id"), 4, 2)
    learned = quality.model(labels.where(~held), docs, "doc_id", "text", "quality")
    rows = labels.where(held).join(quality.scored(docs, "text", learned), "doc_id").select("quality", quality.predicted().alias("p"))
    good, bad = (rows.where(f"quality = {y}").agg(F.avg("p")).first()[0] for y in (1, 0))
    assert good > 0.98 and bad < 0.15
    graded = toxicity.model(labels.where(~held), docs, "doc_id", "text", "toxic")
    rows = labels.where(held).join(toxicity.scored(docs, "text", graded).withColumnRenamed("toxic", "found"), "doc_id")
    clean, toxic = (rows.where(f"toxic = {y}").agg(F.avg(F.col("found").cast("int")), F.avg("severity")).first() for y in (0, 1))
    assert clean[0] < 0.01 and toxic[0] > 0.7 and toxic[1] > clean[1] + 1
    assert all(a <= b for a, b in zip(graded.thresholds, graded.thresholds[1:], strict=False))


def test_scores_of_edge_cases(spark):
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(1, 41)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    rng = random.Random(2)
    texts = [(i, " ".join(rng.choice(["good", "fine", "well"] if i % 2 else ["scum", "!!!!", "bad"]) for _ in range(60))) for i in range(1, 41)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for learned in (quality.model(labels, docs, "doc_id", "text", "quality"), quality.model(labels.limit(0), docs, "doc_id", "text", "quality")):
        out = quality.scored(_edge(spark), "text", learned).collect()
        assert len(out) == 6 and all(0 <= r.score <= 1 for r in out)
        assert len({r.score for r in out if r.doc_id == 4}) == 1 and out[0].score == out[1].score
        assert quality.scored(_edge(spark).limit(0), "text", learned).collect() == []
    learned = toxicity.model(labels, docs, "doc_id", "text", "toxic")
    assert {r.toxic for r in toxicity.scored(docs.where("doc_id % 2 = 0"), "text", learned).collect()} == {True}
    assert {r.toxic for r in toxicity.scored(docs.where("doc_id % 2 = 1"), "text", learned).collect()} == {False}
    nothing = toxicity.model(labels.limit(0), docs, "doc_id", "text", "toxic")
    out = toxicity.scored(_edge(spark), "text", nothing).collect()
    assert len(out) == 6 and all(r.severity < 1e-6 and not r.toxic and r.grade == 0 for r in out)
    assert toxicity.scored(_edge(spark).limit(0), "text", learned).collect() == []
