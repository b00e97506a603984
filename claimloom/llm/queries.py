"""The registered queries of the training-text operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import chat, decontaminate, hard_negatives, hyperminhash, jaccard, language, neighbours, packing, periodic, personal, quality, secrets, toxicity
from claimloom.sources.scratch import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repaired(_table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out_of_fold = language.held_out(F.col("doc_id"), 3, 1)
    learned = language.prototypes(docs.where(~out_of_fold & F.col("doc_id").isNotNull()), "text", "lang")
    found = language.identified(docs.select("doc_id", "text"), "text", learned)
    return found.select("doc_id", out_of_fold.alias("held_out"), "lang_pred", "score", "similarity", "rejected")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    proposed = written(secrets.candidates(docs, "text", "source").select("doc_id", "candidates"), "candidates")
    learned = proposed.where(~language.held_out(F.col("doc_id"), 3, 1))
    found = secrets.voted(proposed, secrets.forest(secrets.labelled_by_format(learned), secrets.examples(spark)))
    return found.select("doc_id", F.explode("findings").alias("x")).select("doc_id", "x.*")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.found(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    counts = {k: F.size(k).cast("long").alias(f"n_{k}") for k in [*personal.BASE, *personal.ADDED]}
    return found.select(
        "doc_id", *(counts[k] for k in personal.BASE), F.sha2(personal.digest(personal.BASE), 256).alias("base_sha256"),
        personal.digest([*personal.BASE, *personal.ADDED]).alias("spans"), *(counts[k] for k in personal.ADDED),
    )


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(_table(spark, sf_dir, "documents"), "doc_id", "text", size=3, percent=90)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return packing.packed(docs, "doc_id", "text", "source", groups=hyperminhash.deduplicated(docs, "doc_id", "text", size=5, percent=80))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out_of_fold = language.held_out(F.col("doc_id"), 5, 0)
    learned = toxicity.model(_table(spark, sf_dir, "labels").where(~out_of_fold), docs, "doc_id", "text", "toxic")
    return toxicity.scored(docs.withColumn("held_out", out_of_fold), "text", learned).drop("text")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out_of_fold = language.held_out(F.col("doc_id"), 4, 2)
    learned = quality.model(_table(spark, sf_dir, "labels").where(~out_of_fold), docs, "doc_id", "text", "quality")
    scored = quality.scored(docs, "text", learned)
    return scored.select("doc_id", out_of_fold.alias("held_out"), "score", quality.predicted().alias("predicted"), "difference")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(vectors, "vec_id", "embedding", vectors.where("vec_id % 20 = 0"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.marked(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", _table(spark, sf_dir, "benchmark"), "item_id", "text")
    return found.select(
        "doc_id", "n_words", decontaminate.n_hit().alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(_table(spark, sf_dir, "embeddings"), "vec_id", label, "embedding", F.col("id") % 100 == 0)


def op12_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.deduplicated(_table(spark, sf_dir, "documents"), "doc_id", "text", size=5, percent=85)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", periodic.looped(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic.collapsed(docs, "text").withColumn("best", periodic.strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )


OP10_SQL = r"""
WITH lowered AS (
  SELECT doc_id AS id, 'd' AS kind, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT item_id, 'b', regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), sized AS (
  SELECT id, w, least(13, len(w)) AS size FROM lowered WHERE kind = 'b' AND len(w) > 0
), phrases AS (
  SELECT DISTINCT id AS item_id, size, array_to_string(w[i : i + size - 1], ' ') AS phrase
  FROM (SELECT id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM sized)
), places AS (
  SELECT id AS doc_id, i, s.size, array_to_string(w[i : i + s.size - 1], ' ') AS phrase
  FROM (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM lowered WHERE kind = 'd') CROSS JOIN (SELECT DISTINCT size FROM phrases) s
  WHERE i + s.size - 1 <= len(w)
), hits AS (
  SELECT p.doc_id, p.i, p.size, q.item_id FROM places p JOIN phrases q ON p.size = q.size AND p.phrase = q.phrase
), words AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS j FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT l.id AS doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM lowered l LEFT JOIN words ON words.doc_id = l.id LEFT JOIN items ON items.doc_id = l.id WHERE l.kind = 'd'
"""

OP5_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) END AS s FROM words
), tokens AS MATERIALIZED (
  SELECT doc_id, unnest(s) AS token FROM sets
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM tokens a JOIN tokens b ON a.token = b.token AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT a, b FROM common JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * n >= 90 * (len(x.s) + len(y.s) - n)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id
FROM sets s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = s.doc_id
"""

OP11_SQL = r"""
WITH fine AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM fine a JOIN fine b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.vec_id AS negative_id, positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * positive_score <= 100 * n.score AND n.score <= positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.vec_id) QUALIFY row_number() OVER w <= 5
"""

OP12_SQL = OP5_SQL.replace("len(w) < 3", "len(w) < 5").replace("len(w) - 1)", "len(w) - 3)").replace("w[i : i + 2]", "w[i : i + 4]").replace(
    "100 * n >= 90", "100 * n >= 85"
).replace("c.component_id\n", "c.component_id, s.doc_id = c.component_id AS kept\n")

QUERIES = {"op1_chat_format": op1_chat_format, "op9_nearest_neighbours": op9_nearest_neighbours, "op6_best_fit_packing": op6_best_fit_packing, "op7_toxicity": op7_toxicity, "op3_secret_scan": op3_secret_scan, "op8_quality": op8_quality, "op4_personal_data": op4_personal_data, "op5_ngram_jaccard": op5_ngram_jaccard, "op2_language_id": op2_language_id, "op10_decontamination": op10_decontamination, "op11_hard_negatives": op11_hard_negatives, "op12_hyperminhash": op12_hyperminhash, "op13_periodic_runs": op13_periodic_runs}
SQL = {"op12_hyperminhash": OP12_SQL, "op11_hard_negatives": OP11_SQL, "op4_personal_data": personal.SQL, "op5_ngram_jaccard": OP5_SQL, "op10_decontamination": OP10_SQL}
