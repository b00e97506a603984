"""Corpus pipeline: raw documents to packed training bins, in five stages.

Each stage takes what the one before kept, as a table, and returns a DataFrame; all but the last return the
columns of documents. ``run`` applies them to the documents of a folder and writes each result to the shared folder.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.llm import decontaminate, jaccard, language, packing, secrets
from claimloom.sources.scratch import written

#: Words of a shingle, and the similarity in percent from which documents are near copies.
SHINGLE, SIMILAR = 5, 80
#: The columns of documents, and the struct in which others travel.
DOCUMENTS, REST = ("doc_id", "text", "lang", "source", "n_chars"), "__rest"


def _with_text(docs: DataFrame, text) -> DataFrame:
    """A new text, and its length."""
    changed = docs.withColumn("text", text)
    return changed.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def _apart(stage):
    """Columns that ``documents`` doesn't have travel in one struct, so that none meets a column that a stage adds."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        more = [c for c in docs.columns if c not in DOCUMENTS]
        if not more:
            return stage(spark, docs, sf_dir)
        packed = docs.select(*[c for c in docs.columns if c in DOCUMENTS], F.struct(*more).alias(REST))
        out = stage(spark, packed, sf_dir)
        return out.select([F.col(REST)[c].alias(c) if c in more else F.col(c) for c in docs.columns]) if REST in out.columns else out

    return run_stage


@_apart
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents (no letter, or like no learned language) go; a missing language is filled in.

    Null and empty texts have no letter. Repeated rows and rows without an id are judged each by their text.
    All labelled documents teach; how like a language its texts are by length is measured on a third with prototypes of the others.
    """
    apart = language.held_out(F.col("doc_id"), 3, 1)
    learned, other = (language.prototypes(docs.where(rows), "text", "lang") for rows in (~apart, apart))
    least = language.bounds(docs.where(apart), "text", "lang", learned)
    found = language.identified(docs, "text", language.together(learned, other), least).where("NOT rejected")
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)


@_apart
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays, of rows with one id one row.

    Of equal texts without an id one stays, and none if a row with an id has the text. Null and empty texts without an id are copies of nothing and stay.
    """
    groups = jaccard.joined(docs, "doc_id", "text", SHINGLE, SIMILAR)
    gone = written(groups.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    # ids in slots that no such id has stay without a shuffle of their texts
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(jaccard.SLOTS))
    slots = F.broadcast(gone.select(slot.alias("__slot")).distinct())
    marked = docs.withColumn("__slot", slot)
    kept = marked.join(slots, "__slot", "left_anti").select(docs.columns)
    kept = kept.unionByName(marked.join(slots, "__slot", "left_semi").join(gone, "doc_id", "left_anti").select(docs.columns))
    repeated = written(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if not repeated.isEmpty():
        again = _first(kept.join(repeated, "doc_id", "left_semi").select(docs.columns), F.col("doc_id"))
        kept = kept.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(again)
    loose = F.col("doc_id").isNull() & (F.length("text") > 0)
    if not docs.where(loose).isEmpty():
        free = _first(kept.where(loose), F.xxhash64("text")).withColumn("__text", F.xxhash64("text"))
        named = docs.where("doc_id IS NOT NULL").select(F.xxhash64("text").alias("__text")).distinct()
        kept = kept.where(~F.coalesce(loose, F.lit(False))).unionByName(free.join(named, "__text", "left_anti").select(docs.columns))
    return kept


def _first(rows: DataFrame, key: Column) -> DataFrame:
    """One row of each key; Spark limits the rows of a key before the shuffle."""
    place = F.row_number().over(Window.partitionBy("__key").orderBy(F.xxhash64("text"), "lang", "source"))
    return rows.withColumn("__key", key).withColumn("__place", place).where("__place = 1").select(rows.columns)


@_apart
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; shorter benchmark passages are cut out of the others.

    Null and empty texts hold no passage and stay. Repeated rows and rows without an id are treated each by their text.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.marked(docs, "text", benchmark, "item_id", "text").where(~decontaminate.contaminated())
    cut = F.when(F.size("removal") > 0, decontaminate.without_spans("text")).otherwise(F.col("text"))
    return _with_text(found, cut).select(docs.columns)


@_apart
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays, null and empty texts and repeated rows as well."""
    proposed = written(secrets.candidates(docs, "text", "source"), "candidates")
    learned = proposed.where(~language.held_out(F.col("doc_id"), 3, 1))
    found = secrets.voted(proposed, secrets.forest(secrets.labelled_by_format(learned), secrets.examples(spark)))
    return _with_text(found, secrets.redacted("text")).select(docs.columns)


@_apart
def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in a training bin; a null or empty text is one empty piece."""
    return packing.packed(docs, "doc_id", "text", "source")


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("decontamination", decontaminated),
    ("secrets", redact_secrets),
    ("packing", pack_bins),
]

#: Prototypes, the forest and the packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
