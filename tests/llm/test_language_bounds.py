"""Texts that resemble no learned language are rejected, texts of the learned ones stay."""

import random

from pyspark.sql import functions as F

from claimloom.llm import language

FOLDER = "/root/testdata/sf0.1"
#: First and last letters of other scripts, and how many texts of each.
SCRIPTS, EACH = [(0x3B1, 0x3C9), (0x430, 0x44F), (0x4E00, 0x9FA5), (0x5D0, 0x5EA)], 100


def _strange(rng):
    """Words of random letters of other scripts, in texts of 50 to 2000 letters."""
    for a, b in SCRIPTS:
        for _ in range(EACH):
            letters = [chr(rng.randint(a, b)) for _ in range(rng.randint(50, 2000))]
            for i in range(6, len(letters), rng.randint(4, 9)):
                letters[i] = " "
            yield "".join(letters)


def test_unlearned_scripts_are_rejected_and_learned_languages_stay(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    apart = language.held_out(F.col("doc_id"), 3, 1)
    learned = language.prototypes(docs.where(~apart), "text", "lang")
    least = language.bounds(docs.where(apart), "text", "lang", learned, 0.01)
    assert least and all(language.noise(learned) < 1 and b <= 1 for b in least.values())
    strange = spark.createDataFrame([(i, t) for i, t in enumerate(_strange(random.Random(5)))], "doc_id bigint, text string")
    for bounds in (None, least):
        gone = language.identified(strange, "text", learned, bounds).where("rejected").count()
        assert gone >= 0.99 * len(SCRIPTS) * EACH
        lost = language.identified(docs.where(apart & F.col("lang").isNotNull()), "text", learned, bounds)
        lost = lost.where(F.col("lang_pred") != language.UNKNOWN).agg(F.avg(F.col("rejected").cast("double"))).first()[0]
        assert lost <= 0.01


def test_an_unlearned_language_of_the_same_script_is_rejected_more_often_with_bounds(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("lang IS NOT NULL")
    names = sorted(r.lang for r in docs.select("lang").distinct().collect())
    apart = language.held_out(F.col("doc_id"), 3, 1)
    known, left_out = docs.where(F.col("lang") != names[0]), docs.where(F.col("lang") == names[0])
    learned = language.prototypes(known.where(~apart), "text", "lang")
    least = language.bounds(known.where(apart), "text", "lang", learned, 0.01)
    without, with_bounds = (language.identified(left_out, "text", learned, b).where("rejected").count() for b in (None, least))
    assert with_bounds > without


def test_prototypes_of_parts_add_up_to_those_of_the_whole(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    apart = language.held_out(F.col("doc_id"), 3, 1)
    whole = language.prototypes(docs, "text", "lang")
    parts = language.together(*(language.prototypes(docs.where(c), "text", "lang") for c in (apart, ~apart)))
    assert list(whole) == list(parts) and all((whole[n] == parts[n]).all() for n in whole)
    assert language.bounds(docs.limit(0), "text", "lang", whole) == {} and language.together({}, {}) == {}
