"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. The vector of a letter n-gram binds the
vectors of its letters, each permuted by its place, with an elementwise product; a text's
vector bundles (adds up) those of its n-grams; a language's prototype bundles its labelled
texts. A text gets the language whose prototype has the largest cosine with it.

Letters are lower-cased; everything else is one boundary mark, runs of it count once.
Bundles are whole numbers, so they don't depend on how rows are partitioned.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from claimloom.llm.bytescan import mix

DIMENSIONS = 2048
NGRAM = 3
#: Sharpness of the score, a softmax of the cosines.
SHARPNESS = 20.0
#: How often a text that has no n-gram in common with any learned language may pass for one of them.
CHANCE = 1e-3
#: What share of a language's own texts the bound for a length may reject; a length with fewer than its inverse of texts has none.
LOSS = 1e-3
#: More labelled languages than this are an error, so that the prototypes stay small.
MOST_LANGUAGES = 5000
UNKNOWN = "und"

_LENGTH = "__length"

_EDGE = 32
_GROUP, _GRAMS, _ROWS = 96, 1024, 1024


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point its lower-case letter, or the boundary mark."""
    table = np.full(0x110000, _EDGE, np.int64)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def _signs(letters: np.ndarray, place: int, dimensions: int) -> np.ndarray:
    """The vectors of some letters, permuted by the place: rolled by as many elements."""
    words = np.arange(dimensions // 64, dtype=np.uint64)
    bits = mix(letters.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + words[None, :] * np.uint64(0xD1342543DE82EF95))
    signs = np.unpackbits(bits.view(np.uint8), axis=1).astype(np.int8) * 2 - 1
    return np.roll(signs, place, axis=1)


def _bound(grams: np.ndarray, dimensions: int) -> np.ndarray:
    """The vectors of n-grams."""
    out = np.ones((len(grams), dimensions), np.int8)
    for place in range(NGRAM):
        letters, at = np.unique((grams >> (21 * place)) & 0x1FFFFF, return_inverse=True)
        out *= _signs(letters, place, dimensions)[at]
    return out.astype(np.float32)


def _grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text around a letter, and how often each occurs."""
    x = _letters()[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")]
    x = np.concatenate(([_EDGE], x, [_EDGE]))
    x = x[np.concatenate(([True], (x[1:] != _EDGE) | (x[:-1] != _EDGE)))]
    if len(x) < NGRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.zeros(len(x) - NGRAM + 1, np.int64)
    for place in range(NGRAM):
        codes |= x[place : place + len(codes)] << (21 * place)
    return np.unique(codes[x[1 : 1 + len(codes)] != _EDGE], return_counts=True)


def _bundles(texts: list[tuple[np.ndarray, np.ndarray]], dimensions: int) -> np.ndarray:
    """One vector for each text."""
    out = np.zeros((len(texts), dimensions), np.float64)
    if not texts or not any(len(g) for g, _ in texts):
        return out
    every = np.unique(np.concatenate([g for g, _ in texts]))
    for a in range(0, len(every), _GRAMS):
        part = every[a : a + _GRAMS]
        counts = np.zeros((len(texts), len(part)), np.float32)
        for i, (g, n) in enumerate(texts):
            lo, hi = np.searchsorted(g, part[0]), np.searchsorted(g, part[-1], "right")
            counts[i, np.searchsorted(part, g[lo:hi])] = n[lo:hi]
        out += counts @ _bound(part, dimensions)
    return out


def prototypes(labelled: DataFrame, text: str, lang: str, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """The bundle of each language over all labelled rows. Rows with a null language teach nothing."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for a in range(0, len(batch), _ROWS):
                rows, by = batch.slice(a, _ROWS), {}
                for t, name in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                    by.setdefault(name, []).append(_grams(t))
                for name, some in by.items():
                    codes, at = np.unique(np.concatenate([g for g, _ in some]), return_inverse=True)
                    n = np.bincount(at, weights=np.concatenate([c for _, c in some]), minlength=len(codes))
                    for b in range(0, len(codes), _GRAMS):
                        part = n[b : b + _GRAMS] @ _bound(codes[b : b + _GRAMS], dimensions).astype(np.float64)
                        sums[name] = sums.get(name, 0) + part
        for name, v in sums.items():
            yield pa.RecordBatch.from_pydict(
                {"lang": pa.array([name] * dimensions, pa.string()), "at": pa.array(range(dimensions), pa.int32()), "v": pa.array(v.astype(np.int64))}
            )

    rows = labelled.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("lang IS NOT NULL")
    summed = rows.mapInArrow(learn, "lang string, at int, v bigint").groupBy("lang", "at").agg(F.sum("v").alias("v"))
    whole = summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("v"))
    found = whole.limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} distinct languages are labelled")
    return {r.lang: np.array([x.v for x in r.v], np.float64) for r in sorted(found, key=lambda r: r.lang)}


def together(*learned: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Prototypes of several sets of rows as those of all of them."""
    return {name: sum(p[name] for p in learned if name in p) for name in sorted(set().union(*learned))}


def noise(learned: dict[str, np.ndarray], chance: float = CHANCE) -> float:
    """The cosine that a text without common n-grams exceeds with some prototype with at most this chance.

    Its vector is one of random signs to the prototypes: a cosine exceeds t with a chance of at most exp(-t * t * dimensions / 2).
    """
    dimensions = len(next(iter(learned.values()))) if learned else 1
    return float(np.sqrt(2 * np.log(max(1, len(learned)) / chance) / dimensions))


def bounds(labelled: DataFrame, text: str, lang: str, learned: dict[str, np.ndarray], loss: float = LOSS) -> dict[int, float]:
    """By length (the binary digits of a text's number of n-grams) the cosine that all but ``loss`` of the learned languages' texts reach.

    The rows should be others than those learned from. Lengths with fewer than 1 / loss of such rows aren't in it; an empty table gives none.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where(F.col("lang").isin(list(learned)))
    found = _likened(rows, "text", learned).where(F.col("lang_pred") != UNKNOWN)
    by = found.groupBy(_LENGTH).agg(F.count("*").alias("n"), F.percentile_approx("similarity", loss, 10_000).alias("least"))
    return {r[_LENGTH]: r.least for r in by.where(F.col("n") * loss >= 1).collect()}  # 64 rows at most


def identified(docs: DataFrame, text: str, learned: dict[str, np.ndarray], least: dict[int, float] | None = None) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1), similarity (best cosine) and rejected.

    Rejected is a text whose similarity is at the level of noise, or below that of ``least`` for its length.
    A null text, an empty one and one without a letter are ``und`` with score 0, and rejected; so is
    every text if nothing was learned. A very long text is judged whole. Columns of these names in ``docs`` are replaced. Ties go to the
    language first in the alphabet. Repeated rows get the same answer. An empty table gives none.
    """
    floor = noise(learned)
    bound = F.lit(floor)
    for length, b in (least or {}).items():
        bound = F.when(F.col(_LENGTH) == length, max(floor, b)).otherwise(bound)
    return _likened(docs, text, learned).withColumn("rejected", (F.col("lang_pred") == UNKNOWN) | (F.col("similarity") < bound)).drop(_LENGTH)


def _likened(docs: DataFrame, text: str, learned: dict[str, np.ndarray]) -> DataFrame:
    """``docs`` with lang_pred, score, similarity and the length class."""
    names = list(learned)
    matrix = np.stack([v / max(np.linalg.norm(v), 1e-12) for v in learned.values()]) if names else None
    dimensions = matrix.shape[1] if names else 0
    new = ["lang_pred", "score", "similarity", _LENGTH]
    kept = docs.drop(*new, "rejected")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows = batch.column(batch.schema.get_field_index(text)), len(batch)
            lang, score, best, length = [UNKNOWN] * rows, np.zeros(rows), np.zeros(rows), np.zeros(rows, np.int32)
            for a in range(0, rows if names else 0, _GROUP):
                grams = [_grams(t) for t in texts.slice(a, _GROUP).to_pylist()]
                v = _bundles(grams, dimensions)
                cosines = v @ matrix.T / np.maximum(np.linalg.norm(v, axis=1), 1e-12)[:, None]
                top = cosines.argmax(axis=1)
                odds = np.exp(SHARPNESS * (cosines - cosines.max(axis=1, keepdims=True)))
                for i, (g, n) in enumerate(grams):
                    if len(g):
                        length[a + i] = int(n.sum()).bit_length()
                        lang[a + i], score[a + i], best[a + i] = names[top[i]], odds[i, top[i]] / odds[i].sum(), cosines[i, top[i]]
            columns = [*batch.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(best), pa.array(length)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *new])

    kinds = [StringType(), DoubleType(), DoubleType(), IntegerType()]
    out = StructType([*kept.schema.fields, *(StructField(n, k) for n, k in zip(new, kinds, strict=True))])
    return kept.mapInArrow(predict, out)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Rows kept from learning: by the checksum of the id as text; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))
