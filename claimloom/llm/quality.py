"""Quality classifier by compression: one zstandard dictionary built from good, one from bad labelled text.

Texts are cut into pieces, each compressed with either dictionary. The sizes are added up; their normalised difference
says which of the two the text is closer to, and a logistic curve fitted on other labelled texts turns it into
the probability of the good label.

Learning takes a bounded sample: of each class the ROWS labelled rows first by a hash of their id, half of them for
the dictionaries (of those PIECES pieces, by hash) and half for the curve. Scoring takes every text, whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

ROWS = 4000
PIECES = 3000
PIECE_BYTES = 4096
DICTIONARY_BYTES = 96 << 10
LEVEL = 3
#: Scores from here on are predicted good.
THRESHOLD = 0.7


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    #: Of the curve: intercept, and slopes of the difference and of the share that is left after compression.
    weights: tuple[float, ...] = (0.0, 0.0, 0.0)


@lru_cache(maxsize=2)
def _compressors(model: tuple[bytes, bytes]) -> list[zstandard.ZstdCompressor]:
    options = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    parameters = zstandard.ZstdCompressionParameters.from_level(LEVEL, **options)
    out = []
    for content in model:
        dictionary = zstandard.ZstdCompressionDict(content) if content else None
        out.append(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters))
    return out


def _pieces(text: str | None) -> list[bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return [data[i : i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]


def features(text: str | None, good: bytes, bad: bytes) -> tuple[float, float]:
    """Normalised difference of the two compressed sizes (positive: closer to good), and the share left by the smaller."""
    parts = _pieces(text)
    if not parts:
        return 0.0, 0.0
    g, b = (sum(len(c.compress(p)) for p in parts) for c in _compressors((good, bad)))
    return (b - g) / (b + g), min(b, g) / sum(map(len, parts))


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; where there is too little text for one, the text itself."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _inputs(x: np.ndarray) -> np.ndarray:
    return np.column_stack((np.ones(len(x)), x * 10))


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton's method, with a small ridge."""
    a, w = _inputs(x), np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        ridge = 1e-3 * np.diag([0, *[1] * x.shape[1]]) * weight.sum()
        step = np.linalg.solve(a.T @ (a * (weight * p * (1 - p))[:, None]) + ridge + 1e-9 * np.eye(len(w)), a.T @ (weight * (y - p)) - ridge @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return w


def _scored(learned: Model, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_inputs(x) @ np.array(learned.weights), -30, 30)))


def model(labelled: DataFrame, docs: DataFrame, doc_id: str, text: str, label: str) -> Model:
    """Learn from ``labelled`` (id, label 0 or 1) and the texts that ``docs`` has for the ids.

    Rows with a null id or label teach nothing; an id labelled twice teaches twice. Without any label of a class
    its dictionary is empty; without any label at all every score is one half.
    """
    rows = labelled.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
    sampled, share = [], {}
    for y in (0, 1):
        some = rows.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(ROWS).collect()
        share[y] = rows.where(F.col("y") == y).count() / max(1, len(some))
        sampled += [(r.id, y) for r in some]
    spark = docs.sparkSession
    ids = spark.createDataFrame(sampled, f"id {dict(rows.dtypes)['id']}, y int")  # at most 2 * ROWS rows
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(ids), "id")
    for_curve = F.pmod(F.xxhash64("id", F.lit("curve")), F.lit(2)) == 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, y, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if parts := _pieces(t):
                    yield pa.RecordBatch.from_pydict({"id": [str(i)] * len(parts), "y": pa.array([y] * len(parts), pa.int32()), "piece": pa.array(parts, pa.binary())})

    pieces = texts.where(~for_curve).select("id", "y", "text").mapInArrow(cut, "id string, y int, piece binary")
    dictionaries = []
    for y in (1, 0):
        some = pieces.where(F.col("y") == y).orderBy(F.xxhash64("id", "piece"), "piece").limit(PIECES)
        dictionaries.append(_dictionary([bytes(r.piece) for r in some.select("piece").collect()]))
    good, bad = dictionaries

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t, good, bad) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"y": batch.column(0), "difference": pa.array([a for a, _ in x], pa.float64()), "left": pa.array([b for _, b in x], pa.float64())})

    measured = texts.where(for_curve).select("y", "text").mapInArrow(measure, "y int, difference double, left double").collect()
    if not measured:
        return Model(good, bad)
    measured.sort()
    y = np.array([r.y for r in measured], float)
    weight = np.array([share[r.y] for r in measured])
    return Model(good, bad, tuple(_curve(np.array([[r.difference, r.left] for r in measured]), y, weight).tolist()))


def scored(docs: DataFrame, text: str, learned: Model) -> DataFrame:
    """``docs`` with score (0 to 1, the probability of the good label) and difference.

    A null or empty text has no difference and gets what the curve says of none. Columns of these names in ``docs`` are
    replaced. Repeated rows get the same score.
    """
    kept = docs.drop("score", "difference")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            x = np.array([features(t, learned.good, learned.bad) for t in texts]).reshape(-1, 2)
            columns = [*batch.columns, pa.array(_scored(learned, x)), pa.array(x[:, 0])]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "score", "difference"])

    schema = StructType([*kept.schema.fields, StructField("score", DoubleType()), StructField("difference", DoubleType())])
    return kept.mapInArrow(score, schema)


def predicted(threshold: float = THRESHOLD) -> Column:
    return (F.col("score") >= threshold).cast("int")
