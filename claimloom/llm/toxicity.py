"""Toxicity by cumulative-link ordinal regression over sparse text features.

A text's features are its distinct words and word beginnings, hashed. P(grade <= j) is the logistic function of a threshold
j minus one weighted sum that all thresholds share; thresholds are ordered. An L1 penalty keeps few weights. The score is
the expected grade.

Learning takes a bounded sample: of each label the ROWS labelled rows first by a hash of their id. Scoring takes every
text, whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from claimloom.llm.bytescan import Words, alphanumeric, blocks, encoded

ROWS = 3000
BITS = 22
BEGINNINGS = (4, 5, 6)
#: Sampled texts that must have a feature for it to get a weight.
SUPPORT = 3
#: Of the selection of features, and of the second fit, of the selected ones alone, which undoes most of the shrinking.
PENALTY, PENALTY_AGAIN = 1e-3, 1e-4
STEPS = 400
GRADES = 4
#: From this probability of a grade over 0 on a text counts as toxic; under one half, as the penalty shrinks the odds.
LEAST_TOXIC = 0.3


def _features(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the text and feature, for every word and word beginning; not distinct."""
    words = Words(blobs, alphanumeric())
    doc = np.repeat(np.arange(len(blobs)), words.count)
    docs, hashes = [doc], [words.hash]
    for size in BEGINNINGS:
        longer, h = words.beginnings(size)
        docs.append(doc[longer])
        hashes.append(h ^ np.uint64(size))
    return np.concatenate(docs), (np.concatenate(hashes) & np.uint64((1 << BITS) - 1)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def exceeds(self, s: np.ndarray) -> np.ndarray:
        """P(grade > j) for each threshold."""
        return _logistic(s[:, None] - self.thresholds[None, :])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(doc: np.ndarray, feature: np.ndarray, grade: np.ndarray, weight: np.ndarray, grades: int) -> Model:
    """Select features under a strong penalty, then fit again with those under a weak one."""
    first = _fit(doc, feature, grade, weight, grades, PENALTY)
    kept = np.isin(feature, first.features)
    return _fit(doc[kept], feature[kept], grade, weight, grades, PENALTY_AGAIN)


def _fit(doc: np.ndarray, feature: np.ndarray, grade: np.ndarray, weight: np.ndarray, grades: int, penalty: float) -> Model:
    """Proximal gradient with momentum. doc, feature: the ones of a 0/1 matrix; grade and weight by document."""
    names, col = np.unique(feature, return_inverse=True)
    support = np.bincount(col) >= SUPPORT
    keep = support[col]
    names, at = names[support], np.cumsum(support) - 1
    doc, col = doc[keep], at[col[keep]]
    n, share = len(grade), weight / weight.sum()
    norm = np.ones(len(names))
    for _ in range(20):  # the largest eigenvalue of the weighted Gram matrix
        v = np.bincount(col, (share * np.bincount(doc, norm[col], n))[doc], len(names))
        size = np.linalg.norm(v) or 1.0
        norm = v / size
    step, w, theta = 4 / (size + 1e-9), np.zeros(len(names)), np.linspace(1, 3, grades - 1)
    y, momentum = w.copy(), 1.0
    for _ in range(STEPS):
        s = np.bincount(doc, y[col], n)
        upper = np.concatenate((theta, [np.inf]))[grade] - s
        lower = np.concatenate(([-np.inf], theta))[grade] - s
        a, b = _logistic(upper), _logistic(lower)
        a, b = np.where(np.isinf(upper), 1, a), np.where(np.isinf(lower), 0, b)
        p = np.maximum(a - b, 1e-12)
        da, db = share * a * (1 - a) / p, share * b * (1 - b) / p
        to = y - step * np.bincount(col, (da - db)[doc], len(names))
        new = np.sign(to) * np.maximum(np.abs(to) - step * penalty, 0)
        slope = np.bincount(grade, da, grades)[:-1] - np.bincount(grade, db, grades)[1:]
        theta = np.maximum.accumulate(theta + np.clip(2.0 * slope, -0.5, 0.5) + np.arange(grades - 1) * 1e-9)
        ahead = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        y, w, momentum = new + (momentum - 1) / ahead * (new - w), new, ahead
    used = w != 0
    return Model(names[used], w[used], theta)


def grades_of(doc: np.ndarray, feature: np.ndarray, toxic: np.ndarray, grades: int = GRADES) -> np.ndarray:
    """Severity grades where labels only say toxic or not: 0 for rows that aren't; the others fall in equal parts by how many
    of their features occur in toxic rows (nearly) alone."""
    names, col = np.unique(feature, return_inverse=True)
    n, bad = np.bincount(col), np.bincount(col, toxic[doc].astype(float))
    alone = (n >= 2 * SUPPORT) & (bad >= 0.95 * n)
    marked = np.bincount(doc, alone[col].astype(float), len(toxic))
    if not toxic.any():
        return np.zeros(len(toxic), np.int64)
    cuts = np.quantile(marked[toxic], np.arange(1, grades - 1) / (grades - 1))
    return np.where(toxic, 1 + np.searchsorted(cuts, marked, "left"), 0).astype(np.int64)


def model(labelled: DataFrame, docs: DataFrame, doc_id: str, text: str, label: str, graded: bool = False) -> Model:
    """Learn from ``labelled`` (id, label) and the texts that ``docs`` has for the ids.

    The label is a grade from 0 on if ``graded``, else 0 or 1 and graded by ``grades_of``. Rows with a null id or label
    teach nothing. Without labelled texts of two grades nothing is learned: every severity is 0.
    """
    rows = labelled.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).where("id IS NOT NULL AND y >= 0")
    sampled, share = [], []
    for toxic in (False, True):
        part = rows.where((F.col("y") > 0) == toxic)
        some = part.orderBy(F.xxhash64("id"), "id").limit(ROWS).collect()
        share.append(part.count() / max(1, len(some)))
        sampled += [(r.id, r.y) for r in some]
    ids = docs.sparkSession.createDataFrame(sampled, f"id {dict(rows.dtypes)['id']}, y int")  # at most 2 * ROWS rows
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(ids), "id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = encoded(batch.column(1).to_pylist())
            for a, b in blocks(blobs):
                doc, feature = _features(blobs[a:b])
                lists = [np.unique(x) for x in np.split(feature[np.argsort(doc, kind="stable")], np.cumsum(np.bincount(doc, minlength=b - a))[:-1])]
                yield pa.RecordBatch.from_pydict({"y": batch.column(0).slice(a, b - a), "f": pa.array([x.astype(np.int32) for x in lists], pa.list_(pa.int32()))})

    found = texts.select("y", "text").mapInArrow(extract, "y int, f array<int>").toArrow()
    lists = [np.array(x, np.int64) for x in found.column("f").to_numpy()]
    order = sorted(range(len(lists)), key=lambda i: (lists[i].tobytes(), i))
    y = np.array(found.column("y").to_pylist(), np.int64)[order]
    if len(np.unique(y > 0)) < 2:
        return Model(np.zeros(0, np.int64), np.zeros(0), np.array([35.0]))
    doc = np.repeat(np.arange(len(order)), [len(lists[i]) for i in order])
    feature = np.concatenate([lists[i] for i in order])
    grade = y if graded else grades_of(doc, feature, y > 0)
    return fit(doc, feature, grade, np.array(share)[(y > 0).astype(int)], int(grade.max()) + 1)


def scored(docs: DataFrame, text: str, learned: Model) -> DataFrame:
    """``docs`` with severity (the expected grade), grade (the likeliest) and toxic (a grade over 0 has probability LEAST_TOXIC or more).

    A null, empty or wordless text has no features and gets what the thresholds alone say. Columns of these names in ``docs`` are
    replaced. Repeated rows get the same answer.
    """
    new = ["severity", "grade", "toxic"]
    kept = docs.drop(*new)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << BITS)
        table[learned.features] = learned.weights
        for batch in batches:
            blobs = encoded(batch.column(batch.schema.get_field_index(text)).to_pylist())
            s = np.zeros(len(blobs))
            for a, b in blocks(blobs):
                doc, feature = _features(blobs[a:b])
                weighed = np.flatnonzero(table[feature])
                pairs = np.unique(doc[weighed] << BITS | feature[weighed])
                s[a:b] = np.bincount(pairs >> BITS, table[pairs & ((1 << BITS) - 1)], b - a)
            above = learned.exceeds(s)
            each = -np.diff(np.column_stack((np.ones(len(s)), above, np.zeros(len(s)))), axis=1)
            columns = [*batch.columns, pa.array(above.sum(axis=1)), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(above[:, 0] >= LEAST_TOXIC)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *new])

    kinds = [DoubleType(), IntegerType(), BooleanType()]
    return kept.mapInArrow(score, StructType([*kept.schema.fields, *(StructField(n, k) for n, k in zip(new, kinds, strict=True))]))
