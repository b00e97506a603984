"""Benchmark decontamination: test phrases looked up in an FM-index of each training shard.

A shard is one Arrow batch of documents. Its words become the numbers that the benchmark's
words have; stretches in which every two neighbouring words are neighbours somewhere in the
benchmark are indexed, as a phrase can occur nowhere else. Backward search finds the phrases,
sampled suffix positions say where, and overlapping occurrences merge to removal spans.

The benchmark reaches the tasks in blocks of bounded size; a larger one takes one pass over the
documents for each block, so any size is searched in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from claimloom.llm.bytescan import Words, alphanumeric, blocks, encoded, sliced
from claimloom.llm.fm_index import FMIndex
from claimloom.sources.scratch import written

#: Words of a phrase; a shorter benchmark text is one phrase.
WINDOW = 13
#: Benchmark words sent to the tasks at once.
BLOCK_WORDS = 1_000_000
#: Windows of one benchmark text kept in one row; a longer text takes several rows.
PIECE = 4096

SPAN = StructType([StructField(n, IntegerType()) for n in ("word_from", "word_to", "start", "end")])


def pieces(benchmark: DataFrame, item_id: str, text: str, window: int = WINDOW) -> DataFrame:
    """Benchmark texts as word hashes: item, words (at most PIECE windows), length of the phrases in them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs, items = encoded(batch.column(1).to_pylist()), batch.column(0).to_pylist()
            for a, b in blocks(blobs):
                words = Words(blobs[a:b], alphanumeric())
                for item, lo, hi in zip(items[a:b], words.first[:-1], words.first[1:], strict=True):
                    size = min(window, hi - lo)
                    for at in range(lo, hi - size + 1 if size else lo, PIECE):
                        part = words.hash[at : min(hi, at + PIECE + size - 1)].view(np.int64)
                        yield pa.RecordBatch.from_pydict({"item": [item], "size": pa.array([size], pa.int32()), "words": pa.array([part], pa.list_(pa.int64()))})

    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    return rows.mapInArrow(cut, "item string, size int, words array<bigint>")


class Phrases:
    """The distinct phrases of a block of the benchmark, by length, with the items each belongs to."""

    def __init__(self, rows: list):
        self.vocabulary = np.unique(np.concatenate([np.array(r.words, np.int64) for r in rows]))
        self.items = sorted({r.item for r in rows})
        number = {item: i for i, item in enumerate(self.items)}
        by: dict[int, list] = {}
        pairs = [np.zeros(0, np.int64)]
        for r in rows:
            ids = np.searchsorted(self.vocabulary, np.array(r.words, np.int64)) + 2
            pairs.append(self.pair(ids[:-1], ids[1:]))
            windows = np.lib.stride_tricks.sliding_window_view(ids, r.size)
            by.setdefault(r.size, []).append((windows, np.full(len(windows), number[r.item])))
        self.pairs = np.unique(np.concatenate(pairs))
        self.by_size = {}
        for size, found in by.items():
            distinct, at = np.unique(np.concatenate([w for w, _ in found]), axis=0, return_inverse=True)
            owners = np.unique(np.stack((at.reshape(-1), np.concatenate([o for _, o in found]))), axis=1)
            self.by_size[size] = distinct.astype(np.int32), np.searchsorted(owners[0], np.arange(len(distinct) + 1)), owners[1]
        self.shortest = min(self.by_size)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a * (len(self.vocabulary) + 2) + b

    def numbered(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers from 2 for words of the vocabulary, 1 for others."""
        h = hashes.view(np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at + 2, 1)


def _stretches(ids: np.ndarray, doc: np.ndarray, phrases: Phrases) -> np.ndarray:
    """Places of the words that lie in a stretch long enough for a phrase; -1 between stretches."""
    keys = phrases.pair(ids[:-1], ids[1:])
    both = np.flatnonzero((ids[:-1] > 1) & (ids[1:] > 1) & (doc[:-1] == doc[1:]))
    if len(both) and len(phrases.pairs):
        at = np.minimum(np.searchsorted(phrases.pairs, keys[both]), len(phrases.pairs) - 1)
        both = both[phrases.pairs[at] == keys[both]]
    linked = np.zeros(len(ids) + 1, bool)  # word i with word i - 1
    linked[both + 1] = True
    begins = np.flatnonzero(~linked[:-1] & (ids > 1)) if len(ids) else np.zeros(0, np.int64)
    breaks = np.flatnonzero(~linked)
    ends = breaks[np.searchsorted(breaks, begins, "right")]
    long = ends - begins >= phrases.shortest
    begins, lengths = begins[long], (ends - begins)[long]
    if not len(begins):
        return np.zeros(0, np.int64)
    total = lengths + 1
    out = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total) + np.repeat(begins, total)
    out[np.cumsum(total) - 1] = -1
    return out


def _merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of ranges, as disjoint ranges in order; ranges that touch become one."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.concatenate(([True], a[1:] > b[:-1]))
    return a[new], b[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(a) - 1]))]


def _occurrences(column: pa.Array, phrases: Phrases) -> tuple[np.ndarray, dict[int, tuple[list[tuple], list[str]]]]:
    """Words of each text; for texts with a hit, the merged spans and the items found."""
    n_words, kept, shard = np.zeros(len(column), np.int64), [], []
    for a, texts in sliced(column):
        words = Words(texts, alphanumeric())
        n_words[a : a + len(texts)] = words.count
        doc = np.repeat(np.arange(len(texts)), words.count)
        at = _stretches(ids := phrases.numbered(words.hash), doc, phrases) if len(words.hash) else np.zeros(0, np.int64)
        if len(at):
            owner, place = doc[at], at - words.first[:-1][doc[at]]
            shard.append(np.stack((np.where(at < 0, 1, ids[at]), owner + a, place, words.start[at], words.end[at])))
            for d in np.unique(owner[at >= 0]).tolist():
                own, begin = slice(words.first[d], words.first[d + 1]), words.text_start[d]
                kept.append((d + a, texts[d], words.start[own] - begin, words.end[own] - begin))
    found: dict[int, tuple[list, list]] = {}
    if not shard:
        return n_words, found
    table = np.concatenate(shard, axis=1)
    index = FMIndex(table[0])
    spans, hits = [], []
    for size, (windows, first, owners) in phrases.by_size.items():
        lo, hi = index.search(windows)
        n = hi - lo
        rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        at = index.locate(rows)
        spans.append(np.stack((table[1, at], table[2, at], table[2, at] + size, at, at + size - 1)))
        pairs = np.unique(np.stack((table[1, at], np.repeat(np.arange(len(windows)), n))), axis=1)
        many = first[pairs[1] + 1] - first[pairs[1]]
        item = owners[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[pairs[1]], many)]
        hits.append(np.unique(np.stack((np.repeat(pairs[0], many), item)), axis=1))
    every, items = np.concatenate(spans, axis=1), np.unique(np.concatenate(hits, axis=1), axis=1)
    every = every[:, np.argsort(every[0], kind="stable")]
    for d, blob, starts, ends in kept:
        lo, hi = np.searchsorted(every[0], [d, d + 1])
        if lo == hi:
            continue
        w0, w1 = _merged(every[1, lo:hi], every[2, lo:hi])
        chars = np.concatenate(([0], np.cumsum((np.frombuffer(blob, np.uint8) & 0xC0) != 0x80)))
        i, j = np.searchsorted(items[0], [d, d + 1])
        spans_of = zip(w0.tolist(), w1.tolist(), chars[starts[w0]].tolist(), chars[ends[w1 - 1]].tolist(), strict=True)
        found[d] = list(spans_of), [phrases.items[k] for k in items[1, i:j]]
    return n_words, found


def marked(docs: DataFrame, text: str, benchmark: DataFrame, item_id: str, item_text: str, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with n_words, removal (merged spans of words and code points, ends exclusive) and hit_items (ids as sorted texts).

    Null, empty and wordless texts have no words, spans or items; so has every text if the benchmark has no
    words. Null and empty benchmark texts match nothing; a null item id counts as the empty text, equal ids as one
    item. Columns of these names in ``docs`` are replaced. Repeated rows each get their own answer.
    """
    new = ["n_words", "removal", "hit_items"]
    kept = docs.drop(*new)
    table = written(pieces(benchmark, item_id, item_text, window), "benchmark")
    n = table.agg(F.sum(F.size("words"))).first()[0] or 0
    n_blocks = max(1, -(-n // block_words))
    table = table.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(n_blocks)))
    schema = StructType([*kept.schema.fields, StructField("n_words", LongType()), StructField("removal", ArrayType(SPAN)), StructField("hit_items", ArrayType(StringType()))])
    arrow_spans = pa.list_(pa.struct([(f.name, pa.int32()) for f in SPAN.fields]))
    out = kept
    for block in range(n_blocks):
        rows = table.where(F.col("block") == block).select("item", "size", "words").collect()
        out = out.mapInArrow(_pass(text, Phrases(rows) if rows else None, new, arrow_spans), schema)
        if block + 1 < n_blocks:
            out = written(out, "marked")
    return out


def _pass(text: str, phrases: Phrases | None, new: list[str], arrow_spans: pa.DataType):
    """A scan of all documents for one block; adds to what earlier passes have found."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            if phrases is None:
                n_words, found = np.zeros(len(batch), np.int64), {}
                for a, texts in sliced(column):
                    n_words[a : a + len(texts)] = Words(texts, alphanumeric()).count
            else:
                n_words, found = _occurrences(column, phrases)
            spans = [found.get(i, ([], []))[0] for i in range(len(batch))]
            items = [found.get(i, ([], []))[1] for i in range(len(batch))]
            if new[1] in batch.schema.names:
                for i, (old, ids) in enumerate(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in new[1:]), strict=True)):
                    if old:
                        spans[i] = _union([*spans[i], *(tuple(s.values()) for s in old)])
                        items[i] = sorted({*items[i], *ids})
            names = [c for c in batch.schema.names if c not in new]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
            dicts = [[dict(zip(("word_from", "word_to", "start", "end"), s, strict=True)) for s in x] for x in spans]
            columns += [pa.array(n_words), pa.array(dicts, arrow_spans), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *new])

    return scan


def _union(spans: list[tuple]) -> list[tuple]:
    out: list[tuple] = []
    for s in sorted(spans):
        if out and s[0] <= out[-1][1]:
            if s[1] > out[-1][1]:
                out[-1] = (out[-1][0], s[1], out[-1][2], s[3])
        else:
            out.append(s)
    return out


def n_hit() -> Column:
    """Words in removal spans."""
    return F.aggregate("removal", F.lit(0).cast("bigint"), lambda n, s: n + (s.word_to - s.word_from))


def contaminated(share: int = 20) -> Column:
    """At least one word in ``share`` is hit."""
    return (n_hit() > 0) & (n_hit() * share >= F.col("n_words"))


def without_spans(text: str) -> Column:
    """The text without its removal spans."""
    ends = F.concat(F.array(F.lit(0)), F.transform("removal", lambda s: s.end))
    starts = F.concat(F.transform("removal", lambda s: s.start), F.array(F.char_length(text)))
    return F.array_join(F.zip_with(ends, starts, lambda a, b: F.substring(F.col(text), a + 1, b - a)), "")
