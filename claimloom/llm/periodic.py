"""Periodic runs of words, found with a suffix automaton and link-cut access.

A run is a stretch of consecutive words with smallest period q that is at least ``power`` periods and ``least`` words long
and that no neighbouring word extends. For the stretches of a text that can hold one (see ``_stretches``):

1. The suffix automaton of the words is built. Each prefix of the stretch has a state; its suffixes are on the path of suffix links to
   the root.
2. For each appended word the path of its prefix is accessed as in a link-cut tree: it becomes one preferred path, coloured with the
   place of that word. The path segments it takes over have the colour of the word that passed there last.
3. Where a segment of colour e is met at place i, the two prefixes end alike in as many words as its deepest state is long. If that is
   at least their distance i - e, a square ends at i; the words behind it as far as both agree have period i - e. All places at which
   the same start and period are met are one run, and the last is its end.

A word is a 64-bit hash of its bytes. A text is a row of its own, so nothing is shuffled.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from claimloom.llm.bytescan import Words, blocks, mix, spaced

#: Fewest periods and fewest words of a run.
POWER, LEAST = 4, 6
#: Rows whose texts are in memory as Python objects at once.
ROWS = 1000
#: Rounds in which stretches are narrowed down; wider ones only take longer.
ROUNDS = 24

RUN = StructType([StructField(n, LongType()) for n in ("start", "length", "period")])


def _automaton(words: list[int]) -> tuple[array, array, array]:
    """length and suffix link of each state (1 is the root, 0 none) and the state of each prefix."""
    n = 2 * len(words) + 2
    length, link, word, target = (array("i", bytes(4 * n)) for _ in range(4))
    more: dict[int, dict[int, int]] = {}  # a state's transitions after its first one
    prefix, last, states = array("i"), 1, 1
    for w in words:
        states += 1
        new, at, q = states, last, 0
        length[new] = length[last] + 1
        prefix.append(new)
        while at:
            if not target[at]:
                word[at], target[at] = w, new
            elif word[at] == w:
                q = target[at]
                break
            elif at not in more:
                more[at] = {w: new}
            elif w in more[at]:
                q = more[at][w]
                break
            else:
                more[at][w] = new
            at = link[at]
        if not q:
            link[new] = 1
        elif length[q] == length[at] + 1:
            link[new] = q
        else:
            states += 1
            copy = states
            length[copy], link[copy], word[copy], target[copy] = length[at] + 1, link[q], word[q], target[q]
            if q in more:
                more[copy] = dict(more[q])
            link[q] = link[new] = copy
            while at:
                if word[at] == w and target[at] == q:
                    target[at] = copy
                elif at in more and more[at].get(w) == q:
                    more[at][w] = copy
                else:
                    break
                at = link[at]
        last = new
    return length, link, prefix


def _raise(x: int, left: array, right: array, up: array, colour: array) -> None:
    """Splay x to the top of its preferred path's tree; the path's colour is kept at the top."""
    while y := up[x]:
        on_left = left[y] == x
        if not on_left and right[y] != x:
            return
        z = up[y]
        if z and (left[z] == y or right[z] == y):
            # the grandparent first if all lean one way, else the parent twice
            turns = ((y, z), (x, y)) if (left[z] == y) == on_left else ((x, y), (x, z))
        else:
            turns = ((x, y),)
        for a, b in turns:
            above = up[b]
            if left[b] == a:
                moved = right[a]
                left[b], right[a] = moved, b
            else:
                moved = left[a]
                right[b], left[a] = moved, b
            if moved:
                up[moved] = b
            up[b], up[a] = a, above
            if above and left[above] == b:
                left[above] = a
            elif above and right[above] == b:
                right[above] = a
            else:
                colour[a] = colour[b]


def runs(words: list[int], power: int = POWER, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    length, up, prefix = _automaton(words)
    for s in range(len(up)):
        if up[s] == 1:
            up[s] = 0  # the root is the empty text: nobody asks for it
    left, right, colour = (array("i", bytes(4 * len(up))) for _ in range(3))
    ends: dict[tuple[int, int], int] = {}
    for i, below in enumerate(prefix, 1):
        x = up[below]  # the prefix's own state is new on any path
        while x:
            _raise(x, left, right, up, colour)
            e, alike = colour[x], length[x]
            distance = i - e
            if e and alike >= (power - 1) * distance and alike + distance >= least:
                ends[i - distance - alike, distance] = i
            if cut := right[x]:
                colour[cut] = e
            right[x] = below
            below, x = x, up[x]
        colour[below] = i
    return [(start, end - start, period) for (start, period), end in sorted(ends.items())]


def _gram(power: int, least: int) -> int:
    """So many words in a row that each in a run has an equal one a period before or behind it, within the run."""
    return max(1, min(max(least, power * q) - 2 * q + 1 for q in range(1, least + 2)))


def _stretches(h: np.ndarray, first: np.ndarray, power: int, least: int) -> list[tuple[int, int]]:
    """Ranges of words (of texts that begin at ``first``) that together hold every run.

    Each gram of a run has an equal one at its period's distance, at most a ``power``-th of the run. A gram whose nearest equal one is
    further than that part of the stretch it lies in is in no run; stretches without such grams are left.
    """
    k = _gram(power, least)
    n = len(h) - k + 1
    if n <= 0:
        return []
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    g = mix(doc[:n].astype(np.uint64))
    for i in range(k):
        g = mix(g + h[i : i + n])
    whole = doc[:n] == doc[k - 1 :]
    at = np.flatnonzero(whole)
    order = at[np.argsort(g[at], kind="stable")]
    equal = np.flatnonzero(g[order[1:]] == g[order[:-1]])
    gap = np.full(n, np.iinfo(np.int64).max // power)
    apart = order[equal + 1] - order[equal]
    gap[order[equal]] = apart
    gap[order[equal + 1]] = np.minimum(gap[order[equal + 1]], apart)
    alive = np.flatnonzero(gap <= len(h))
    starts = sizes = np.zeros(0, np.int64)
    for _ in range(ROUNDS):
        new = np.flatnonzero((np.diff(alive, prepend=-2) > 1) | (np.diff(doc[alive], prepend=-1) != 0))
        starts, sizes = alive[new], np.diff(new, append=len(alive)) + k - 1
        words = np.repeat(sizes, sizes - k + 1)
        keep = (power * gap[alive] <= words) & (words >= least)
        if keep.all():
            break
        alive = alive[keep]
    return list(zip(starts.tolist(), (starts + sizes).tolist(), strict=True))


def _found(blobs: list[bytes], power: int, least: int) -> tuple[list[int], dict[int, list[tuple[int, int, int]]]]:
    """Words of each text, and the runs of those that have one."""
    counts, found = [], {}
    for a, b in blocks(blobs):
        words = Words(blobs[a:b], spaced())
        counts += words.count.tolist()
        for start, end in _stretches(words.hash, words.first, power, least):
            at = int(np.searchsorted(words.first, start, side="right")) - 1
            names = np.unique(words.hash[start:end], return_inverse=True)[1].tolist()
            offset = start - int(words.first[at])
            for s, n, q in runs(names, power, least):
                found.setdefault(a + at, []).append((s + offset, n, q))
    return counts, found


def _kept(blob: bytes, found: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run contains after its first period."""
    words = blob.split()
    if found:
        stay = np.ones(len(words), bool)
        for start, n, q in found:
            stay[start + q : start + n] = False
        words = [words[i] for i in np.flatnonzero(stay).tolist()]
    return b" ".join(words)


def collapsed(docs: DataFrame, text: str, power: int = POWER, least: int = LEAST) -> DataFrame:
    """``docs`` with n_words, runs (start, length, period in words, by start, then period) and collapsed (the kept words).

    Words part at ASCII space. A word is dropped if a run has it after the run's first period. A null, empty or blank text has no words, no
    runs and collapses to the empty text. Repeated rows each get their own answer, an empty table gives none. Columns of these names in
    ``docs`` are replaced; others stay as they are, nulls included. A text of any length is handled whole; a task holds about 70
    bytes for each word of the longest stretch that may hold a run.
    """
    kept = docs.drop("n_words", "runs", "collapsed")
    added = [StructField("n_words", LongType()), StructField("runs", ArrayType(RUN)), StructField("collapsed", StringType())]
    kind = pa.list_(pa.struct([(f.name, pa.int64()) for f in RUN.fields]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                column = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
                blobs = [x or b"" for x in column.to_pylist()]
                counts, found = _found(blobs, power, least)
                spans = [[dict(zip(RUN.names, r, strict=True)) for r in found.get(i, ())] for i in range(len(blobs))]
                left = pa.array([_kept(x, found.get(i, [])) for i, x in enumerate(blobs)], pa.binary()).cast(pa.string())
                more = [pa.array(counts, pa.int64()), pa.array(spans, kind), left]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *(f.name for f in added)])

    return kept.mapInArrow(scan, StructType([*kept.schema.fields, *added]))


def strongest(runs: Column) -> Column:
    """The run of the greatest exact length / period; ties go to the smallest start, then period. Null without a run."""
    better = lambda a, b: a.length * b.period > b.length * a.period
    least = lambda a, b: F.when(b.isNull() | better(a, b), a).otherwise(b)
    return F.aggregate(runs, F.lit(None).cast(RUN), lambda best, x: least(x, best))


def looped(text: Column, doc_id: Column) -> Column:
    """``text`` with a repeated passage in one of ten documents, as the check of this operator has it: from word a on, words repeat with period p.

    h is the checksum of the id, g = floor(h / 10), a = g % n and p = 1 + floor((n - a) / (3 + g % 8)); documents with h % 10 = 0 are changed.
    A row without an id or without words stays.
    """
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        places = F.sequence(F.lit(0).cast("long"), n - 1)
        return F.when(n > 0, F.array_join(F.transform(places, lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " "))

    # the words are bound once: a lambda over one array
    changed = F.element_at(F.transform(F.array(words), repeated), 1)
    return F.when(h % 10 == 0, F.coalesce(changed, text)).otherwise(text)
