"""Words and shingles of many texts at once, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes scanned together; one longer text is scanned alone.
BLOCK = (1 << 20) - 65_536

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_P, _P_INVERSE):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _P)


#: Rows whose texts are in memory as Python objects at once.
ROWS = 1000


def encoded(texts: list[str | None]) -> list[bytes]:
    """UTF-8 with A-Z lower-cased (other letters stay); null becomes empty."""
    return [t.encode("utf-8", "surrogatepass").lower() if t else b"" for t in texts]


def blocks(blobs: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of at most BLOCK bytes together, one text at least."""
    start, total = 0, 0
    for i, blob in enumerate(blobs):
        if i > start and total + len(blob) > BLOCK:
            yield start, i
            start, total = i, 0
        total += len(blob)
    if start < len(blobs):
        yield start, len(blobs)


def sliced(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Where each block of a column's texts begins, and the texts encoded."""
    for at in range(0, len(column), ROWS):
        blobs = encoded(column.slice(at, ROWS).to_pylist())
        for a, b in blocks(blobs):
            yield at + a, blobs[a:b]


class Words:
    """The words of a block of texts: hash and byte range of each, and how many each text has.

    ``word_bytes`` is a table of 256 booleans; a word is a longest run of true bytes. The byte
    10 must be false in it: it parts the texts.
    """

    def __init__(self, blobs: list[bytes], word_bytes: np.ndarray):
        data = np.frombuffer(b"\n" + b"\n".join(blobs) + b"\n", np.uint8)
        lengths = np.fromiter((len(b) for b in blobs), np.int64, len(blobs))
        #: Where each text begins in ``data``.
        self.text_start = 1 + np.concatenate(([0], np.cumsum(lengths + 1)[:-1])) if len(blobs) else np.zeros(0, np.int64)
        inside = word_bytes[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.data, self.start, self.end = data, edges[0::2], edges[1::2]
        powers, inverse = _powers(1 << max(20, int(len(data)).bit_length()))
        sums = _byte_values()[data]
        sums *= powers[: len(data)]
        self._sums, self._inverse = np.cumsum(sums, out=sums), inverse
        self.hash = self._hashed(self.start, self.end)
        first = np.searchsorted(self.start, self.text_start)
        #: Words of text i are first[i]:first[i + 1].
        self.first = np.concatenate((first, [len(self.start)]))
        self.count = np.diff(self.first)

    def _hashed(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end - 1] - self._sums[start - 1]) * self._inverse[start] + (end - start).astype(np.uint64))

    def beginnings(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Which words are longer than ``size`` bytes, and the hashes of their first ``size`` bytes."""
        longer = np.flatnonzero(self.end - self.start > size)
        return longer, self._hashed(self.start[longer], self.start[longer] + size)


def spaced() -> np.ndarray:
    """Words are runs without space, tab, line or page ends."""
    table = np.ones(256, bool)
    table[[32, *range(9, 14)]] = False
    return table


def alphanumeric() -> np.ndarray:
    """Words are runs of digits, small letters and everything beyond ASCII."""
    table = np.zeros(256, bool)
    table[48:58] = table[97:123] = table[128:] = True
    return table


def shingles(words: Words, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a shorter text is one shingle, an empty one has none."""
    h, out = words.hash, []
    weights = mix(np.arange(1, size + 1, dtype=np.uint64) * _P) | np.uint64(1)
    n = max(0, len(h) - size + 1)
    full = np.zeros(n, np.uint64)
    for i in range(size):
        full += h[i : i + n] * weights[i]
    full = mix(full)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(full[a : b - size + 1]))
        elif b > a:
            out.append(mix((h[a:b] * weights[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
