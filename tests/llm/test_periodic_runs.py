"""Runs of words against brute force, and what edge cases give."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from claimloom.llm import periodic, queries


def _runs(w, power=4, least=6):
    out = []
    for q in range(1, len(w) // power + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n, part = j - i + q, w[i : j + q]
            if j > i and n >= max(least, power * q) and not any(part[r:] == part[:-r] for r in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def _looped(doc_id, text):
    w, h = _words(text), zlib.crc32(str(doc_id).encode())
    if h % 10 or not w or doc_id is None:
        return w
    n, g = len(w), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def _texts(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        size = rng.choice([1, 2, 3, 30])
        words = [f"w{rng.randrange(size)}" for _ in range(rng.randrange(80))]
        if words and rng.random() < 0.6:
            q, s = rng.randrange(1, 9), rng.randrange(len(words))
            for i in range(s + q, len(words)):
                words[i] = words[i - q]
            words += [f"w{rng.randrange(size)}" for _ in range(rng.randrange(20))]
        yield rng.choice([" ", "\n", " \t "]).join(words)


@pytest.mark.parametrize(("power", "least"), [(4, 6), (2, 2), (3, 10)])
def test_runs_equal_brute_force(power, least):
    for text in _texts(5, 400):
        names = {w: i for i, w in enumerate(sorted(set(_words(text))))}
        words = [names[w] for w in _words(text)]
        assert periodic.runs(words, power, least) == _runs(words, power, least), words


@pytest.mark.parametrize(("power", "least"), [(4, 6), (3, 10)])
def test_stretches_lose_no_run(power, least):
    texts = list(_texts(8, 500))
    counts, found = periodic._found([t.encode() for t in texts], power, least)
    assert counts == [len(_words(t)) for t in texts]
    assert [found.get(i, []) for i in range(len(texts))] == [_runs(_words(t), power, least) for t in texts]


def test_registered_query_equals_brute_force_on_a_whole_small_table(spark, tmp_path):
    texts = [None, "", " \n", "a", "b " * 7, "\u00a0 x" * 9, *(t for t in _texts(3, 250)), " ".join(f"u{i}" for i in range(5000)), "same word " * 30_000]
    rows = list(enumerate(texts)) + [(None, "c d " * 8), (None, None), (4, "b " * 7), (4, "b " * 7)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(queries.op13_periodic_runs(spark, str(tmp_path)).drop("n_words").collect(), key=str)
    want = []
    for doc_id, text in rows:
        w = _looped(doc_id, text)
        found = [(0, 60_000, 2)] if len(w) == 60_000 and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 else _runs(w)
        drop = {i for s, n, q in found for i in range(s + q, s + n)}
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        left = " ".join(x for i, x in enumerate(w) if i not in drop)
        milli = 1000 * best[1] // best[2] if found else None
        want.append((doc_id, len(found), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest()))
    assert [tuple(r) for r in got] == [tuple(r) for r in sorted((spark.createDataFrame(want, queries.op13_periodic_runs(spark, str(tmp_path)).drop("n_words").schema)).collect(), key=str)]
    assert sum(r.n_runs > 0 for r in got) > 60


def test_other_columns_stay_and_own_names_are_replaced(spark):
    docs = spark.createDataFrame([("k", "a a a a a a a b", None, 3)], "runs string, text string, extra string, n_words int")
    out = periodic.collapsed(docs, "text")
    assert out.columns == ["text", "extra", "n_words", "runs", "collapsed"]
    row = out.first()
    assert (row.n_words, row.collapsed, [tuple(r) for r in row.runs]) == (8, "a b", [(0, 7, 1)])
    assert periodic.collapsed(docs.where("false"), "text").count() == 0
