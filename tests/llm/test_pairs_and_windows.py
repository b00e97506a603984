"""Near copies and benchmark passages against brute force, and what edge cases give."""

import itertools
import random
import re

import pytest

from claimloom.llm import decontaminate, jaccard

DOCS = "doc_id long, text string, n_words string, removal int"


def _family_texts(seed):
    """Families of edited copies, texts that share a passage, and short ones."""
    rng, docs = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(400)]
    for _ in range(5):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([12, 40, 80, 120]))]
        for _ in range(rng.choice([5, 40])):
            words = base[:]
            for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4, 6])):
                i, how = rng.randrange(len(words)), rng.random()
                if how < 0.5:
                    words[i] = rng.choice(vocabulary[:6])
                elif how < 0.75:
                    del words[i]
                else:
                    words.insert(i, rng.choice(vocabulary[:6]))
            docs.append(" ".join(words))
    passage = [rng.choice(vocabulary) for _ in range(30)]
    docs += [" ".join(passage + [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 3, 8, 60]))]) for _ in range(30)]
    docs += ["", " \t\n", "a", "A b", "a b", None, "a b c", "A B C", "É b c d", "é b c d"]
    rng.shuffle(docs)
    return docs


def _shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def _components(sets, percent):
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(sets)), 2):
        common = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return [root(i) for i in range(len(sets))]


@pytest.mark.parametrize(("size", "percent", "seed"), [(3, 90, 3), (5, 80, 4)])
def test_jaccard_join_finds_the_components_that_brute_force_finds(spark, size, percent, seed):
    texts = _family_texts(seed)
    sets = [_shingles(t, size) for t in texts]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.joined(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text", size, percent).collect()}
    assert got == {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, _components(sets, percent), strict=True))}


def test_jaccard_join_of_rows_without_id_repeated_rows_and_an_empty_table(spark):
    rows = [(5, "x y z q", "a", 1), (5, "x y z q", "a", 1), (None, "x y z q", "a", 1), (7, "x y z q", "b", 2), (8, None, "c", 3)]
    table = spark.createDataFrame(rows, "doc_id long, text string, key string, n int")
    got = sorted(map(tuple, jaccard.joined(table, "doc_id", "text").collect()), key=str)
    assert got == sorted([(5, 1, 5), (5, 1, 5), (None, 1, None), (7, 1, 5), (8, 0, 8)], key=str)
    assert jaccard.joined(table.limit(0), "doc_id", "text").collect() == []


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _marked(text, items, window):
    words, hit, found = _words(text), set(), set()
    for item, passage in items:
        p = _words(passage)
        for i in range(len(p) - min(window, len(p)) + 1 if p else 0):
            w = p[i : i + window]
            for j in range(len(words) - len(w) + 1):
                if words[j : j + len(w)] == w:
                    hit |= set(range(j, j + len(w)))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block_words", [10**6, 60])
def test_decontamination_finds_what_brute_force_finds(spark, block_words):
    rng = random.Random(9)
    vocabulary = ["the", "of", "añb", "x1", "to", "Ünd", "run", "go"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 6, 20, 40])))) for i in range(12)]
    items += [(11, "the of"), (20, None), (21, "--"), (22, items[3][1])]
    docs = []
    for i in range(60):
        words = [rng.choice([*vocabulary, "other", "else"]) for _ in range(rng.randrange(0, 60))]
        p = _words(rng.choice(items[:12])[1])
        at = rng.randrange(0, len(words) + 1)
        docs.append((i, rng.choice([" ", "-", " \n"]).join(words[:at] + p + words[at:]), "a", 1))
    docs += [(100, None, "a", 1), (101, "", "a", 1), (102, "?!", "a", 1), (103, docs[0][1], "a", 1), (103, docs[0][1], "a", 1), (None, docs[1][1], "a", 1), (104, "the of " * 3000, "a", 1)]
    table, benchmark = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.marked(table, "text", benchmark, "item_id", "text", window=5, block_words=block_words)
    rows = found.select("doc_id", "text", "n_words", decontaminate.n_hit().alias("n_hit"), "hit_items", "removal", decontaminate.without_spans("text").alias("rest")).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.n_hit, list(r.hit_items)) == _marked(r.text, items, 5)
        if r.text:
            cut = [r.text[s.start : s.end] for s in r.removal]
            assert [len(_words(c)) for c in cut] == [s.word_to - s.word_from for s in r.removal]
            assert len(r.rest) == len(r.text) - sum(map(len, cut))
    assert decontaminate.marked(table.limit(0), "text", benchmark, "item_id", "text").collect() == []
    none = decontaminate.marked(table, "text", benchmark.limit(0), "item_id", "text").agg({"n_words": "sum"}).first()[0]
    assert none == sum(len(_words(d[1])) for d in docs)
