"""Near copies by sketches against brute force, and what edge cases give."""

import itertools
import random
import re

import numpy as np
import pytest

from claimloom.llm import hyperminhash
from claimloom.llm.bytescan import mix


def _texts(seed):
    """Large families of edited copies, texts that share a passage, and short ones."""
    rng, docs = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(400)]
    for copies in (5, 60, 90, 3, 30):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([14, 40, 80, 150]))]
        for _ in range(copies):
            words = base[:]
            for _ in range(rng.choice([0, 1, 1, 1, 2, 2, 3, 4])):
                i, how = rng.randrange(len(words)), rng.random()
                if how < 0.5:
                    words[i] = rng.choice(vocabulary[:6])
                elif how < 0.75:
                    del words[i]
                else:
                    words.insert(i, rng.choice(vocabulary[:6]))
            docs.append(" ".join(words))
    passage = [rng.choice(vocabulary) for _ in range(60)]
    docs += [" ".join(passage + [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 6, 9, 12, 60]))]) for _ in range(40)]
    docs += ["", " \t\n", "a", "A b", "a b", None, "a b c d", "A B C D", "É b c d e f", "é b c d e f"]
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


@pytest.mark.parametrize(("size", "percent", "seed"), [(5, 85, 1), (5, 85, 2), (3, 80, 3)])
def test_components_equal_brute_force(spark, size, percent, seed):
    texts = _texts(seed)
    sets = [_shingles(t, size) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in hyperminhash.deduplicated(docs, "doc_id", "text", size, percent).collect()}
    assert got == {i: (len(s), c, c == i) for i, (s, c) in enumerate(zip(sets, _components(sets, percent), strict=True))}


def test_links_of_two_sets_that_the_pivot_is_not_linked_with_are_looked_up(spark):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(200)]
    texts = [" ".join(base)]
    for k in range(6):  # pairs that are linked with each other by the same edits, with the base by none
        edited = base[:]
        for i in rng.sample(range(200), 9):
            edited[i] = f"x{k}.{i}"
        texts += [" ".join(edited), " ".join(edited[:-1] + ["end"])]
    sets = [_shingles(t, 5) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    signed = hyperminhash.sketched(docs, 5, 85)
    keys = {r.id: r.key for r in signed.collect()}
    # every set as a set of one pivot, nothing linked before
    pairs = spark.createDataFrame([(keys[i], keys[0]) for i in range(1, len(texts))], "a long, b long")
    full = hyperminhash._shingled(docs, hyperminhash.distinct_sets(signed), 5)
    found = {frozenset(r) for r in hyperminhash._looked_up(pairs, pairs.where("false"), full, 85).collect()}
    want = {
        frozenset((keys[i], keys[j])) for i, j in itertools.combinations(range(1, len(texts)), 2)
        if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])
    }
    assert len(want) == 6 and want <= found and len(found) < 66


def test_estimates_are_close_and_corrected_for_collisions():
    rng = np.random.default_rng(4)
    for n, share in ((9, 0.0), (60, 0.5), (500, 0.85), (4000, 0.2), (20_000, 0.9)):
        errors = []
        for _ in range(40):
            union = mix(rng.integers(1, 1 << 62, n).astype(np.uint64))
            common = int(round(n * share))
            rest = n - common
            a, b = np.sort(union[: common + rest // 2]), np.sort(np.concatenate((union[:common], union[common + rest // 2 :])))
            r = hyperminhash.registers([a, b])
            errors.append(hyperminhash.estimated(r[:1], r[1:], np.array([len(a)]), np.array([len(b)]))[0] - common / n)
        assert abs(np.mean(errors)) < 0.03 and max(map(abs, errors)) < hyperminhash.MARGIN
    unlike = [np.sort(mix(rng.integers(1, 1 << 62, 3000).astype(np.uint64))) for _ in range(300)]
    r = hyperminhash.registers(unlike)
    met = np.mean([(r[i] == r[i + 1]).mean() for i in range(299)])
    assert abs(met - hyperminhash.collisions(np.array([3000.0]), np.array([3000.0]))[0]) < 2e-4


def test_rows_without_id_repeated_rows_other_columns_and_an_empty_table(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(5, text, "a", 1), (5, text, "a", 1), (None, text, "a", 1), (7, text.upper(), "b", 2), (8, None, "c", 3), (None, None, "d", 4), (9, "", "e", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string, n int")
    got = sorted(map(tuple, hyperminhash.deduplicated(docs, "doc_id", "text").collect()), key=str)
    want = [(5, 8, 5, True), (5, 8, 5, True), (None, 8, None, True), (7, 8, 5, False), (8, 0, 8, True), (None, 0, None, True), (9, 0, 9, True)]
    assert got == sorted(want, key=str)
    assert hyperminhash.deduplicated(docs.where("false"), "doc_id", "text").count() == 0


def test_a_pivot_is_sent_once_for_every_part_of_its_sets_and_all_pairs_meet_it(spark):
    per = hyperminhash.PER_SALT
    pairs = spark.createDataFrame([(i, 1_000_000) for i in range(2 * per + 5)] + [(i, 2_000_000 + i) for i in range(40)], "a bigint, b bigint")
    _, counts = hyperminhash.salted(pairs)
    keys = [(i, f"x{i}") for i in [*range(2 * per + 5), 1_000_000, *range(2_000_000, 2_000_040)]]
    table = spark.createDataFrame(keys, "key bigint, name string")
    sent = hyperminhash._sent(table.withColumnRenamed("key", "b"), counts).groupBy("b").count().collect()
    assert {r.b: r["count"] for r in sent} == {1_000_000: 3, **{2_000_000 + i: 1 for i in range(40)}}
    met = {(r.a, r.b, r.name_a, r.name_b) for r in hyperminhash.beside(pairs, table, ["name"]).collect()}
    assert met == {(r.a, r.b, f"x{r.a}", f"x{r.b}") for r in pairs.collect()}


def test_unlike_sets_of_one_pivot_are_not_compared_for_the_one_difference_they_share(spark, monkeypatch):
    rng, rows = random.Random(7), []
    words = [f"w{i}" for i in range(120)]
    rows.append(" ".join(words))
    for k in range(60):  # each replaces a stretch of its own; few of the others' edits are the same
        edited, at = words[:], rng.randrange(5, 90)
        edited[at : at + 12] = [f"n{k}_{i}" for i in range(12)]
        edited[2] = "same"
        rows.append(" ".join(edited))
    seen, kept = {}, hyperminhash.written
    monkeypatch.setattr(hyperminhash, "written", lambda df, name: seen.setdefault(name, []).append(out := kept(df, name)) or out)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in hyperminhash.deduplicated(docs, "doc_id", "text", 5, 85).collect()}
    assert got == dict(enumerate(_components([_shingles(t, 5) for t in rows], 85)))
    assert seen["looked_up"][0].count() < 60
