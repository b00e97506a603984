"""Packing, chat repair and neighbour search against their rules and brute force, and what edge cases give."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.llm import chat, neighbours, packing, queries


def test_bins_hold_every_piece_and_no_conflict(spark):
    rng = random.Random(4)
    rows = [(i, "x" * rng.choice([0, 3, 40, 70, 99, 100, 250, 1000]) + str(i % 7), rng.choice(["hot"] * 5 + ["a", "b", None]), "z") for i in range(700)]
    rows += [(1000, None, "a", "z"), (1001, "", "a", "z"), (None, "no id", "b", "z"), (1002, "same", "a", "z"), (1002, "same", "a", "z")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, bin_id string")
    pieces = packing.packed(table, "doc_id", "text", "source", capacity=100, per_source=2, shard=200).collect()
    texts = defaultdict(list)
    for i, t, s, _ in rows:
        texts[i].append((t or "", s or ""))
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append((p.start, p.end))
        by_bin[p.bin_id].append(p)
    for i, found in texts.items():
        spans = sorted(s for t, _ in found for s in ([(a, min(a + 100, len(t))) for a in range(0, len(t), 100)] or [(0, 0)]))
        assert sorted(by_doc[i]) == spans
    for held in by_bin.values():
        assert sum(p.end - p.start for p in held) <= 100
        assert sorted(p.place for p in held) == list(range(len(held)))
        named = [(texts[p.doc_id][0], p) for p in held if p.doc_id is not None]
        assert max(Counter(t for (t, _), p in named if t).values(), default=1) == 1
        assert max(Counter(s for (_, s), _ in named).values(), default=1) <= 2
    assert packing.packed(table.limit(0), "doc_id", "text", "source").collect() == []


def test_the_tightest_compatible_bin_is_taken():
    rng, sources, clusters = random.Random(8), list("aaaaaaaabc"), [None, None, 1, 2, 3]
    items = sorted(((rng.randrange(1, 60), rng.choice(sources), rng.choice(clusters)) for _ in range(600)), reverse=True, key=lambda x: x[0])
    bins = packing._Bins(100, 3, [s for _, s, _ in items], [c for _, _, c in items])
    assert bins.takers
    plain = []
    for size, source, cluster in items:
        fits = [(100 - sum(x[0] for x in b), i) for i, b in enumerate(plain) if sum(x[0] for x in b) + size <= 100 and sum(x[1] == source for x in b) < 3 and not (cluster and any(x[2] == cluster for x in b))]
        left = min((r for r, _ in fits), default=None)
        b, _ = bins.put(size, source, cluster)
        assert (b in [i for r, i in fits if r == left]) if fits else b == len(plain)
        if b == len(plain):
            plain.append([])
        plain[b].append((size, source, cluster))


def test_bins_as_texts(spark):
    table = spark.createDataFrame([(1, "abcdefgh", "a"), (2, "xyz", "a"), (3, None, "b")], "doc_id long, text string, source string")
    out = packing.texts(packing.packed(table, "doc_id", "text", "source", capacity=5), table, "doc_id", "text", "|").collect()
    assert sorted(r.text.replace("|", "") for r in out) == ["abcde", "fgh", "xyz"]  # the empty piece takes no room in a bin of another


def _least(codes):
    """The cheapest legal repair by trying every choice."""
    best = None
    for roles in itertools.product((1, 2, 3), repeat=len(codes)):
        for merges in itertools.product((False, True), repeat=len(codes)):
            state, cost = 0, 0
            for code, role, merged in zip(codes, roles, merges, strict=True):
                cost += chat.RELABEL * (code != role)
                if merged:
                    if state != role:
                        break
                    cost += chat.MERGE
                    continue
                path = chat.PATHS[state, role]
                if path is None:
                    break
                cost += chat.INSERT * len(path)
                state = role
            else:
                cost += chat.INSERT * len(chat.ENDING[state])
                best = cost if best is None else min(best, cost)
    return best


def test_repairs_cost_the_least():
    for n in range(1, 5):
        for codes in itertools.product(range(4), repeat=n):
            whole = chat.chained([chat.between(list(codes))])[1]
            split = chat.chained([chat.between(list(codes[: n // 2])), chat.between(list(codes[n // 2 :]))])[1]
            assert whole == split == _least(codes), codes


def _legal(text):
    state = 0
    for part in text.split(chat.CLOSED)[:-1]:
        role = chat.ROLES.index(part[2 : part.index("|>")]) + 1
        assert role in chat.LEGAL[state]
        state = role
    return state == chat.LAST and text.endswith(chat.CLOSED)


@pytest.mark.parametrize("partitions", [1, 7])
def test_repaired_conversations_are_legal_and_whole(spark, partitions):
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "Assistant ", "system", "bot", "tool", None]), f"c{c}t{t} <|x|>", 1) for c in range(30) for t in range(rng.randrange(1, 9))]
    rows += [(99, t, rng.choice(["user", "user", "assistant"]), f"c99t{t}", 1) for t in range(900)]
    rows += [(None, 1, "user", "c-", 1), (None, None, None, None, 1), (50, 1, "user", "twice", 1), (50, 1, "user", "twice", 1)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = chat.repaired(table, "conv_id", "turn", "role", "text").collect()
        assert chat.repaired(table.limit(0), "conv_id", "turn", "role", "text").collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(out) == len(rows)
    if partitions > 1:
        assert len({r.place >> 33 for r in out if r.conv_id == 99}) > 1
    texts, codes = defaultdict(str), defaultdict(list)
    for r in sorted(out, key=lambda r: r.place):
        texts[r.conv_id] += r.rendered
        codes[r.conv_id].append(r)
    assert all(_legal(t) for t in texts.values())
    for name, turns in codes.items():
        assert [r.turn for r in turns] == sorted((r.turn for r in turns), key=lambda t: (t is not None, t))
        assert all(f"c{name}t{r.turn}" in r.rendered for r in turns if name is not None and name != 50)
    roles = spark.createDataFrame([(r.conv_id, r.place, r.role, r.new_role, r.action, r.inserted) for r in out], "c long, p long, role string, n string, a string, i string")
    paid = roles.withColumn("code", chat.role_code(F.col("role"))).collect()
    for name in [*range(30), 99]:
        turns = sorted((r for r in paid if r.c == name), key=lambda r: r.p)
        cost = sum(chat.RELABEL * (r.code == 0 or chat.ROLES[r.code - 1] != r.n) + chat.MERGE * (r.a == "merge") + chat.INSERT * len([x for x in r.i.split(",") if x]) for r in turns)
        assert cost == chat.chained([chat.between([r.code for r in turns])])[1]


def test_neighbours_are_found_ranked_and_scored(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    out = neighbours.nearest(vectors, "vec_id", "embedding", vectors.where("vec_id % 20 = 0")).collect()
    rows = vectors.select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    found = defaultdict(list)
    for r in out:
        found[r.query_id].append(r)
    hits = 0
    for i in np.flatnonzero(ids % 20 == 0):
        mine = sorted(found[ids[i]], key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        s = x @ x[i]
        assert all(abs(s[ids == r.vec_id][0] - r.score) < 1e-12 for r in mine)
        s[i] = -np.inf
        hits += len(set(ids[np.lexsort((ids, -s))[:20]]) & {r.vec_id for r in mine})
    assert hits / (20 * len(found)) >= 0.9


def test_neighbours_of_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 0.0, 0.0] if i < 400 else rng.normal(size=3).tolist()) for i in range(600)]
    odd = [(700, None), (701, [0.0, 0.0, 0.0]), (702, [1.0, None, 0.0]), (703, [float("nan"), 0.0, 1.0]), (704, [float("inf"), 0.0, 1.0]), (705, [1.0]), (None, [1.0, 1.0, 1.0]), (20, [1.0, 0.0, 0.0])]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    out = neighbours.nearest(table, "vec_id", "embedding", table.where("vec_id IN (0, 20, 500, 700, 705)"), k=5).collect()
    found = defaultdict(list)
    for r in sorted(out, key=lambda r: r["rank"]):
        found[r.query_id].append(r.vec_id)
    assert found.keys() == {0, 20, 500}
    x = {i: np.array(v) for i, v in rows}
    for q in (0, 20):  # the largest inner products, with copies by the smaller id
        best = sorted((i for i in x if i != q), key=lambda i: (-(x[i] @ x[q]), i))[:5]
        assert len(set(best) & set(found[q])) >= 4
    assert not set(found[500]) & {500, 700, 701, 702, 703, 704, 705, None}
    few = table.where("vec_id < 3")
    assert neighbours.nearest(few, "vec_id", "embedding", few, k=5).groupBy("query_id").count().select("count").distinct().collect()[0][0] == 2
    assert neighbours.nearest(table.limit(0), "vec_id", "embedding", table, k=5).collect() == []


def test_neighbours_of_uneven_norms(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(4000, 16)) * np.exp(rng.normal(size=(4000, 1)))
    x[:3] *= 40
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = defaultdict(set)
    for r in neighbours.nearest(table, "vec_id", "embedding", table.where("vec_id % 20 = 5")).collect():
        found[r.query_id].add(r.vec_id)
    hits = 0
    for i in range(5, 4000, 20):
        s = x @ x[i]
        s[i] = -np.inf
        hits += len(set(np.argsort(-s, kind="stable")[:20].tolist()) & found[i])
        assert len(found[i]) == 20
    assert hits / (20 * 200) >= 0.95


def test_a_search_goes_on_until_leaves_hold_enough_rows():
    tree = neighbours.grow(np.random.default_rng(2).normal(size=(500, 4)))
    rows = {leaf: 1 for leaf in range(tree.leaves)}
    assert len(tree.best_bins(np.zeros(4), 1, rows, 4)) == 4 and len(tree.best_bins(np.zeros(4), 5, rows, 4)) == 5
    assert len(tree.best_bins(np.zeros(4), 1, rows, 10**6)) == tree.leaves


def test_near_copies_share_no_bin(spark, tmp_path):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{words} {'end' if i % 2 else 'END  stop'}", f"s{i}") for i in range(12)] + [(100 + i, f"other text number {i} of {i * i}", f"t{i}") for i in range(12)]
    rows += [(None, rows[0][1], "n"), (None, "", "n"), (200, None, "n"), (3, rows[3][1], "r")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    pieces = queries.op6_best_fit_packing(spark, str(tmp_path)).collect()
    assert len(pieces) == len(rows)
    copies = Counter(p.bin_id for p in pieces if (p.doc_id is None and p.end) or (p.doc_id is not None and p.doc_id < 12))
    assert len(copies) == 14 and set(copies.values()) == {1}
    assert len({p.bin_id for p in pieces}) == 14
