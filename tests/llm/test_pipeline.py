"""The corpus pipeline, stage by stage, against brute force on a small table."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
from claimloom.sources.scratch import written

FOLDER = "/root/testdata/sf0.001"


def _shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _first_of_groups(docs):
    sets, holders = {d.doc_id: _shingles(d.text, 5) for d in docs}, defaultdict(list)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        for j in {j for s in sets[i] for j in holders[s]}:
            common = len(sets[i] & sets[j])
            if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for s in sets[i]:
            holders[s].append(i)
    return {i for i in sets if root(i) == i}


def test_stages_do_what_brute_force_does(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    extra = [(10**6, None, None, "s", None), (10**6 + 1, "12 34 ?!", None, "s", 8), (10**6 + 2, 'the key is token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" here ' * 3, "en", "s", None)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_copies", "decontamination", "secrets", "packing"]
    before = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, FOLDER), f"test_{name}")
        after = docs.collect()
        kept = Counter(d.doc_id for d in after)
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and max(kept.values()) == 1
        if name == "language":
            assert set(kept) == {d.doc_id for d in before} - {10**6, 10**6 + 1}
            assert all(d.lang for d in after)
        if name == "near_copies":
            assert set(kept) == _first_of_groups(before)
        if name == "decontamination":
            windows = set()
            for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
                w = _words(r.text)
                windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
            assert all(len(w) == 13 for w in windows)
            now = {d.doc_id: d for d in after}
            for d in before:
                w = _words(d.text)
                hit = {j for i in range(len(w) - 12) if tuple(w[i : i + 13]) in windows for j in range(i, i + 13)}
                assert (d.doc_id in now) == (not hit or 20 * len(hit) < len(w))
                if d.doc_id in now:
                    assert _words(now[d.doc_id].text) == [x for j, x in enumerate(w) if j not in hit]
        if name == "secrets":
            now = {d.doc_id: d for d in after}
            assert now.keys() == {d.doc_id for d in before}
            for d in before:
                found = re.search(r"(?:token = \"|password=|AKIA)", d.text)
                assert found or now[d.doc_id].text == d.text
                assert now[d.doc_id].n_chars == len(now[d.doc_id].text)
            assert "9f86d081884c7d65" not in now[10**6 + 2].text
        if name == "packing":
            spans = defaultdict(list)
            for p in after:
                spans[p.doc_id].append((p.start, p.end))
            assert all(sum(b - a for a, b in spans[d.doc_id]) == len(d.text) for d in before)
        before = after


def test_run_applies_all_stages(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 100


def test_one_row_of_an_id_and_of_equal_texts_without_id_stays(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    long, other = ("some words that make a document long enough to compare " * 3).strip(), "another text that nothing else in this small table is like at all"
    rows = [(1, long, "en", "a", 9), (1, long, "en", "a", 9), (2, other, "en", "b", 9), (2, other + " ever", "en", "b", 9), (None, long, "en", "c", 9)]
    rows += [(None, "free text without an id", "en", s, 9) for s in "xyz"] + [(None, "", None, "n", 0), (None, "", None, "n", 0), (None, None, None, "n", None)]
    table = spark.createDataFrame(rows, docs.schema)
    kept = corpus_pipeline.drop_near_copies(spark, table, FOLDER).collect()
    assert Counter(d.doc_id for d in kept) == {1: 1, 2: 1, None: 4}
    assert sorted(str(d.text) for d in kept if d.doc_id is None) == ["", "", "None", "free text without an id"]


def test_columns_that_stages_add_don_t_meet_columns_of_the_input(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60)
    names = ["score", "similarity", "rejected", "lang_pred", "n_words", "removal", "hit_items", "findings", "slot", "count", "id", "size"]
    wide = docs.selectExpr("*", *[f"concat('{n}', doc_id) AS {n}" for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        wide = written(stage(spark, wide, FOLDER), f"wide_{name}")
        assert wide.columns == [*docs.columns, *names]
        assert wide.where(" OR ".join(f"{n} <> concat('{n}', doc_id)" for n in names)).count() == 0
    assert corpus_pipeline.pack_bins(spark, wide, FOLDER).columns == corpus_pipeline.pack_bins(spark, docs, FOLDER).columns
