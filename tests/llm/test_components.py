import random

from claimloom.llm import components


def _smallest(edges):
    name = {n: n for e in edges for n in e}
    while any(name[a] != name[b] for a, b in edges):
        for a, b in edges:
            name[a] = name[b] = min(name[a], name[b])
    return {n: c for n, c in name.items() if any(n in e and e[0] != e[1] for e in edges)}


def _counted(monkeypatch):
    steps, kept = [], components.written
    monkeypatch.setattr(components, "written", lambda df, name: steps.append(name) or kept(df, name))
    return steps


def test_components_are_known_by_their_smallest_node(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(90), rng.randrange(90)) for _ in range(70)] + [(200 + i, 201 + i) for i in range(9)] + [(300, 300), (7, 3), (3, 7), (3, 7)]
    found = components.components(spark.createDataFrame(edges, "x bigint, y bigint"), "x", "y").collect()
    assert len(found) == len({r.node for r in found})
    assert {r.node: r.component for r in found} == _smallest(edges)


def test_stars_need_no_step_and_a_chain_ends_with_its_last(spark, monkeypatch):
    edges = [(i, 1) for i in range(2, 9)] + [(11, 10), (10, 11), (12, 10), (12, 10), (5, 5)]
    steps = _counted(monkeypatch)
    found = components.stars(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert sorted(map(tuple, found.collect())) == sorted({(a, b) for a, b in edges if a > b}) and not steps
    components.components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()
    assert len(steps) == 1  # the distinct edges
    assert components.stars(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_a_link_between_stars_is_added_to_them(spark, monkeypatch):
    edges = [(i, 1) for i in range(2, 9)] + [(i, 20) for i in range(21, 30)] + [(4, 25)]
    steps = _counted(monkeypatch)
    found = components.with_roots(components.stars(spark.createDataFrame(edges, "a bigint, b bigint"))).collect()
    assert {r.node: r.component for r in found} == _smallest(edges) and len(found) == 18
    assert len(steps) <= 2
