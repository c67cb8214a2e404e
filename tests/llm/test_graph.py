"""Connected components from links that come bit by bit, and the work they cost."""

import random

from wayfold.llm import graph


def brute(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in root}


def edges(spark, links):
    return spark.createDataFrame(links, "a long, b long")


def test_links_that_come_bit_by_bit(spark, monkeypatch):
    rng = random.Random(3)
    parts = [[(i, i + 1) for i in range(20)] + [(50, i) for i in range(60, 70)], [], [(rng.randrange(100), rng.randrange(200)) for _ in range(30)]]
    written, write = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df: written.append(1) or write(df))
    roots, known = graph.Rooted(), []
    for some in parts:
        before = len(written)
        roots.add(edges(spark, some))
        known += [(a, b) for a, b in some if a != b]
        assert some or len(written) == before  # nothing new, nothing done
        named = roots.name(spark.range(210).select("id")).collect()
        assert {r.id: r.root for r in named} == {i: brute(known).get(i, i) for i in range(210)}


def test_stars_need_no_round(spark, monkeypatch):
    written, write = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df: written.append(1) or write(df))
    found = {r.node: r.root for r in graph.components(edges(spark, [(1, i) for i in range(2, 9)] + [(20, 21)])).collect()}
    assert found == brute([(1, i) for i in range(2, 9)] + [(20, 21)])
    assert len(written) == 1
