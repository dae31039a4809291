import random

import numpy as np
from brute import components as plain

from tessera.llm import graph
from tessera.sources.scratch import Scratch


def found(spark, links):
    df = spark.createDataFrame(links, "a long, b long")
    rows = graph.components(df, Scratch(spark, "test")).collect()
    assert len(rows) == len({r["node"] for r in rows})
    return {r["node"]: r["component"] for r in rows}


def test_components_match_plain_search(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    links += [(1000 + k, 1001 + k) for k in range(60)]  # a long path
    links += [(2000 + k, 2500) for k in range(200)]  # a star
    links += links[:20] + [(b, a) for a, b in links[:20]] + [(7, 7)]
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert found(spark, links) == plain(nodes, links)


def test_no_links(spark):
    assert found(spark, []) == {}


def test_pairs_and_roots():
    begins = np.array([1, 0, 0, 1, 1, 0], bool)
    got = [(a, b) for i, j in graph.pairs(begins, 2) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    assert sorted(got) == [(0, 1), (0, 2), (1, 2), (4, 5)]
    assert graph.roots(6, np.array([5, 1]), np.array([1, 3])).tolist() == [0, 1, 2, 1, 4, 1]


def test_every_pair_of_a_large_group_meets_once(spark, monkeypatch):
    monkeypatch.setattr(graph, "SLICE", 4)
    members = spark.range(30).selectExpr("id as node", "1L as key", "30L as size")
    rows = graph.blocks(members, "key", "size", "node").collect()
    dealt = {}
    for r in rows:
        dealt.setdefault((r["i"], r["j"]), []).append((r["node"], r["slice"]))
    met = [frozenset((a, b)) for (i, j), own in dealt.items() for a, s in own for b, t in own if a < b and (i == j or s != t)]
    assert len(met) == len(set(met)) == 30 * 29 // 2
