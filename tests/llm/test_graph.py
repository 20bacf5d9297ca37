"""Connected components."""

import random

from chatmill.llm.graph import components


def test_components_of_chains_stars_and_random_graphs(spark, rows):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + k) for k in range(1, 40)]
    edges += [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(150)] + [(7, 7)]
    edges += [(500 - k, 501 - k) for k in range(40)] + edges[:5]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r["node"]: r["component"] for r in components(rows(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in got} and set(got) == {x for e in edges for x in e if e[0] != e[1]}


def test_no_edges(spark, rows):
    assert components(rows([], "a long, b long")).collect() == []
