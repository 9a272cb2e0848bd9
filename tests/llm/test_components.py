import random

import pytest

from blockloom.llm.components import components


def expected(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {v: root(v) for v in list(parent) if root(v) != v}


RANDOM = [(random.Random(i).randrange(300), random.Random(i + 10_000).randrange(300)) for i in range(220)]


@pytest.mark.parametrize(
    "edges", [[], [(1, 1)], [(1, 2), (2, 1), (1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 50)], [(9, i) for i in range(9)], RANDOM]
)
def test_components(spark, edges):
    found = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.v: r.root for r in found.collect()} == expected(edges)
