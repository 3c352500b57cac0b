"""Connected components against a search."""

import random

import pytest

from anomspark.llm.components import components


@pytest.mark.parametrize("forest_edges", [500_000, 40])
def test_against_search(spark, forest_edges):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1060)]
    edges += [(2000, 2000 + k) for k in range(80)] + [(-5, 1010), (7, 7)] + [(1, 2)] * 5
    comp = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(len(comp)):
        for a, b in edges:
            if a != b:
                comp[a] = comp[b] = min(comp[a], comp[b])
    out = components(spark.createDataFrame(edges, "a long, b long").repartition(3), forest_edges).collect()
    assert sorted(map(tuple, out)) == sorted(comp.items())
    assert components(spark.createDataFrame([], "a long, b long"), forest_edges).count() == 0
