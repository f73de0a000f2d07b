import random

import pytest

from strandline.llm.components import components


def brute(edges):
    root = {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is None or b is None:
            continue
        for x in (a, b):
            root.setdefault(x, x)
        root[find(a)] = find(b)
    groups = {}
    for x in root:
        groups.setdefault(find(x), set()).add(x)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


@pytest.mark.parametrize("small", [0, 70, 200_000])
@pytest.mark.parametrize("kind", ["random", "chain", "star", "empty"])
def test_components(spark, kind, small):
    rng = random.Random(3)
    edges = {
        "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(None, 1), (2, None)],
        "chain": [(i, i + 1) for i in range(150)],
        "star": [(0, i) for i in range(200)] + [(0, 1)] * 5,
        "empty": [],
    }[kind]
    groups = {}
    for r in components(spark.createDataFrame(edges, "a long, b long"), small=small).collect():
        groups.setdefault(r.root, set()).add(r.id)
    assert {frozenset(g) for g in groups.values()} == brute(edges)
