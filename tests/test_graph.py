import random

import pytest

from tabguard.operators import graph
from tabguard.operators.graph import components


def brute(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


@pytest.mark.parametrize("kind", ["chain", "star", "random", "shuffled chain", "none", "loop"])
def test_components(spark, kind):
    r = random.Random(kind)
    edges = {
        "chain": [(i, i + 1) for i in range(60)],
        "star": [(0, i) for i in range(1, 80)],
        "random": [(r.randrange(150), r.randrange(150)) for _ in range(110)],
        "none": [],
        "loop": [(5, 5), (7, 8), (8, 7)],
    }
    if kind == "shuffled chain":
        names = r.sample(range(1000), 50)
        edges[kind] = list(zip(names, names[1:]))
    found = components(spark.createDataFrame(edges[kind], "a long, b long"))
    want = {x: y for x, y in brute([e for e in edges[kind] if e[0] != e[1]]).items()}
    assert {r["node"]: r["label"] for r in found.collect()} == want


def test_large_graphs_are_joined(spark, monkeypatch):
    monkeypatch.setattr(graph, "BROADCAST_NODES", -1)
    r = random.Random(7)
    edges = [(r.randrange(90), r.randrange(90)) for _ in range(60)] + [(0, i) for i in range(100, 160)]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {x["node"]: x["label"] for x in found} == {k: v for k, v in brute(edges).items() if any(k in e and e[0] != e[1] for e in edges)}
