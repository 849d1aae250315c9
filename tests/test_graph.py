"""Components, closures and cycles against plain walks."""

import random

import pytest

from placeweave.operators import graph


@pytest.mark.parametrize("kind", ["random", "chain", "hub", "grid", "loops"])
def test_components(spark, kind):
    rng = random.Random(kind)
    edges = {
        "random": [(rng.randrange(120), rng.randrange(120)) for _ in range(90)],
        "chain": [(k, k + 1) for k in rng.sample(range(100), 100) if k % 37],
        "hub": [(50, k) for k in range(100)] + [(200, 201)],
        "grid": [(10 * a + b, 10 * a + b + 1) for a in range(6) for b in range(8)] + [(10 * a, 10 * a + 10) for a in range(4)],
        "loops": [(1, 1), (2, 3), (3, 2), (2, 3)],
    }[kind]
    root = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    got = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len(root) and {r.node: r.component for r in got} == root


def test_closure_with_a_long_chain_before_a_cycle(spark):
    links = [(k, k + 1) for k in range(60)] + [(60, 57)] + [(100, 101), (101, 102), (200, 201), (201, 200), (300, 200)]
    step = dict(links)
    got = {r.a: r.root for r in graph.closure(spark.createDataFrame(links, "a long, b long")).collect()}
    cycle = {57, 58, 59, 60, 200, 201}
    want = {}
    for a in step:
        if a in cycle:
            continue
        b = step[a]
        while b in step and b not in cycle:
            b = step[b]
        want[a] = b
    assert got == want
