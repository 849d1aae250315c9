"""Parallel greedy rounds against the sequential walk."""

import random

import pytest

from placeweave.operators import greedy


def walk(nodes, edges):
    near = {n: set() for n in nodes}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    centre = {}
    for k, n in enumerate(nodes):
        if n in centre:
            continue
        centre[n] = n
        for m in nodes[k + 1 :]:
            if m in near[n] and m not in centre:
                centre[m] = n
    return centre


@pytest.mark.parametrize("kind", ["chain", "random", "dense", "none"])
def test_stars(spark, kind):
    rng = random.Random(3)
    nodes = list(range(60))
    rng.shuffle(nodes)
    edges = {
        "chain": [(nodes[i], nodes[i + 1]) for i in range(59)],
        "random": [tuple(rng.sample(nodes, 2)) for _ in range(70)],
        "dense": [(a, b) for a in nodes[:25] for b in nodes[:25] if a != b] + [(nodes[3], nodes[40])],
        "none": [],
    }[kind]
    df = spark.createDataFrame([(n, k) for k, n in enumerate(nodes)], "node long, rank long")
    got = {r["node"]: r["centre"] for r in greedy.stars(df, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == walk(nodes, edges)


@pytest.mark.parametrize("most", [3, 1000])
def test_spaced(spark, most):
    rng = random.Random(4)
    points = [(name, k, rng.random() * size, rng.random() * size) for name, n, size in (("a", 250, 4.0), ("b", 40, 1.2), ("c", 1, 1.0)) for k in range(n)]
    points += [("d", k, 0.5, 0.5) for k in range(30)]  # one place
    want = set()
    for name in "abcd":
        chosen = []
        for _, rank, x, y in sorted(p for p in points if p[0] == name):
            if len(chosen) < most and all((x - a) ** 2 + (y - b) ** 2 >= 0.25 for _, a, b in chosen):
                chosen.append((rank, x, y))
        want |= {(name, rank) for rank, _, _ in chosen}
    df = spark.createDataFrame(points, "name string, rank long, x double, y double")
    assert {tuple(r) for r in greedy.spaced(df, 0.5, most).collect()} == want
    assert greedy.spaced(df.limit(0), 0.5, most).count() == 0


def test_unoccupied(spark):
    rng = random.Random(6)
    items = [(k, rank, [rng.randrange(40) for _ in range(rng.randint(0, 4))]) for k, rank in enumerate(rng.sample(range(500), 120))] + [(900, 900, None)]
    used, want = set(), set()
    for k, _, cells in sorted(items, key=lambda x: x[1]):
        if not used & set(cells or []):
            want.add(k)
            used |= set(cells or [])
    assert {r.node for r in greedy.unoccupied(spark.createDataFrame(items, "node long, rank long, cells array<int>")).collect()} == want
