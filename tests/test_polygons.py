"""Points in rings by cells against the plain count of crossings."""

import math
import random

import pytest

from placeweave.operators import polygons


def inside(x, y, ring):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def star(rng, n, x, y, r):
    return [(x + r * rng.uniform(0.4, 1) * math.cos(2 * math.pi * k / n), y + r * rng.uniform(0.4, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)]


@pytest.mark.parametrize("cell", [0.05, 0.4, 9.0])
def test_in_rings(spark, cell):
    rng = random.Random(5)
    rings = {1: star(rng, 60, 0, 0, 2), 2: star(rng, 7, 1, 1, 1), 3: [(-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0), (-1.0, -1.0)], 4: [(0.0, 0.0), (1.0, 1.0)], 5: [(rng.uniform(-2, 2), rng.uniform(-2, 2)) for _ in range(9)]}
    points = [(k, rng.uniform(-2.2, 2.2), rng.uniform(-2.2, 2.2)) for k in range(400)] + [(900, None, 0.0)] + [(1000 + k, 0.31, 0.17) for k in range(50)]
    df = spark.createDataFrame(points, "id long, lon double, lat double")
    v = spark.createDataFrame([(r, k, *p) for r, ps in rings.items() for k, p in enumerate(ps)], "ring long, pos int, lon double, lat double")
    got = {(r["id"], r["ring"]) for r in polygons.in_rings(df, v, cell).select("id", "ring").collect()}
    assert got == {(i, r) for i, x, y in points if x is not None for r, ps in rings.items() if len(ps) > 2 and inside(x, y, ps)}


def test_a_large_ring(spark):
    rng = random.Random(6)
    ring = star(rng, 20_000, 0, 0, 3)
    points = [(k, rng.uniform(-3, 3), rng.uniform(-3, 3)) for k in range(300)]
    v = spark.createDataFrame([(1, k, *p) for k, p in enumerate(ring)], "ring long, pos int, lon double, lat double")
    got = {r["id"] for r in polygons.in_rings(spark.createDataFrame(points, "id long, lon double, lat double"), v, 0.1).collect()}
    assert got == {i for i, x, y in points if inside(x, y, ring)}


def test_holes(spark):
    box = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    rows = [("p", 1, False, box(0.0, 4.0)), ("p", 2, True, box(1.0, 2.0)), ("p", 3, False, box(6.0, 7.0)), ("q", 4, False, box(1.0, 6.5))]
    v = spark.createDataFrame([(p, r, h, k, *xy) for p, r, h, ps in rows for k, xy in enumerate(ps)], "polygon string, ring long, hole boolean, pos int, lon double, lat double")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 6.2, 6.2), (4, 9.0, 9.0)], "id long, lon double, lat double")
    assert {tuple(r) for r in polygons.in_polygons(points, v, 0.7, "id").collect()} == {(1, "p"), (2, "q"), (3, "p"), (3, "q")}


@pytest.mark.parametrize("finest", [1, 32])
def test_finer_cells_and_dealt_points(spark, monkeypatch, finest):
    from placeweave.operators import match

    rng = random.Random(7)
    ring = star(rng, 300, 0, 0, 3)
    monkeypatch.setattr(polygons, "FINEST", finest)
    monkeypatch.setattr(polygons, "PASSED", 0)  # edges cost nothing: the finest cells
    monkeypatch.setattr(polygons, "LISTED", 0)
    monkeypatch.setattr(match, "TOGETHER", 4)  # cells of more points are dealt
    v = spark.createDataFrame([(1, k, *p) for k, p in enumerate(ring)] + [(2, k, 10 + x, 10 + y) for k, (x, y) in enumerate([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)])], "ring long, pos int, lon double, lat double")
    cell = polygons.fitting(polygons.edges(v), 1000, 0.8)
    assert cell == 0.8 / finest
    points = [(k, rng.uniform(-3, 3), rng.uniform(-3, 3)) for k in range(300)] + [(900, 0.1, 0.1)] * 25 + [(1000 + k, 12.0, 12.1) for k in range(25)]
    got = polygons.in_rings(spark.createDataFrame(points, "id long, lon double, lat double"), v, 0.8).collect()
    assert sorted((r["id"], r["ring"]) for r in got) == sorted([(i, 1) for i, x, y in points if inside(x, y, ring)] + [(1000 + k, 2) for k in range(25)])


def test_top_up_in_rounds(spark, sf_dir, monkeypatch):
    from placeweave.plans import regions

    want = regions.e23_bounded(spark, sf_dir).collect()
    monkeypatch.setattr(regions, "FIRST_RANKS", 1)
    got = regions.e23_bounded(spark, sf_dir).collect()
    assert got == want and got
