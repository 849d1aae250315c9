"""Hulls, spreads and largest balls against all pairs."""

import math
import random

import numpy as np
import pytest

from placeweave.operators import spread


def points_of(kind, rng):
    return {
        "cloud": lambda: [(rng.gauss(0, 1), rng.gauss(0, 3)) for _ in range(200)],
        "circle": lambda: [(math.cos(k), math.sin(k)) for k in range(500)],
        "line": lambda: [(k * 0.5, k * 1.5) for k in range(20)],
        "grid": lambda: [(float(a), float(b)) for a in range(5) for b in range(4)],
        "one": lambda: [(1.0, 2.0)] * 5,
        "two": lambda: [(1.0, 2.0), (4.0, 6.0)] * 3,
    }[kind]()


@pytest.mark.parametrize("kind", ["cloud", "circle", "line", "grid", "one", "two"])
def test_diameter(kind):
    p = np.array(points_of(kind, random.Random(1)))
    for scale in ((1.0, 1.0), (100.0, 3.0)):
        q = p * np.array(scale)
        assert math.isclose(spread.diameter(spread.hull(p), scale), np.sqrt(((q[:, None] - q[None]) ** 2).sum(-1)).max(), abs_tol=1e-9)


def test_spreads_of_groups(spark):
    rng = random.Random(2)
    rows = [(k, *xy) for k, kind in enumerate(["cloud", "circle", "line", "one"]) for xy in points_of(kind, rng)] + [(7, None, 1.0)]
    df = spark.createDataFrame(rows, "g long, lon double, lat double").repartition(5)
    got = {r["g"]: (r["corners"], r["spread"]) for r in spread.spreads(spread.hulls(df, "g"), "g", (2.0, 1.0)).collect()}
    for g in range(4):
        q = np.array([r[1:] for r in rows if r[0] == g]) * [2, 1]
        assert math.isclose(got[g][1], np.sqrt(((q[:, None] - q[None]) ** 2).sum(-1)).max(), abs_tol=1e-9)
    assert set(got) == {0, 1, 2, 3} and got[3][0] == 1


@pytest.mark.parametrize("radius", [0.3, 2.0, 50.0])
def test_largest_balls(spark, radius):
    rng = random.Random(3)
    rows = [("a", k, rng.gauss(0, 2), rng.gauss(0, 2)) for k in range(150)] + [("b", k, 1.0, 1.0) for k in range(20)] + [("c", 1, 0.0, 0.0), ("d", 1, 0.0, 0.0), ("d", 2, 0.1, 0.1)]
    df = spark.createDataFrame(rows, "g string, id long, lon double, lat double")
    far = lambda a, b, c, d: ((a - c) ** 2 + (b - d) ** 2) ** 0.5
    got = {r["g"]: (r["id"], r["n"], r["lon"]) for r in spread.largest_balls(df, "g", radius, far, (1.0, 1.0)).collect()}
    want = {}
    for g in "abcd":
        own = [r for r in rows if r[0] == g]
        near = {r[1]: [q for q in own if math.hypot(r[2] - q[2], r[3] - q[3]) <= radius] for r in own}
        k = min(near, key=lambda i: (-len(near[i]), i))
        if len(near[k]) >= 2:
            want[g] = (k, len(near[k]), sum(q[2] for q in near[k]) / len(near[k]))
    assert set(got) == set(want) and all(got[g][:2] == want[g][:2] and math.isclose(got[g][2], want[g][2], abs_tol=1e-9) for g in want)


def test_largest_balls_broadcast_no_exploded_rows(spark):
    rng = random.Random(7)
    rows = [(f"g{k % 40}", k, rng.uniform(0, 60), rng.uniform(0, 40)) for k in range(40_000)]
    df = spark.createDataFrame(rows, "g string, id long, lon double, lat double")
    far = lambda a, b, c, d: ((a - c) ** 2 + (b - d) ** 2) ** 0.5
    old = {k: spark.conf.get(k) for k in ("spark.sql.maxBroadcastTableSize", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.maxBroadcastTableSize", "64m")
        got = {r["g"]: (r["id"], r["n"]) for r in spread.largest_balls(df, "g", 1.0, far, (1.0, 1.0)).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    own = [r for r in rows if r[0] == "g3"]
    near = {r[1]: sum(math.hypot(r[2] - q[2], r[3] - q[3]) <= 1.0 for q in own) for r in own}
    k = min(near, key=lambda i: (-near[i], i))
    assert len(got) == 40 and got["g3"] == (k, near[k])


@pytest.mark.parametrize("shape", ["box", "ring", "copies"])
def test_largest_balls_over_all_bounds(spark, monkeypatch, shape):
    rng = random.Random(8)
    monkeypatch.setattr(spread, "LOOK_UP", 0)  # goes on to the finest cells
    one = {"box": lambda: (rng.uniform(-3, 3), rng.uniform(-2, 2)), "ring": lambda: (lambda t: (2 * math.cos(t), 2 * math.sin(t)))(rng.uniform(0, 7)), "copies": lambda: (float(rng.randrange(-3, 4)), float(rng.randrange(-3, 4)))}[shape]
    rows = [("ab"[k % 2], k, *one()) for k in range(600)]
    df = spark.createDataFrame(rows, "g string, id long, lon double, lat double")
    far = lambda a, b, c, d: ((a - c) ** 2 + (b - d) ** 2) ** 0.5
    got = {r["g"]: (r["id"], r["n"], r["lon"], r["lat"]) for r in spread.largest_balls(df, "g", 2.0, far, (1.0, 1.0)).collect()}
    for g in "ab":
        own = [r for r in rows if r[0] == g]
        near = {r[1]: [q for q in own if ((r[2] - q[2]) ** 2 + (r[3] - q[3]) ** 2) ** 0.5 <= 2.0] for r in own}
        k = min(near, key=lambda i: (-len(near[i]), i))
        assert got[g][:2] == (k, len(near[k]))
        assert all(math.isclose(got[g][c], sum(q[c] for q in near[k]) / len(near[k]), abs_tol=1e-9) for c in (2, 3))
