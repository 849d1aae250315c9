"""Smoothing and percentiles against numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from placeweave.operators import density as dn


def test_smoothed(spark):
    rng, w, h, sigma = random.Random(1), 17, 9, 2.5
    cells = {(rng.randrange(w), rng.randrange(h)) for _ in range(25)}
    k = dn.kernel(sigma)
    full = np.zeros((h, w))
    for x, y in cells:
        full[y, x] = 1
    for axis, size in ((1, w), (0, h)):
        out = np.zeros_like(full)
        for s in range(1 - len(k), len(k)):
            at = [(c + s) % (2 * size) for c in range(size)]
            at = [c if c < size else 2 * size - 1 - c for c in at]
            out += k[abs(s)] * np.take(full, at, axis)
        full = out
    got = {(r.cx, r.cy): r.value for r in dn.smoothed(spark.createDataFrame([(*c, 1.0) for c in cells], "cx long, cy long, value double"), w, h, sigma).collect()}
    assert abs(sum(dn.kernel(sigma)) * 2 - dn.kernel(sigma)[0] - 1) < 1e-12
    assert all(abs(got.get((x, y), 0) - full[y, x]) < 1e-12 for x in range(w) for y in range(h))


@pytest.mark.parametrize("kind", ["spread", "ties", "tiny range", "one"])
def test_percentile(spark, kind, monkeypatch):
    monkeypatch.setattr(dn, "FEW", 5)
    monkeypatch.setattr(dn, "BINS", 7)
    rng = random.Random(2)
    values = {"spread": [rng.expovariate(1) ** 3 for _ in range(500)], "ties": [float(rng.randrange(3)) for _ in range(300)], "tiny range": [1.0 + k * 2.3e-16 for k in range(60)], "one": [4.0]}[kind]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for share in (0.0, 0.31, 0.98, 1.0):
        for zeros in (0, 40):
            assert dn.percentile(df, "v", share, zeros) == pytest.approx(np.percentile(values + [0.0] * zeros, share * 100), abs=1e-15)
    assert dn.percentile(df.limit(0), "v", 0.5) is None and dn.percentile(df.limit(0), "v", 0.5, 3) == 0.0


def test_nothing_is_dense_without_points(spark):
    none = spark.createDataFrame([], "cx long, cy long")
    assert dn.dense_cells(none, 10, 10, 2.5, F.lit(True), none).count() == 0
