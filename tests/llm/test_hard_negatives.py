"""Hard negatives against brute force over all rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from placeweave.llm import hard_negatives as hn


def brute(rows):
    """rows: (id, label, whole-number vector), each once."""
    out = set()
    for a in (r for r in rows if r[0] % 100 == 0):
        score = {k: sum(int(x) * int(y) for x, y in zip(a[2], r[2])) for k, r in enumerate(rows)}
        order = sorted(score, key=lambda k: (-score[k], rows[k][0]))
        same = [k for k in order if rows[k][1] == a[1] and rows[k] is not a][:5]
        for p in same:
            hits = [k for k in order if rows[k][1] != a[1] and 30 * score[p] <= 100 * score[k] <= 90 * score[p]][:10]
            out |= {(a[0], rows[p][0], rank, rows[k][0], score[p], score[k]) for rank, k in enumerate(hits, 1)}
    return out


def table(spark, rows):
    df = spark.createDataFrame([(i, n, [float(c) / 256 for c in x]) for i, n, x in rows], "vec_id long, label int, embedding array<double>")
    return hn.prepare(df, F.col("vec_id") % 100 == 0)


@pytest.mark.parametrize("kind", ["sparse", "lengths", "ties", "negative scores"])
def test_equals_brute_force(spark, kind):
    rng = np.random.default_rng(7)
    n, d = 900, 10
    x = {
        "sparse": lambda: rng.integers(-200, 200, (n, d)) * (rng.random((n, d)) < 0.25),
        "lengths": lambda: np.rint(rng.normal(size=(n, d)) * 10 ** rng.uniform(0, 3, (n, 1))),
        "ties": lambda: rng.integers(-1, 2, (n, d)),
        "negative scores": lambda: -np.abs(rng.integers(1, 90, (n, d))) * np.where(np.arange(n)[:, None] % 100 == 0, -1, 1),
    }[kind]()
    rows = [(k, int(label), row) for k, (label, row) in enumerate(zip(rng.integers(0, 4, n), x.astype(int).tolist()))]
    got = hn.mine(table(spark, rows), bucket_rows=150, anchor_rows=4).collect()
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == brute(rows)


def test_coordinates_prune():
    """On vectors with few large coordinates the ranges leave a small part; no hit is ever left out."""
    rng = np.random.default_rng(8)
    x = np.rint(rng.normal(size=(4000, 32)) * np.where(rng.random((4000, 32)) < 0.1, 300, 5))
    x = np.rint(x / np.sqrt((x**2).sum(1))[:, None] * rng.uniform(1000, 1100, (4000, 1)))  # of one length band
    norm = np.sqrt((x**2).sum(1))
    bucket = hn.Bucket(x, norm, np.arange(4000), np.zeros(4000, int), np.zeros(4000, int))
    left = []
    for a in range(0, 4000, 200):
        scores, focus = x @ x[a], hn._focus(x[a])
        least = 0.8 * norm[a] * norm[a]
        own = bucket.candidates(x[a], norm[a], focus, least)
        assert set(np.flatnonzero(scores >= least)) <= set(own.tolist())
        left.append(len(own))
    assert np.median(left) < 0.1 * 4000  # an anchor without large coordinates prunes little


def test_whole_numbers_beyond_floats(spark):
    rng = np.random.default_rng(9)
    rows = [(k, k % 3, row) for k, row in enumerate(rng.integers(1 << 24, 1 << 26, (250, 3)).tolist())]
    assert set(map(tuple, hn.mine(table(spark, rows)).collect())) == brute(rows)


def test_edge_rows(spark):
    good = [(k, k % 2, [k % 5 + 1, k % 3]) for k in range(120)]
    rows = [(i, n, [c / 256 for c in x]) for i, n, x in good]
    rows += rows[:30]  # repeated rows count once
    rows += [(None, 1, [1.0, 1.0]), (400, None, [1.0, 1.0]), (500, 1, None), (600, 1, [1.0, None]), (700, 1, [math.nan, 1.0]), (800, 1, [1e30, 1.0]), (900, 1, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("row", F.lit("own")).withColumn("bucket", F.lit(1))
    out = hn.mine(hn.prepare(df, F.col("vec_id") % 100 == 0))
    assert set(map(tuple, out.collect())) == brute(good)
    assert hn.mine(hn.prepare(df.limit(0), F.lit(True))).count() == 0
    assert hn.mine(hn.prepare(df.filter("vec_id = 100"), F.lit(True))).count() == 0
    twice = [(100, 1, [4, 0]), (100, 1, [3, 0]), (1, 0, [2, 0])]  # two rows of one id are rows of their own
    assert {tuple(r)[:4] for r in hn.mine(table(spark, twice)).collect()} == {(100, 100, 1, 1)}


def test_query_equals_its_sql(spark, sf_dir):
    import duckdb

    from placeweave.llm import registry

    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    want = db.execute(registry.oracle_sql()["op13_hard_negatives"])
    names = [c[0] for c in want.description]
    assert set(map(tuple, hn.op13_hard_negatives(spark, sf_dir).select(*names).collect())) == set(want.fetchall())
