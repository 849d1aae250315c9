"""Whitening against numpy's eigenvectors, and its parts against known matrices."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from placeweave.llm import whitening as wh


def brute(vectors):
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    y = x - s / n
    v = y.T @ y / n
    w, u = np.linalg.eigh(v)
    k = min(8, x.shape[1])
    w, u = w[::-1][:k], u[:, ::-1][:, :k]
    return y @ u / np.sqrt(w), [sum(int(c) ** 2 for c in row) for row in n * x.astype(object) - s], w / np.trace(v)


def signless(a, b):
    return np.abs(a * np.sign((a * b).sum(0)) - b).max()


def test_query_equals_brute_force(spark, sf_dir):
    out = wh.op11_whitening(spark, sf_dir).toPandas()
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas().sort_values("vec_id")
    want, deviation, explained = brute(rows["embedding"].tolist())
    assert len(out) == 8 * len(rows)
    got = out.pivot(index="vec_id", columns="component", values="whitened").sort_index().to_numpy()
    assert signless(got, want) < 1e-9
    assert out.groupby("vec_id")["deviation"].first().sort_index().tolist() == deviation
    assert np.allclose(out.groupby("component")["explained"].first(), explained, rtol=1e-9)
    assert set(out["n"]) == {len(rows)} and out["identity_error"].nunique() == 1 and out["identity_error"].max() < 1e-9


@pytest.mark.parametrize("kind", ["random", "equal values", "low rank", "diagonal", "one dimension", "zero"])
def test_components(kind):
    rng = np.random.default_rng(4)
    q, _ = np.linalg.qr(rng.normal(size=(20, 20)))
    v = {
        "random": lambda: np.cov(rng.normal(size=(20, 400))),
        "equal values": lambda: q @ np.diag([9.0] * 4 + [5.0, 5.0] + [1.0] * 14) @ q.T,
        "low rank": lambda: q[:, :3] @ np.diag([3.0, 2.0, 1.0]) @ q[:, :3].T,
        "diagonal": lambda: np.diag(np.arange(20.0)),
        "one dimension": lambda: np.array([[4.0]]),
        "zero": lambda: np.zeros((5, 5)),
    }[kind]()
    v = (v + v.T) / 2
    values, vectors = wh.leading_components(v, 8)
    want = np.linalg.eigvalsh(v)[::-1][:8]
    rank = {"low rank": 3, "one dimension": 1, "zero": 0}.get(kind, 8)
    assert len(values) == rank and np.allclose(values, want[:rank], rtol=1e-12, atol=1e-12)
    assert np.abs(v @ vectors - vectors * values).max(initial=0) < 1e-11 and np.abs(vectors.T @ vectors - np.eye(rank)).max(initial=0) < 1e-13


def test_sturm_counts():
    rng = np.random.default_rng(5)
    main, side = rng.normal(size=12), rng.normal(size=11)
    values = np.linalg.eigvalsh(np.diag(main) + np.diag(side, 1) + np.diag(side, -1))
    assert [wh.count_below(main, side, x, 1e-300) for x in values + 1e-9] == list(range(1, 13))


def test_exact_products_of_large_numbers():
    y = np.array([[1 << 40, 3], [-(1 << 39), 7]], np.int64)
    assert wh._products(y).tolist() == (y.astype(object).T @ y.astype(object)).tolist()


def test_edge_rows(spark):
    nan, inf = math.nan, math.inf
    rows = [(1, [0.5, 0.1]), (2, None), (3, [0.1, None]), (4, [nan, 0.1]), (5, [inf, 0.1]), (None, [-0.5, 0.2]), (7, [0.25, -0.5]), (7, [0.25, -0.5]), (8, [1.0]), (9, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, whitened string")
    model = wh.fit(df)
    out = wh.transform(df, model).orderBy("vec_id").collect()
    assert model.n == 4 and [r["vec_id"] for r in out] == [None, 1, 7, 7]
    want, deviation, _ = brute([[-0.5, 0.2], [0.5, 0.1], [0.25, -0.5], [0.25, -0.5]])
    assert signless(np.array([r["whitened"] for r in out]), want) < 1e-12 and [int(r["deviation"]) for r in out] == deviation
    assert wh.identity_error(df, model) < 1e-12
    none = df.filter(F.col("vec_id") == 2)
    assert wh.fit(none).n == 0 and wh.transform(none, wh.fit(none)).count() == 0 and wh.identity_error(none, wh.fit(none)) == 0
    same = df.filter(F.col("vec_id") == 7)  # no variance: no component, but the rows and their deviation
    assert [r["whitened"] for r in wh.transform(same, wh.fit(same)).collect()] == [[], []]


def test_query_over_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert wh.op11_whitening(spark, str(tmp_path)).count() == 0
