"""Groups in common against all pairs of each group."""

import random
from collections import Counter

import pytest

from placeweave.operators import together


def counted(rows):
    groups = {}
    for g, m in rows:
        if g is not None and m is not None:
            groups.setdefault(g, set()).add(m)
    return Counter((a, b) for own in groups.values() for a in own for b in own if a != b)


@pytest.mark.parametrize("dense", [0, 100, 10**9])
def test_shared_groups(spark, monkeypatch, dense):
    rng = random.Random(dense)
    monkeypatch.setattr(together, "MEMBERS", 9)  # several blocks
    monkeypatch.setattr(together, "DENSE", dense)
    monkeypatch.setattr(together, "PAIRS", 7)
    monkeypatch.setattr(together, "OUT", 20)
    rows = [(rng.randrange(-20, 1500), rng.randrange(40)) for _ in range(900)] + [(7, k) for k in range(-5, 45)] + [(7, 3)] * 3 + [(None, 1), (2, None), (5000, 77), (-(1 << 40), 1), (-(1 << 40), 1 << 50)]
    got = together.shared_groups(spark.createDataFrame(rows, "grp long, member long")).collect()
    assert {(r["a"], r["b"]): r["shared"] for r in got} == counted(rows) and len(got) == len(counted(rows))


def test_pairs_are_not_shuffled(spark, tmp_path):
    """What a scene's pairs are counted from grows with the scene, not with its square."""
    rows = [(s, m) for s in range(12) for m in range(1200)]
    got = together.shared_groups(spark.createDataFrame(rows, "grp long, member long"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and got.count() == 1200 * 1199
    assert {r["shared"] for r in got.select("shared").distinct().collect()} == {12}


def test_empty(spark):
    assert together.shared_groups(spark.createDataFrame([], "grp long, member long")).collect() == []
