"""Similar sets against all pairs, numbers against a plain sort."""

import random

import pytest

from placeweave.operators import numbering, similarity


@pytest.mark.parametrize("percent", [50, 80, 90, 100])
def test_similar_sets(spark, percent):
    rng = random.Random(percent)
    rows = [(k, [rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(1, 25))]) for k in range(150)]
    rows += [(200 + k, list("hot words")) for k in range(6)] + [(300, []), (301, None), (302, ["a", None])]
    got = similarity.similar_sets(spark.createDataFrame(rows, "id long, items array<string>"), percent).collect()
    sets = {i: {x for x in s if x} for i, s in rows if s and any(s)}
    want = {(a, b, len(sets[a] & sets[b]), len(sets[a] | sets[b])) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
    assert len(got) == len(set(map(tuple, got))) and {tuple(r) for r in got} == want


def test_numbered(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]) if k > 300 else "hot", k) for k in range(600)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, k long").repartition(7)
    whole = {r["k"]: r["number"] for r in numbering.numbered(df, ["k"], start=0).collect()}
    assert whole == {k: k for k in range(600)}
    got = {(r["g"], r["k"]): r["id"] for r in numbering.numbered(df, ["k"], by=["g"], name="id").collect()}
    for g in ("hot", "a", "b", None):
        assert [got[g, k] for k in sorted(k for x, k in rows if x == g)] == list(range(1, sum(x == g for x, _ in rows) + 1))
    assert numbering.numbered(df.limit(0), ["k"]).count() == 0


def test_numbered_lines(spark, tmp_path):
    texts = {"one.txt": ["first", "", "third"] + ["x" * (k % 50) for k in range(3000)], "two.txt": ["", "only"]}
    for name, lines in texts.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")  # several splits of a file
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        got = numbering.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name, lines in texts.items():
        assert sorted((r["line_no"], r["value"]) for r in got if r["file"].endswith(name)) == list(enumerate(lines, 1))


def _edits(p, q):
    """Whether two texts are one edit apart."""
    if len(p) == len(q):
        return sum(x != y for x, y in zip(p, q)) == 1
    p, q = sorted((p, q), key=len)
    return len(q) == len(p) + 1 and any(q[:i] + q[i + 1 :] == p for i in range(len(q)))


def test_single_edits(spark):
    rng = random.Random(9)
    names = ["".join(rng.choice("abä") for _ in range(rng.randint(0, 6))) for _ in range(300)]
    got = [tuple(r) for r in similarity.single_edits(spark.createDataFrame([(n,) for n in [*names, None]], "name string"), "name").collect()]
    order = sorted({*names}, key=lambda n: n.encode())
    want = [(p, q, "sub" if len(p) == len(q) else "ins" if len(p) < len(q) else "del") for k, p in enumerate(order) for q in order[k + 1 :] if _edits(p, q)]
    assert sorted(got) == sorted(want)


def test_single_edits_broadcast_no_exploded_rows(spark, tmp_path):
    from placeweave.plans.scalar import f16

    spark.range(60_000).selectExpr("id c_custkey", "concat('Customer#', lpad(id, 9, '0')) c_name").write.parquet(str(tmp_path / "customer.parquet"))
    old = spark.conf.get("spark.sql.maxBroadcastTableSize")
    try:
        spark.conf.set("spark.sql.maxBroadcastTableSize", "64m")
        rows = f16(spark, str(tmp_path)).count()
    finally:
        spark.conf.set("spark.sql.maxBroadcastTableSize", old)
    assert rows == 60_000 * 4 * 9 // 2 + 60_000 * 5 // 2
