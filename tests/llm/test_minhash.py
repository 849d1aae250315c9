import random

import numpy as np

from placeweave.llm import minhash
from placeweave.llm.components import components


def brute(rows, words, percent):
    def own(text):
        w = (text or "").encode().lower().split()
        if not w:
            return frozenset()
        return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) or frozenset([tuple(w)])

    sets = [own(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(sets[k]), least[find(k)], i == least[find(k)]) for k, (i, _) in enumerate(rows))


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)]
    rows, n = [], 0
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 30, 80, 200]))]
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((n, " ".join(copy)))
            n += 1
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, "W1 w2\x0bw3"), (n + 4, "w1 W2 w3")]


def test_equals_brute_force(spark):
    for words in (2, 5):
        rows = corpus(words)
        df = spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, node string, component_id long")
        got = sorted(map(tuple, minhash.near_duplicates(df, words=words).collect()))
        assert got == brute(rows, words, 80)


def test_large_groups_use_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rng = random.Random(4)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(60):  # a chain: neighbours are similar, ends are not
        base[k] = f"x{k}"
        rows.append((k, " ".join(base)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, minhash.near_duplicates(df, words=2).collect()))
    assert got == brute(rows, 2, 80)


def test_estimate_is_close():
    a = np.arange(1, 1001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    b = np.concatenate([a[:900], np.arange(5000, 5100, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)])
    x, y = (minhash.signature(s)[1].reshape(minhash.BITS, -1) for s in (a, b))
    apart = np.bitwise_count(np.bitwise_or.reduce((x ^ y).view(np.uint64), axis=0)).sum()
    assert abs(minhash.estimate(1 - apart / 160) - 900 / 1100) < 0.12


def test_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(empty).count() == 0
    long = " ".join(f"w{k}" for k in range(60))
    near = long.replace("w30", "other")
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, None), (None, long), (9, long), (5, near), (None, "alone x y z u v")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()
    want = [(3, 3, True)] * 2 + [(5, 5, True), (9, 5, False)] + [(None, 3, True), (None, 5, True), (None, None, True), (None, None, True)]
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=str) == sorted(want, key=str)


def test_group_around_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(90):  # copies with so many changes that about half of the pairs are links
        copy = list(base)
        for at in rng.sample(range(150), rng.randrange(1, 16)):
            copy[at] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, minhash.near_duplicates(df, words=2).collect())) == brute(rows, 2, 80)


def test_parity_never_exceeds_the_difference():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (3, 150, 900, 20000)]
    sets += [np.unique(np.concatenate([s[: len(s) * 9 // 10], rng.integers(0, 1 << 63, len(s) // 3, dtype=np.uint64)])) for s in sets]
    i, j = np.triu_indices(len(sets), 1)
    got = minhash._unlike([minhash._parity(s) for s in sets], i, j)
    assert all(g <= len(np.setxor1d(sets[a], sets[b])) for g, a, b in zip(got, i, j))


def test_components_of_path_and_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = dict(map(tuple, components(df).collect()))
    assert got == {k: 0 for k in range(41)} | {100 + k: 100 for k in range(30)}
