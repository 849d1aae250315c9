import random
import tracemalloc

import numpy as np

from placeweave.llm import toxicity


def fixture(n=240, seed=1):
    rng = random.Random(seed)
    clean = [a + b for a in ("the", "an", "re", "st", "on", "er") for b in ("tion", "ing", "ly", "ed", "es")]
    bad = ["gruffelwort", "snarkbane", "muckwight"]
    texts, labels = [], []
    for k in range(n):
        words = [rng.choice(clean) for _ in range(rng.randint(5, 60))]
        if k % 2:
            for _ in range(2):
                words[rng.randrange(len(words))] = rng.choice(bad)
        texts.append(" ".join(words))
        labels.append(k % 2)
    return texts, np.array(labels)


def test_learns_and_shares_grams():
    texts, y = fixture()
    model = toxicity.train(texts[:160], y[:160])
    scorer = toxicity.Scorer(model.table(), model.offset())
    got = np.array([scorer.score(t) >= 0.5 for t in texts[160:]])
    assert (got == y[160:]).mean() > 0.95
    assert scorer.score("gruffelworrt") > 0.5 > scorer.score("stion reing")


def test_score_edges(spark):
    texts, y = fixture(80)
    model = toxicity.train(texts, y)
    long = "stion " * 50_000 + "snarkbane"
    df = spark.createDataFrame([(1, None, 0.2), (2, "", 0.1), (3, "12 !!", 0.0), (4, long, 1.0), (4, long, 1.0)], "doc_id long, text string, score double")
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    assert got[1].score == got[2].score == got[3].score and got[4].predicted == 1
    assert toxicity.score(df.limit(0), model).count() == 0


def test_one_class_only():
    model = toxicity.train(["a b c"] * 3, np.zeros(3))
    assert toxicity.Scorer(model.table(), model.offset()).score("x") < 0.5


def test_training_needs_little_memory():
    """At most 80 bytes a word (before: 88), as it runs beside the driver."""
    rng = random.Random(41)
    words = ["".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(4000)]
    texts = [" ".join(rng.choices(words, k=2500)) for _ in range(120)]
    tracemalloc.start()
    try:
        model = toxicity.train(texts, np.arange(120) % 2, epochs=2)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(model.grams) > 40_000 and peak < 80 * 2500 * 120


def test_no_gram_is_common_enough():
    for texts in (["", ""], ["12 3", "4"], ["a b c", ""]):
        model = toxicity.train(texts, np.array([0, 1]))
        assert 0 <= toxicity.Scorer(model.table(), model.offset()).score("a b") <= 1


def test_long_tokens_are_dealt_by_one_rule():
    texts, y = fixture()
    model = toxicity.train(texts, y)
    scorer = toxicity.Scorer(model.table(), model.offset())
    clean = ["thetion", "reing", "stion", "anly", "oned", "eres"] * 4
    for mark in ("", ",", "_", "1"):
        assert scorer.score(mark.join(clean)) < 0.5 < scorer.score(mark.join(clean + ["gruffelwort", "snarkbane"]))
    for n in range(1, 140):  # one letter more changes the parts at the end only
        parts = toxicity.tokens_of("".join(chr(0x4E00 + k) for k in range(n)))
        assert all(len(p) == toxicity.PART for p in parts[:-1]) and 0 < len(parts[-1]) <= toxicity.PART
        assert all(p[toxicity.STEP :] == q[: toxicity.PART - toxicity.STEP] for p, q in zip(parts, parts[1:]))
        assert parts[0] + "".join(q[toxicity.PART - toxicity.STEP :] for q in parts[1:]) == "".join(chr(0x4E00 + k) for k in range(n))
    for text in ("\u4e00\u4e8c\u4e09" * 50, "\u0e01\u0e34\u0e02" * 60, "x" * 65, "a,b" * 70, "1" * 80, "\u0130" * 40):
        got = toxicity.tokens_of(text)
        assert len(toxicity.letters_of("".join(got))) >= len(toxicity.letters_of(text))
        assert set(toxicity.letters_of("".join(got))) == set(toxicity.letters_of(text))
