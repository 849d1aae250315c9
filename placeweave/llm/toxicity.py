"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams and itself, each with a vector; a
window of words is the average of its words; a linear softmax over that average gives the
window's two class scores, and a document is as toxic as its worst window. Vectors and
softmax are trained together in numpy. Unseen misspellings share n-gram vectors with the
words they come from.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

DIM = 8
GRAMS = (3, 4, 5)
WINDOW = 5
#: Training documents in which a gram must occur to have a vector; other grams count as zero.
LEAST_DOCS = 8
#: Bounds of the training sample: labelled documents of each class, and characters of one of them.
SAMPLE_PER_CLASS = 2000
SAMPLE_CHARS = 8_000
EPOCHS, RATE, KEEP = 70, 0.5, 0.8
CACHE_WORDS = 400_000
#: Words or grams that one step of the training sums.
BLOCK = 1 << 18
#: Letters of a word's parts, and from one part to the next.
PART, STEP = 16, 8
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters_of(token: str) -> str:
    return _NOT_LETTERS.sub("", token.lower())


def tokens_of(text: str) -> list[str]:
    """A text's tokens between white space. Of each, the letters are dealt into parts of PART letters that overlap by
    PART - STEP, whatever its length; a token of PART signs or fewer is a single part as it is. No letter is left out."""
    own = text.split()
    long = {t for t in own if len(t) > PART}
    if not long:
        return own
    parts = {}
    for token in long:
        letters = _NOT_LETTERS.sub("", token)
        parts[token] = [letters[k : k + PART] for k in range(0, max(1, len(letters) - PART + STEP), STEP)]
    return [p for t in own for p in (parts[t] if t in long else (t,))]


def subwords(letters: str) -> list[str]:
    """A word's n-grams and the word as a whole."""
    word = f"<{letters}>"
    return [word] + [word[i : i + n] for n in GRAMS for i in range(len(word) - n + 1) if n < len(word)]


@dataclass
class SubwordSoftmax:
    grams: list[str]
    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def table(self) -> dict[str, float]:
        """Each gram's part in the difference of the two class scores (the model is linear in it)."""
        return dict(zip(self.grams, (self.vectors @ (self.weights[:, 1] - self.weights[:, 0])).tolist()))

    def offset(self) -> float:
        return float(self.bias[1] - self.bias[0])


def _windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Window of each word, numbered through, and the document of each window; a document without
    words has one empty window."""
    n = np.maximum(1, -(-counts // WINDOW))
    first = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int32)
    start = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int32)
    inside = np.arange(counts.sum(), dtype=np.int32) - np.repeat(start, counts)
    return np.repeat(first, counts) + inside // WINDOW, np.repeat(np.arange(len(counts)), n)


def _docs_per_gram(words: list[np.ndarray], grams: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """Texts in which each gram occurs; ``grams`` has the bags of all words one after the other."""
    found, stops = np.zeros(n, np.int64), np.cumsum(sizes)
    for own in map(np.unique, words):
        size = sizes[own]
        ends = np.cumsum(size)
        found[np.unique(grams[np.repeat(stops[own] - ends, size) + np.arange(size.sum())])] += 1
    return found


def _numbered(texts: list[str]) -> tuple[list[np.ndarray], list[str]]:
    """The numbers of each text's words, and the letters of each word by its number; tokens without letters are no words."""
    known: dict[str, int] = {}
    number: dict[str, int] = {}
    words = []
    for text in texts:
        own = array("i")
        for token in tokens_of(text):
            if (k := known.get(token)) is None:
                letters = letters_of(token)
                k = known[token] = number.setdefault(letters, len(number)) if letters else -1
            if k >= 0:
                own.append(k)
        words.append(np.array(own, np.int32))
    return words, list(number)


def _sums(index: np.ndarray, values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """``values[of]`` summed by ``index``, in blocks: the arrays of words and grams are long, and the driver has little memory."""
    out = np.zeros(n)
    for k in range(0, len(index), BLOCK):
        np.add.at(out, index[k : k + BLOCK].astype(np.intp), values[of[k : k + BLOCK]])
    return out


def train(texts: list[str], toxic: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> SubwordSoftmax:
    """Joint training by gradient descent with momentum; each block's step is scaled by its largest gradient,
    so rare n-grams move little. The first epochs spread a document's error over all its windows, the
    later ones put it on the worst window. Without both classes, the prior alone is learnt."""
    rng = np.random.default_rng(seed)
    weights, bias = rng.normal(0, 0.3, (DIM, 2)), np.zeros(2)
    toxic = np.asarray(toxic, np.int64)
    if len(toxic) == 0 or toxic.min() == toxic.max():
        bias[:] = (0.0, -3.0) if len(toxic) == 0 or toxic[0] == 0 else (0.0, 3.0)
        return SubwordSoftmax([], np.zeros((0, DIM)), weights, bias)
    words, letters = _numbered(texts)
    counts = np.array([len(w) for w in words])
    flat, sizes, number = array("i"), array("i"), {}  # the grams of all words one after the other, and how many each has
    for own in letters:
        bag = [number.setdefault(g, len(number)) for g in subwords(own)]
        flat.extend(bag)
        sizes.append(len(bag))
    del letters
    word = np.concatenate(words)
    window, window_doc = _windows(counts)
    size = np.maximum(1, np.bincount(window, minlength=len(window_doc)))
    grams, bag_size = np.frombuffer(flat, np.int32), np.frombuffer(sizes, np.int32)
    common = _docs_per_gram(words, grams, bag_size.astype(np.int64), len(number)) >= LEAST_DOCS
    names = [g for g, k in number.items() if common[k]]  # by number
    del number, words
    keep = common[grams]
    gram_word = np.repeat(np.arange(len(bag_size), dtype=np.int32), bag_size)[keep]
    slot, bag_size = (np.cumsum(common, dtype=np.int32) - 1)[grams[keep]], bag_size.astype(np.float32)
    del grams, flat, keep
    first_window = np.concatenate([[0], np.flatnonzero(np.diff(window_doc)) + 1])
    per_doc = np.bincount(window_doc)
    share = np.where(toxic == 1, 0.5 / max(1, toxic.sum()), 0.5 / max(1, (1 - toxic).sum()))  # classes weigh the same
    v, speed, scale = rng.normal(0, 0.1, (len(names), DIM)), {}, {}

    def step(name: str, value: np.ndarray, grad: np.ndarray) -> None:
        scale[name] = max(0.95 * scale.get(name, 0.0), float(np.abs(grad).max(initial=0.0)), 1e-12)
        speed[name] = KEEP * speed.get(name, 0.0) + (1 - KEEP) * grad / scale[name]
        value -= RATE * speed[name]

    # The class gap is linear in the vectors: a gram's gradient is a number times the softmax direction,
    # so numbers alone pass through grams, words and windows.
    for t in range(1, epochs + 1):
        direction = weights[:, 1] - weights[:, 0]
        part = _sums(gram_word, v @ direction, slot, len(bag_size)) / bag_size
        gap = _sums(window, part, word, len(window_doc)) / size + bias[1] - bias[0]
        if t <= epochs // 4:
            pooled = np.bincount(window_doc, gap) / per_doc
            spread = 1 / per_doc[window_doc]
        else:
            pooled = np.maximum.reduceat(gap, first_window)
            worst = gap == pooled[window_doc]
            spread = worst / np.bincount(window_doc, worst)[window_doc]
        error = (1 / (1 + np.exp(-np.clip(pooled, -40, 40))) - toxic) * share
        g = error[window_doc] * spread
        word_grad = _sums(word, g / size, window, len(bag_size)) / bag_size
        pull = _sums(slot, word_grad, gram_word, len(names))
        w_grad = v.T @ pull
        step("w", weights, np.stack([-w_grad, w_grad], 1))
        step("b", bias, np.array([-g.sum(), g.sum()]))
        step("v", v, pull[:, None] * direction[None, :])
    return SubwordSoftmax(names, v, weights, bias)


class Scorer:
    """Scores whole texts; parts of known tokens are kept between texts."""

    def __init__(self, table: dict[str, float], offset: float):
        self.table, self.offset = table, offset
        self.parts: dict[str, float | None] = {}
        self.words: dict[str, float] = {}

    def learn(self, token: str) -> None:
        letters = letters_of(token)
        part = self.words.get(letters) if letters else None
        if letters and part is None:
            bag = subwords(letters)
            part = self.words[letters] = sum(map(self.table.get, bag, repeat(0.0))) / len(bag)
        self.parts[token] = part

    def score(self, text: str) -> float:
        tokens = tokens_of(text)
        if len(self.parts) >= CACHE_WORDS:
            self.parts.clear()
            self.words.clear()
        for token in set(tokens).difference(self.parts):
            self.learn(token)
        parts = np.array([x for x in map(self.parts.__getitem__, tokens) if x is not None])
        full = len(parts) // WINDOW * WINDOW
        worst = [parts[:full].reshape(-1, WINDOW).mean(axis=1).max()] if full else []
        if full < len(parts):
            worst.append(parts[full:].mean())
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, float(max(worst, default=0.0)) + self.offset))))


def training_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``text, toxic`` of at most SAMPLE_PER_CLASS labelled documents of each class, in the order of a
    hash of their id, leaving out held-out ids (crc32 of the id as text, mod 5 = 0), texts longer than
    SAMPLE_CHARS, and null ids, texts and labels. Twice as many ids are looked up, to make up for long texts; of
    rows that share an id one text is taken."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    own = own.filter(F.col("toxic").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = own.withColumn("rank", F.xxhash64(F.lit(3), "doc_id"))
    ids = [own.filter(F.col("toxic") == k).orderBy("rank", "doc_id").limit(2 * SAMPLE_PER_CLASS) for k in (0, 1)]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.length("text") <= SAMPLE_CHARS)
    known = texts.join(F.broadcast(ids[0].union(ids[1])), "doc_id")  # 4 * SAMPLE_PER_CLASS ids at most
    known = known.groupBy("doc_id", "toxic", "rank").agg(F.min("text").alias("text"))
    own = [known.filter(F.col("toxic") == k).orderBy("rank", "doc_id").limit(SAMPLE_PER_CLASS) for k in (0, 1)]
    return own[0].union(own[1]).select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame) -> SubwordSoftmax:
    rows = sorted(training_sample(docs, labels).collect())
    return train([r["text"] for r in rows], np.array([r["toxic"] for r in rows], np.int64))


def score(docs: DataFrame, model: SubwordSoftmax) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5); columns of these names are
    replaced. Null and empty texts, and texts without letters, get the score of an empty window."""
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    sent = docs.sparkSession.sparkContext.broadcast((model.table(), model.offset()))  # the grams of a bounded sample

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(*sent.value)
        for own in batches:
            yield pd.Series([scorer.score(t) for t in own], dtype="float64")

    return docs.select(*names).withColumn("score", scored(text_or_empty())).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_subword_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out")
    return score(docs, model).select("doc_id", held, "score", "predicted")
