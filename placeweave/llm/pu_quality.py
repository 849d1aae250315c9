"""Document quality by positive-unlabelled learning.

Trusted positives (labelled good) and unlabelled text are all the model sees: which unlabelled documents are
junk is never told. The share of good documents in the unlabelled text (the class prior) is estimated from a
classifier of positives against unlabelled rows, whose score histograms cover every row. The quality model then
minimises the non-negative unbiased risk: prior * loss of positives as good, plus the loss of unlabelled text as
junk less prior * the loss of positives as junk, a difference that may not fall below zero.

Texts become short feature vectors once; training, prior and scores work on those.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spare, table, text_or_empty, written

#: Bounds of the training sample: trusted positives, and unlabelled documents.
POSITIVES, UNLABELLED = 6_000, 12_000
HIDDEN, EPOCHS, BATCHES, RATE, DECAY = 12, 60, 8, 0.02, 1e-4
#: Confidence and slack of the bound that chooses the bin of the prior.
DELTA, GAMMA = 0.1, 0.01
BINS = 1000
#: Words of a window; the oddest window of a text has features of its own.
WINDOW = 40
THRESHOLD = 0.3
_SYMBOLS, _CALLS, _STOPS = b"#*$%&|<>=~^_@\\{}[]", b"!?", b".,;:"
_LINE = re.compile(rb"[\r\n]+")
_CLASS = np.zeros(256, np.int64)  # 0 other letters' bytes, then the classes below
for _k, _own in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\x0b\x0c\r", _SYMBOLS, _CALLS, _STOPS), 1):
    _CLASS[list(_own)] = _k
_CLASS[[b for b in range(33, 127) if _CLASS[b] == 0]] = 8
_CLASS[[b for b in range(32) if _CLASS[b] == 0]] = 9
N_FEATURES = 34


def text_features(text: str) -> np.ndarray:
    """Shares and counts of a whole text that don't depend on its language; an empty text has zeros."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    out = np.zeros(N_FEATURES)
    if not words:
        return out
    kinds = _CLASS[np.frombuffer(raw, np.uint8)]
    count = np.bincount(kinds, minlength=10).astype(float)
    n, chars = len(words), max(1.0, len(raw) - count[4])
    size = np.fromiter(map(len, words), np.int64, n)
    times = Counter(words)
    odd = np.flatnonzero((kinds >= 5) & (kinds <= 6))
    # words by their place in the text, so that a window's odd signs are counted in one pass
    start = np.flatnonzero(np.diff(np.concatenate([[True], kinds == 4]).astype(np.int8)) == -1) if count[4] else np.zeros(1, np.int64)
    of = np.searchsorted(start, odd, "right") - 1
    marked = np.bincount(np.clip(of, 0, n - 1), minlength=n)[:n] > 0
    upper = np.fromiter((w.isupper() and len(w) > 1 for w in words), bool, n)
    repeated = np.fromiter((a == b for a, b in zip(words, words[1:])), bool, n - 1)
    windows = -(-n // WINDOW)
    worst = lambda flags: float((np.bincount(np.arange(len(flags)) // WINDOW, flags, windows) / np.bincount(np.arange(n) // WINDOW, minlength=windows)).max())
    triples = len(set(zip(words, words[1:], words[2:]))) / (n - 2) if n > 2 else 1.0
    lines = [x for x in (y.strip() for y in _LINE.split(raw)) if x]
    ended = sum(x[-1:] in b".!?:;" for x in lines)
    p = count[count > 0] / len(raw)
    top = times.most_common(1)[0][1]
    out[:10] = count / np.where(np.arange(10) == 4, max(1, len(raw)), chars)
    out[10:] = (
        math.log1p(n),
        math.log1p(len(raw)),
        size.mean() / 10,
        size.std() / 10,
        math.log1p(size.max()),
        len(times) / n,
        top / n,
        math.log1p(top),
        1 - triples,
        repeated.mean() if n > 1 else 0.0,
        worst(repeated) if n > 1 else 0.0,
        marked.mean(),
        worst(marked),
        upper.mean(),
        worst(upper),
        sum(not any(c > 64 for c in w) for w in times) / len(times),
        sum(w[:1].isupper() for w in words) / n,
        math.log1p(n / len(lines)),
        1 - len(set(lines)) / len(lines),
        ended / len(lines),
        count[7] / n,
        (raw.count(b".") + raw.count(b"!") + raw.count(b"?")) / n,
        float(-(p * np.log(p)).sum()),
        math.log1p(sum(v > 1 for v in times.values())) / math.log1p(len(times)),
    )
    return out


@dataclass
class Net:
    """Standardised features, one hidden layer; ``raw`` is the log-odds of good."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self.inputs(x) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.raw(x))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _descend(net: Net, pos: np.ndarray, rest: np.ndarray, slope, seed: int) -> Net:
    """Adam over batches of both sets. ``slope`` gives the risk's derivative in the log-odds of a batch of
    positives and one of unlabelled rows."""
    rng, t = np.random.default_rng(seed), 0
    x, y = net.inputs(pos), net.inputs(rest)
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first, second = [np.zeros_like(q) for q in params], [np.zeros_like(q) for q in params]
    for epoch in range(EPOCHS):
        a, b = rng.permutation(len(x)), rng.permutation(len(y))
        for own, others in zip(np.array_split(a, BATCHES), np.array_split(b, BATCHES)):
            both = np.concatenate([x[own], y[others]])
            hidden = np.tanh(both @ params[0] + params[1])
            z = hidden @ params[2] + params[3][0]
            g = np.concatenate(slope(z[: len(own)], z[len(own) :]))
            back = g[:, None] * params[2] * (1 - hidden**2)
            grads = [both.T @ back + DECAY * params[0], back.sum(0), hidden.T @ g + DECAY * params[2], np.array([g.sum()])]
            t += 1
            rate = RATE * (1 - epoch / EPOCHS) + 1e-4
            for q, d, m, v in zip(params, grads, first, second):
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                q -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    net.b2 = float(params[3][0])
    return net


def _fresh(rest: np.ndarray, seed: int) -> Net:
    rng, d = np.random.default_rng(seed), rest.shape[1]
    scale = rest.std(0)
    return Net(rest.mean(0), np.where(scale > 1e-9, scale, 1.0), rng.normal(0, 1 / math.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / math.sqrt(HIDDEN), HIDDEN), 0.0)


def against_unlabelled(pos: np.ndarray, rest: np.ndarray, seed: int = 1) -> Net:
    """Positives against unlabelled rows, both sets weighing the same: the score that the prior is read from."""
    return _descend(_fresh(rest, seed), pos, rest, lambda p, u: (-_sigmoid(-p) / len(p) / 2, _sigmoid(u) / len(u) / 2), seed)


def non_negative(pos: np.ndarray, rest: np.ndarray, prior: float, seed: int = 2) -> Net:
    """The non-negative unbiased risk with the logistic loss. Where a batch's estimate of the junk part falls
    below zero, the step goes up that part's slope instead, as it has been fitted too far."""

    def slope(p: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        junk = _softplus(u).mean() - prior * _softplus(p).mean()
        as_junk = (-prior * _sigmoid(p) / len(p), _sigmoid(u) / len(u))
        if junk < 0:
            return -as_junk[0], -as_junk[1]
        return as_junk[0] - prior * _sigmoid(-p) / len(p), as_junk[1]

    return _descend(_fresh(rest, seed), pos, rest, slope, seed)


def best_bin(pos: np.ndarray, rest: np.ndarray) -> float:
    """The prior from counts by score bin (falling scores) of positives and of unlabelled rows: the ratio of
    their shares above the bin at which the ratio's upper confidence bound is least."""
    n, m = pos.sum(), rest.sum()
    if not n or not m:
        return 0.5
    p, u = np.cumsum(pos) / n, np.cumsum(rest) / m
    noise = math.sqrt(math.log(4 / DELTA) / (2 * m)) + math.sqrt(math.log(4 / DELTA) / (2 * n))
    some = p > 0
    k = np.argmin(np.where(some, (u + (1 + GAMMA) * noise) / np.where(some, p, 1), np.inf))
    return float(min(0.98, max(0.02, u[k] / p[k])))


def with_features(docs: DataFrame, name: str = "features", text: str = "text") -> DataFrame:
    """``docs`` with the features of each whole text in the column ``name``, which is replaced if it is there."""

    @F.pandas_udf("array<double>")
    def featured(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for own in batches:
            yield pd.Series([text_features(t) for t in own], dtype=object)

    return docs.withColumn(name, featured(text_or_empty(text)))


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


@dataclass
class QualityModel:
    net: Net
    prior: float


def training_sample(featured: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of at most POSITIVES trusted positives (label 1), half of them for the prior only, and of at most
    UNLABELLED documents whose labels are not looked at; both in the order of a hash of the id, without held-out
    and null ids. Of rows that share an id one is taken."""
    rank = F.xxhash64(F.lit(7), "doc_id")
    good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    good = good.filter(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1")
    good = good.select("doc_id").orderBy(rank, "doc_id").limit(POSITIVES)
    rows = featured.select(F.col("doc_id").cast("long").alias("doc_id"), "features").filter(F.col("doc_id").isNotNull() & ~held_out())
    pos = rows.join(F.broadcast(good), "doc_id").groupBy("doc_id").agg(F.min("features").alias("features"))  # POSITIVES ids at most
    other = F.xxhash64(F.lit(8), "doc_id")
    rest = rows.select("doc_id").distinct().orderBy(other, "doc_id").limit(UNLABELLED)
    rest = rows.join(F.broadcast(rest), "doc_id").groupBy("doc_id").agg(F.min("features").alias("features"))  # UNLABELLED ids at most
    p, u = (sorted((r["doc_id"], r["features"]) for r in own.collect()) for own in (pos, rest))
    sets = [np.array([x for _, x in own], float).reshape(len(own), N_FEATURES) for own in (p, u)]
    aside = np.array([k % 2 == 1 for k in range(len(p))], bool)
    return sets[0][~aside], sets[0][aside], sets[1]


def estimate_prior(featured: DataFrame, net: Net, aside: np.ndarray) -> float:
    """Share of good documents among all rows that aren't held out, from their histogram of scores against that
    of positives which the net was not trained on."""
    sent = featured.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("int")
    def binned(x: pd.Series) -> pd.Series:
        return pd.Series(_bins(sent.value.score(np.vstack(x.to_numpy()))) if len(x) else [], dtype="int32")

    counts = featured.filter(F.coalesce(~held_out(), F.lit(True))).groupBy(binned("features").alias("bin")).agg(F.count("*").alias("n"))
    rest = np.zeros(BINS)
    for r in counts.collect():  # BINS rows at most
        rest[r["bin"]] = r["n"]
    pos = np.bincount(_bins(net.score(aside)), minlength=BINS) if len(aside) else np.zeros(BINS)
    return best_bin(pos, rest)


def _bins(score: np.ndarray) -> np.ndarray:
    return (BINS - 1 - np.minimum(BINS - 1, (score * BINS).astype(np.int64))).astype(np.int32)


def fit(featured: DataFrame, labels: DataFrame) -> QualityModel:
    """The model from rows with ``doc_id, features`` and ``labels``. Without positives or without unlabelled
    rows every text scores one half."""
    own, aside, rest = training_sample(featured, labels)
    if not len(own) or not len(rest):
        d = N_FEATURES
        return QualityModel(Net(np.zeros(d), np.ones(d), np.zeros((d, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0), 0.5)
    prior = estimate_prior(featured, against_unlabelled(own, rest), aside if len(aside) else own)
    return QualityModel(non_negative(np.concatenate([own, aside]), rest, prior), prior)


def score(featured: DataFrame, model: QualityModel, features: str = "features") -> DataFrame:
    """``featured`` with ``score`` (0 to 1, higher: rather good) and ``predicted`` (1 from THRESHOLD); columns of
    these names are replaced. Null and empty texts get the score of zero features, repeated rows equal ones, an
    empty table no rows."""
    sent = featured.sparkSession.sparkContext.broadcast(model.net)  # a few hundred numbers

    @F.pandas_udf("double")
    def scored(x: pd.Series) -> pd.Series:
        return pd.Series(sent.value.score(np.vstack(x.to_numpy())) if len(x) else [], dtype="float64")

    names = [F.col(f"`{c}`") for c in featured.columns if c.lower() not in ("score", "predicted")]
    return featured.select(*names, scored(features).alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` (``doc_id, text`` and any others) with ``score`` and ``predicted``, by a model learnt from ``labels``."""
    (name,) = spare(docs.columns, "features")
    featured = written(with_features(docs.select(*[F.col(f"`{c}`") for c in docs.columns]), name), "features")
    model = fit(featured.select("doc_id", F.col(name).alias("features")), labels)
    return score(featured, model, name).drop(name)


def op12_pu_quality(spark, sf_dir: str) -> DataFrame:
    featured = written(with_features(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "features")
    model = fit(featured, table(spark, sf_dir, "labels"))
    return score(featured, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
