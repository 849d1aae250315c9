"""Positive-unlabelled quality: the prior, the risk, held-out rows and odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from placeweave.llm import pu_quality as pu


@pytest.mark.parametrize("prior", [0.3, 0.6, 0.85])
def test_prior_and_ranking_of_mixtures(prior):
    rng = np.random.default_rng(3)
    draw = lambda good, n: rng.normal(1.5 if good else -1.5, 1, (n, pu.N_FEATURES)) * (np.arange(pu.N_FEATURES) < 4)
    pos, n = draw(True, 3000), 6000
    truth = rng.random(n) < prior
    rest = np.where(truth[:, None], draw(True, n), draw(False, n))
    net = pu.against_unlabelled(pos[::2], rest)
    counts = [np.bincount(pu._bins(net.score(x)), minlength=pu.BINS) for x in (pos[1::2], rest)]
    found = pu.best_bin(*counts)
    assert abs(found - prior) < 0.06
    score = pu.non_negative(pos, rest, found).score(rest)
    assert ((score >= 0.5) == truth).mean() > 0.97  # junk was never pointed out


def test_best_bin_without_rows():
    assert pu.best_bin(np.zeros(pu.BINS), np.zeros(pu.BINS)) == 0.5


def test_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    out = pu.op12_pu_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in out)
    good, junk = ([r["score"] for r in out if r["quality"] == q] for q in (1, 0))
    wins = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in junk])
    assert wins > 0.95 and np.mean(np.array(good) >= 0.3) > 0.95


def test_scores_ignore_held_out_labels_and_other_columns(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    run = lambda x, y: {r["doc_id"]: r["score"] for r in pu.assess(x, y).select("doc_id", "score").collect()}
    turned = labels.withColumn("quality", F.when(pu.held_out(), 1 - F.col("quality")).otherwise(F.col("quality"))).withColumn("toxic", F.lit(1))
    one, two = run(docs, labels), run(docs.withColumn("lang", F.lit("xx")).withColumn("score", F.lit("own")).withColumn("features", F.lit(0)), turned)
    assert one == two and all(0 <= s <= 1 for s in one.values())


def test_features_read_whole_texts():
    text = "plain words of an even text " * 3000
    base = pu.text_features(text)
    assert np.abs(pu.text_features(text + " %%%***") - base).max() > 0
    assert not pu.text_features("").any() and not pu.text_features(" \n ").any()
    for odd in ("x", "\x00", "é" * 100_000, "a " * 200_000, "\ud800", " . ", "\n\na\n"):
        x = pu.text_features(odd)
        assert x.shape == (pu.N_FEATURES,) and np.isfinite(x).all()


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, "one two three"), (1, "one two three"), (2, None), (None, ""), (3, "%%% *** &&&" * 5000)], "doc_id long, text string").withColumn("predicted", F.lit("own"))
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 1, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    out = pu.assess(docs, labels).collect()
    assert len(out) == 5 and all(0 <= r["score"] <= 1 for r in out)
    assert len({r["score"] for r in out if r["doc_id"] == 1}) == 1
    none = pu.assess(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert pu.assess(docs.limit(0), labels).count() == 0 and set(pu.assess(docs, labels).columns) == {"doc_id", "text", "score", "predicted"}
