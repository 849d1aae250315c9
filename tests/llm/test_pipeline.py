import corpus_pipeline
from placeweave.llm import pii


def test_stages_keep_columns_and_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    copy = docs.filter("doc_id = 3").withColumn("doc_id", docs.doc_id + 10**6)
    docs = docs.unionByName(copy)
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir).cache()
        assert out.columns == docs.columns
        if name in ("line_dedup", "pii"):
            assert out.count() == docs.count()
        if name == "near_dedup":
            assert out.filter("doc_id = 1000003").count() == 0 and 0 < out.count() < docs.count()
        if name == "pii":
            assert pii.entity_parts(pii.mentions(out)).join(pii.entity_parts(pii.mentions(docs)), ["kind", "core"], "left_semi").count() == 0
        docs = out
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.select("doc_id").collect()} and docs.count() < before


def test_stages_with_odd_rows(spark, sf_dir):
    """Nulls, empty texts, repeated rows, clashing columns: no stage but the first and the third drops rows, none crashes."""
    long = "a quiet walk along the river bank in the early morning light with nobody else around " * 3
    rows = [(1, long), (1, long), (2, None), (None, "plain words here"), (3, ""), (4, " \n "), (5, "x" * 50_000), (None, None)]
    columns = "doc_id long, text string, n_chars long, key string, row_key string, score string, features string, piece string"
    docs = spark.createDataFrame([(i, t, 7, *["own"] * 5) for i, t in rows], columns)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        got, none = out.collect(), stage(spark, docs.limit(0), sf_dir)
        assert none.count() == 0 and none.columns == out.columns
        if name == "packing":
            assert {r.doc_id for r in got} == {i for i, _ in rows}
            continue
        assert out.columns == docs.columns and all(r.row_key == "own" for r in got)
        n = len(rows) - (name == "near_dedup")
        assert len(got) == n, name


def test_near_dedup_keeps_one_row_of_a_group(spark, sf_dir):
    words = [f"word{k}" for k in range(80)]
    text = " ".join(words)
    near = " ".join([*words[:79], "other"])
    rows = [(3, text), (5, near), (5, "an entirely different text of id five with some words of its own"), (9, near), (9, near), (3, near)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, sf_dir).collect()))
    assert len(got) == 2 and got[0][0] == 3 and got[1] == rows[2]
