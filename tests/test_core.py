import json

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

import pytest

from placeweave.functions import names as nm
from placeweave.operators import graph, match, text
from placeweave.operators.rules import Rule, violations
from placeweave.sources import files
from placeweave.streaming import jobs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def cleaned(spark, value):
    return text.clean(spark.createDataFrame([(value,)], "text string")).first().clean_text


def test_cleaning_rules(spark):
    assert cleaned(spark, "NOTICE do not copy\n\nbody") == "body"
    assert cleaned(spark, "body\n\n0\n\n36") == "body" and cleaned(spark, "A\n\n198\n\nB") == "A\n\n198\n\nB"
    assert cleaned(spark, "a\n\n\n\n\nb") == "a\n\nb"
    assert cleaned(spark, "body\n1.2.3.4\nns12da\n1 2\nAnd 68 More") == "body"
    assert cleaned(spark, "long body\n1.2.3.4\nmore body").startswith("long body") and "more body" in cleaned(spark, "long body\n1.2.3.4\nmore body")
    assert cleaned(spark, "x a.b@mail3.example.com y") == "x  y"


def test_word_count_ignores_white_space(spark):
    assert one(spark, text.word_count(F.lit("你好 世界\n\r\t 再見"))) == 6


def test_segments_keep_text_and_budget(spark):
    body = "\n".join("x" * 660 for _ in range(10)) + "\n" + "y" * 4500
    rows = text.segments(spark.createDataFrame([(1, body), (2, "short"), (3, None), (4, "")], "k int, text string"), "k").collect()
    own = [r.segment for r in rows if r.k == 1]
    assert len(own) > 1 and all(len(s) <= 2000 for s in own) and "".join(own).replace("\n", "") == body.replace("\n", "")
    assert [r.segment for r in rows if r.k == 2] == ["short"] and not [r for r in rows if r.k in (3, 4)]


def test_names(spark):
    name, note = nm.strip_note(F.lit("商場(病窩)"))
    assert (one(spark, name), one(spark, note)) == ("商場", "病窩")
    assert one(spark, nm.slug(F.lit("Mong Kok"))) == "mong_kok"
    assert one(spark, nm.slug(F.lit("夏晴"))).startswith("ent_")
    assert one(spark, nm.nfkc(F.lit(" ＡＢ１ "))) == "AB1"
    assert one(spark, nm.sort_key(F.lit(None).cast("string"), F.lit(1234))) == "ch1234"
    assert [one(spark, nm.edit_kind(F.lit(a), F.lit(b))) for a, b in (("abc", "abd"), ("ab", "abc"), ("abc", "ab"), ("abc", "xyz"))] == ["sub", "ins", "del", None]


def test_json_lines_quarantine(spark, tmp_path):
    path = tmp_path / "in.jsonl"
    path.write_text('{"story": "x", "n": 1}\n\nnot-json\n[1]\n{"story": "y"}\n')
    schema = StructType([StructField("story", StringType()), StructField("n", LongType())])
    good, bad = files.read_json_lines(spark, str(path), schema)
    assert sorted(map(tuple, good.collect()), key=str) == [("x", 1), ("y", None)]
    assert sorted((r.line_no, r.value) for r in bad.collect()) == [(3, "not-json"), (4, "[1]")]
    assert sorted(r._line_no for r in files.read_json_lines(spark, str(path), schema, line_numbers=True)[0].collect()) == [1, 5]
    with pytest.raises(ValueError, match="in.jsonl, line 3"):
        files.read_json_lines(spark, str(path), schema, strict=True)


def test_feature_and_map_readers(spark, tmp_path):
    f = {"type": "Feature", "id": "a", "geometry": {"type": "Point", "coordinates": [114.1, 22.3]}, "properties": {"name": "x"}}
    (tmp_path / "c.json").write_text(json.dumps({"type": "FeatureCollection", "features": [f, f]}))
    (tmp_path / "s.json").write_text(json.dumps(f))
    rows = files.read_features(spark, str(tmp_path / "*.json")).collect()
    assert len(rows) == 3 and all((r.id, r.lon, r.lat, r.properties["name"]) == ("a", 114.1, 22.3, "x") for r in rows)
    (tmp_path / "m.txt").write_text('{"3": "c", "x": "d"}')
    good, bad = files.read_map_keyed(spark, str(tmp_path / "m.txt"), "string")
    assert good.first().key == 3 and bad.first().k == "x"


def test_first_json():
    assert files.first_json('say ```json\n[{"a": [1]}] ``` ok') == '[{"a": [1]}]'
    assert files.first_json('x {"a": 1} y') == '{"a": 1}' and files.first_json("none") is None


def test_closure_with_cycles(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (10, 11), (11, 12), (12, 10), (20, 10), (21, 20)], "a long, b long")
    assert dict(map(tuple, graph.closure(links).collect())) == {1: 3, 2: 3, 20: 10, 21: 10}


def test_components_and_redirect(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(50, 51)], "a long, b long")
    assert dict(map(tuple, graph.components(edges).collect())) == {k: 0 for k in range(21)} | {50: 50, 51: 50}
    roots = spark.createDataFrame([(1, 0)], "a long, root long")
    moved = graph.redirect(spark.createDataFrame([(1, 0), (1, 2)], "a long, b long"), roots)
    assert list(map(tuple, moved.collect())) == [(0, 2)]


@pytest.mark.parametrize("names", [["old bolt", "cold", "zzz"], ["a", "he", "bolt", "old", ""], ["x" * 400], ["no", None], []])
def test_mentions_of_names_of_any_length(spark, names):
    texts = [(1, "a cold bolt here"), (2, "nothing"), (3, ""), (4, None), (5, "a cold bolt here"), (6, "é" + "x" * 3000), (7, "h")]
    want = sorted((k, n) for k, t in texts for n in names if t and n and n in t)
    got = match.mentions(spark.createDataFrame(texts, "k long, t string"), spark.createDataFrame([(n,) for n in names], "n string"), "t", "n")
    assert sorted((r.k, r.n) for r in got.collect()) == want


def test_mentions_do_not_depend_on_the_number_of_names(spark):
    texts = spark.createDataFrame([(1, "ab x1 and name 77."), (2, "q")], "k long, t string")
    few = spark.createDataFrame([("x1",), ("q",), ("name 77",)], "n string")
    many = few.union(spark.range(60_000).selectExpr("concat('other ', id)"))
    rows = lambda names: sorted((r.k, r.n) for r in match.mentions(texts, names, "t", "n").collect())
    assert rows(few) == rows(many) == [(1, "name 77"), (1, "x1"), (2, "q")]


def test_violations(spark):
    df = spark.createDataFrame([(1, "ok", 5), (2, None, 50)], "id long, name string, n int")
    rows = violations(df, "t", "id", [Rule("name", "required"), Rule("n", "max", 10), Rule("name", "pattern", "^o")]).collect()
    assert sorted((r.row_id, r.rule) for r in rows) == [("2", "n.max"), ("2", "name.required")]


def test_rerun_is_stable(spark, sf_dir):
    from placeweave.plans.text import flagship

    a, b = (sorted(map(tuple, flagship(spark, sf_dir).collect())) for _ in range(2))
    assert a == b


def test_rings(spark, tmp_path):
    ring = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]
    for name, geo in {"a": {"type": "Polygon", "coordinates": [ring, ring]}, "b": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}, "c": {"type": "GeometryCollection", "geometries": [{"type": "Polygon", "coordinates": [ring]}]}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(geo))
        rows = files.read_rings(spark, str(tmp_path / f"{name}.json")).collect()
        assert len(rows) == (2 if name == "b" else 1) and rows[0].points == ring


def test_white_space_of_all_scripts(spark):
    assert one(spark, text.word_count(F.lit("a\u3000b\u00a0 c\u0085\u2003"))) == 3
    assert one(spark, text.strip_edges(F.lit("\u3000 a b\u00a0\n"))) == "a b"


def test_footer_with_a_dotted_mark(spark):
    body = "story line\n10.1.2.3\nns223.122.76.172da2 and so on"
    assert one(spark, text.cut_footer(F.lit(body), text.CleanRules())) == "story line"


def test_first_json_parses():
    assert files.first_json('note [not json] then ["]", 2] end') == '["]", 2]'
    assert files.first_json('{"a": "}"} tail') == '{"a": "}"}' and files.first_json("[1, 2") is None and files.first_json(None) is None


def test_upserts_go_on_after_a_restart(spark, tmp_path):
    def put(name, rows):
        spark.createDataFrame(rows, "k long, v long, t long").coalesce(1).write.json(f"{tmp_path}/{name}")
        for f in (tmp_path / name).glob("part-*.json"):
            (tmp_path / "in").mkdir(exist_ok=True)
            f.rename(tmp_path / "in" / f"{name}.json")

    def run(checkpoint="checkpoint"):
        stream = spark.readStream.schema("k long, v long, t long").json(f"{tmp_path}/in")
        return jobs.upsert_available(stream, "k", "t", f"{tmp_path}/table", f"{tmp_path}/{checkpoint}")

    put("a", [(1, 10, 1), (2, 20, 1)])
    run()
    put("b", [(2, 21, 2), (3, 30, 2)])
    last = run()  # a new call knows only what is on disk
    assert sorted((r.k, r.v) for r in spark.read.parquet(last).collect()) == [(1, 10), (2, 21), (3, 30)]
    assert run() == last
    for name in ("a", "b"):
        (tmp_path / "in" / f"{name}.json").unlink()
    put("c", [(3, 31, 3)])
    newest = run("other")  # a new checkpoint goes on behind the table's last version
    assert newest > last and sorted((r.k, r.v) for r in spark.read.parquet(newest).collect()) == [(1, 10), (2, 21), (3, 31)]


def test_missing_and_repeated_texts_are_counted(spark, tmp_path):
    from placeweave.plans import text

    rows = [(k, None if k % 5 == 0 else "same" if k % 2 else f"text {k}", "en", "s", 4) for k in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = text.flagship(spark, str(tmp_path)).collect()
    assert [(r.n_docs, r.duplicates) for r in out] == [(40, 7 + 15)]
    assert len(text.t11(spark, str(tmp_path)).collect()) == 7 + 15


def test_evidence_of_names_of_any_length(spark, tmp_path):
    from placeweave.plans import evidence

    texts = ["x" * 100_000 + "harbour in the north", "theharbourside in town", "harbour", "plain the words", "q" * 70_000]
    spark.createDataFrame([(k, t, "en", f"s{k % 2}", 9) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "harbour lighthouse"), (2, "side")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    held = evidence.rules(spark, str(tmp_path), "CONTAIN")["CONTAIN"].collect()
    assert {(r.place_id, r.target) for r in held} == {(0, "harbour"), (1, "harbour")}
    assert {r.place_id for r in evidence.e8(spark, str(tmp_path)).collect()} >= {0, 1}
    assert {(r.place_id, r.target) for r in evidence.e12(spark, str(tmp_path)).collect()} == set()


def test_empty_polygons_have_no_ring(spark, tmp_path):
    ring = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]]
    for name, shape in {"a": {"type": "Polygon", "coordinates": []}, "b": {"type": "MultiPolygon", "coordinates": [[], [ring, ring]]}, "c": {"type": "GeometryCollection", "geometries": []}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(shape))
    got = files.read_rings(spark, str(tmp_path / "*.json")).collect()
    assert [(r.ring_id, [list(p) for p in r.points]) for r in got] == [(0, ring)]
