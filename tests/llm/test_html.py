import random

import duckdb
import numpy as np

from placeweave.llm import html_extract as hx

PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu one</a></li><li><a href="/b">two</a></li></ul></nav>'
    '<!-- ad --><div class="ad">Buy this now</div><article><h1>Head &amp; line</h1><p><b>First  para<br>goes&nbsp;on.<p>Second para, with more words in it and a few commas, too.</p>'
    "<p>Third paragraph has still more of these words; it goes on for a while.</p></article><footer>&copy; site</footer>"
)


def model():
    rng = random.Random(1)
    words = [a + b for a in ("th", "re", "on", "in", "st") for b in ("ea", "ing", "ou", "er", "and")]
    para = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(5, 60))) + "."
    pages = [PAGE.replace("</article>", "".join(f"<p>{para()}</p>" for _ in range(6)) + "</article>") for _ in range(40)]
    return hx.train(pages)


def test_extracts_article_blocks():
    got = hx.extract([PAGE, PAGE[: PAGE.index("of these")], "", "plain &lt;text&gt;  only"], model())
    assert got[0] == "Head & line\n\nFirst para goes on.\n\nSecond para, with more words in it and a few commas, too.\n\nThird paragraph has still more of these words; it goes on for a while."
    assert got[1].endswith("Third paragraph has still more") and got[2] == "" and got[3] == "plain <text> only"


def test_made_layouts_held_out():
    trees, rng, right, total = model(), random.Random(99), 0, 0
    for _ in range(60):
        page, good = hx.layout([" ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(rng.randint(8, 50))) for _ in range(6)], rng)
        nodes, runs = hx.parse(page)
        kept = hx.decode(nodes, trees.raw(hx.features(nodes)))
        right += sum(bool(kept[k]) == (k in good) for k, _ in runs)
        total += len(runs)
    assert right / total > 0.95


def test_decoding_is_consistent_and_best():
    nodes = [hx.Node("body", -1, 0), hx.Node("div", 0, 1), hx.Node("p", 1, 2), hx.Node("p", 1, 2), hx.Node("div", 0, 1)]
    rng = np.random.default_rng(3)
    for _ in range(50):
        raw = rng.normal(0, 2, 5)
        kept = hx.decode(nodes, raw)
        score = lambda y: sum(-np.logaddexp(0, -r) if k else -np.logaddexp(0, r) for k, r in zip(y, raw))
        legal = [y for m in range(16) if (y := [True] + [bool(m >> b & 1) for b in range(4)]) and all(not y[k] or y[nodes[k].parent] for k in range(1, 5))]
        assert kept[0] and np.isclose(score(kept), max(map(score, legal)))


def test_table_edges(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (2, None, "", "x"), (2, None, PAGE, "x"), (2, None, PAGE, "x")], "page_id long, url string, html string, text string")
    rows = hx.main_text(df, model()).collect()
    assert [r.n_chars for r in rows if not r.html] == [0, 0] and len({r.text for r in rows if r.html}) == 1
    assert hx.main_text(df.limit(0), model()).count() == 0


def test_loose_text_raw_elements_and_attributes():
    nodes, runs = hx.parse('<h1>Title</h1>One.<br><br>Two <b>bold</b>.<script src="x"/>var a=1;</script><p data-x="hidden">Three</p>tail &amp; end')
    assert [t for _, t in runs] == ["Title", "One. Two bold.", "Three", "tail & end"]
    assert [nodes[k].tag for k, _ in runs] == ["h1", hx.LOOSE, "p", hx.LOOSE]
    assert not any(x.hidden for x in nodes)
    nodes, _ = hx.parse("<div>" + "<p>x</p>" * 500 + "</div>")
    places = hx.features(nodes)[2:, 2]
    assert (places == np.arange(500) / 500).all()


def test_held_out_layouts(sf_dir):
    pages = [r[0] for r in duckdb.sql(f"select html from '{sf_dir}/pages.parquet' where length(html) > 0 order by page_id").fetchall()]
    half = len(pages) // 2
    model = hx.train(pages[:half])
    rng, right, total = random.Random(77), 0, 0
    for page in pages[half:]:
        long = [t for _, t in hx.parse(page)[1] if len(t) > 40]
        for _ in range(2 if long else 0):
            made, good = hx.layout(rng.sample(long, min(len(long), 6)), rng)
            want = "\n\n".join(t for k, t in hx.parse(made)[1] if k in good)
            right += hx.extract([made], model) == [want]
            total += 1
    assert total and right >= 0.9 * total
