"""Main text of web pages: gradient-boosted trees over DOM-node features, decoded over the tree.

Block elements are nodes. Each gets features of its tag, attribute tokens, depth, siblings,
and the density of text and links below it; boosted trees in numpy give the probability
that the article has text in its subtree. Decoding picks the most likely set of nodes in
which no dropped node has a kept one below it.

The trees are trained on a bounded sample of the pages themselves: pages that mark their
article, and new layouts made around the paragraphs of those pages, where the place of
each block is known.
"""

from __future__ import annotations

import html as html_lib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: Bounds of the training sample: pages, characters of one, and layouts made from each.
SAMPLE_PAGES, SAMPLE_CHARS, LAYOUTS = 240, 60_000, 5
TREES, DEPTH, RATE, BINS = 60, 4, 0.25, 32

BLOCKS = set(
    "html body article main section div nav header footer aside form p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th "
    "blockquote pre figure figcaption fieldset address details summary dialog center menu search hgroup".split()
)
#: Their text is never content and never read as markup.
RAW = ("script", "style", "noscript", "template", "textarea", "svg", "iframe", "select", "button", "object", "canvas", "title", "head")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:>|\Z)", re.S)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9-]*)")
#: One attribute after another: its name, and its value if it has one.
_ATTR = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_READ = {"class", "id", "role", "itemprop", "aria-label"}
#: Elements whose content is text up to their end tag even where the start tag ends in "/>".
_NEVER_EMPTY = ("script", "style", "textarea", "title", "iframe", "noscript")
#: Tag of a run of text that stands directly in the page, between its blocks.
LOOSE = "#text"
_CLOSES_P = BLOCKS - {"html", "body"}
_SIBLING = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "thead", "tbody", "tfoot"), "td": ("tr",), "th": ("tr",)}

GOOD = "article content main post body entry text story page blog copy prose".split()
BAD = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs topbar toolbar tabs pagination pager skip".split(),
    "head": "header masthead banner logo branding".split(),
    "foot": "footer foot copyright legal colophon credits".split(),
    "side": "sidebar side aside widget rail related recommended popular trending more teaser tags".split(),
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion affiliate".split(),
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay banner subscribe paywall newsletter signup".split(),
    "talk": "comment comments reply replies respond discussion disqus thread reader readers".split(),
    "share": "share social sharing follow like byline author meta date print".split(),
    "form": "form search login signin contact input".split(),
}
TAG_GROUPS = [("article", "main"), ("nav", "menu"), ("header",), ("footer",), ("aside",), ("form", "fieldset", "search", "dialog"), ("p", LOOSE), ("h1",), ("h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "dl"), ("li", "dt", "dd"), ("table", "thead", "tbody", "tr", "td", "th"), ("blockquote", "pre"), ("figure", "figcaption"), ("section", "div"), ("body", "html")]
_GROUP = {t: k for k, own in enumerate(TAG_GROUPS) for t in own}
_WORDS = re.compile(r"[a-z]+")


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    tokens: tuple[str, ...] = ()
    hidden: bool = False
    children: list[int] = field(default_factory=list)
    chars: int = 0
    links: int = 0
    marks: int = 0
    inputs: int = 0


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block nodes in page order, each after its parent (the first is the page), and text runs ``(node, text)``.
    Inline elements are transparent, a line break is white space, unclosed elements end where HTML lets them. Text
    that stands directly in the page is a node of its own from one block to the next."""
    nodes, runs, stack = [Node("body", -1, 0)], [], [0]
    buffer: list[str] = []
    link = linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html_lib.unescape("".join(buffer)).split())
        buffer.clear()
        if text:
            if len(stack) == 1:  # loose text is a block of its own
                nodes[0].children.append(len(nodes))
                nodes.append(Node(LOOSE, 0, 1))
            own = len(nodes) - 1 if len(stack) == 1 else stack[-1]
            runs.append((own, text))
            nodes[own].chars += len(text)
            nodes[own].links += linked
            nodes[own].marks += text.count(".") + text.count(",") + text.count("!") + text.count("?")
        linked = 0

    def text_at(start: int, end: int) -> None:
        nonlocal linked
        if end > start:
            buffer.append(page[start:end])
            linked += (end - start) * link

    at = 0
    while (m := _TOKEN.search(page, at)) is not None:
        text_at(at, m.start())
        at = m.end()
        found = _NAME.match(m[0])
        if not found:
            continue
        tag, closing = found[1].lower(), m[0][1] == "/"
        if tag in _RAW_END and not closing:
            if tag == "head":
                continue
            if not m[0].endswith("/>") or tag in _NEVER_EMPTY:
                stop = _RAW_END[tag].search(page, at)
                at = stop.end() if stop else len(page)
            nodes[stack[-1]].inputs += tag in ("button", "select", "textarea")
        elif tag == "a":
            link = 0 if closing else 1
        elif tag == "br":
            buffer.append(" ")
        elif tag in ("input", "label"):
            nodes[stack[-1]].inputs += 1
        elif tag in BLOCKS and tag not in ("html", "body"):
            flush()
            link = 0
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    if nodes[stack[k]].tag == tag:
                        del stack[k:]
                        break
                continue
            if tag in _CLOSES_P and nodes[stack[-1]].tag == "p":
                stack.pop()
            if tag in _SIBLING:
                for k in range(len(stack) - 1, 0, -1):
                    own = nodes[stack[k]].tag
                    if own == tag or {own, tag} in ({"dt", "dd"}, {"td", "th"}):
                        del stack[k:]
                        break
                    if own in _SIBLING[tag]:
                        break
            tokens, hidden = [], False
            for name, value in _ATTR.findall(m[0], found.end()):
                name = name.lower()
                if name == "hidden" or (name == "aria-hidden" and "true" in value) or (name == "style" and "none" in value and "display" in value):
                    hidden = True
                elif name in _READ:
                    tokens += _WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
            nodes.append(Node(tag, stack[-1], nodes[stack[-1]].depth + 1, tuple(tokens), hidden))
            nodes[stack[-1]].children.append(len(nodes) - 1)
            stack.append(len(nodes) - 1)
    text_at(at, len(page))
    flush()
    return nodes, runs


def features(nodes: list[Node]) -> np.ndarray:
    """A row of numbers for each node."""
    n = len(nodes)
    chars, links, marks, inputs, tags, paras = (np.zeros(n) for _ in range(6))
    for k, x in enumerate(nodes):
        chars[k], links[k], marks[k], inputs[k], tags[k], paras[k] = x.chars, x.links, x.marks, x.inputs, 1, x.tag == "p"
    own = chars.copy()
    first = np.cumsum(own) - own
    for k in range(n - 1, 0, -1):  # children follow their parents
        p = nodes[k].parent
        for a in (chars, links, marks, inputs, tags, paras):
            a[p] += a[k]
    total = max(1.0, chars[0])
    out = np.zeros((n, len(TAG_GROUPS) + 2 * (len(BAD) + 1) + 22))
    flags = np.zeros((n, len(BAD) + 1 + len(TAG_GROUPS)))
    for k, x in enumerate(nodes):
        if x.tag in _GROUP:
            flags[k, len(BAD) + 1 + _GROUP[x.tag]] = 1
        for t in x.tokens:
            flags[k, 0] += t in GOOD
            for g, words in enumerate(BAD.values(), 1):
                flags[k, g] += t in words
    above = np.zeros_like(flags)
    hidden = np.array([x.hidden for x in nodes], float)
    for k in range(1, n):
        p = nodes[k].parent
        above[k] = np.maximum(above[p], flags[p])
        hidden[k] = max(hidden[k], hidden[p])
    bad_tags = [len(BAD) + 1 + g for g in (1, 3, 4, 5)]
    places = np.zeros(n, np.int64)
    for x in nodes:
        places[x.children] = np.arange(len(x.children))
    for k, x in enumerate(nodes):
        p = max(0, x.parent)
        kin = nodes[p].children or [k]
        place = int(places[k])
        rest = max(1, len(kin) - 1)
        kin_chars = chars[p] - own[p] - chars[k]
        row = [
            x.depth, len(kin), place / max(1, len(kin)), (len(kin) - 1 - place) / max(1, len(kin)),
            np.log1p(own[k]), np.log1p(chars[k]), chars[k] / total, links[k] / max(1.0, chars[k]), chars[k] / tags[k], marks[k] / max(1.0, chars[k]),
            inputs[k], np.log1p(paras[k]), np.log1p(tags[k]), np.log1p(kin_chars / rest), chars[k] / max(1.0, chars[p]), links[p] / max(1.0, chars[p]),
            first[k] / total, hidden[k], above[k, bad_tags].max(), above[k, len(BAD) + 1], np.log1p(len(x.children)), len(x.tokens),
        ]
        out[k, : len(row)] = row
    out[:, 22 : 22 + len(BAD) + 1] = flags[:, : len(BAD) + 1]
    out[:, 22 + len(BAD) + 1 : 22 + 2 * (len(BAD) + 1)] = above[:, : len(BAD) + 1]
    out[:, 22 + 2 * (len(BAD) + 1) :] = flags[:, len(BAD) + 1 :]
    return out


@dataclass
class Boosted:
    """Complete trees of one depth: feature and threshold of each inner node, value of each leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - len(f)]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Boosted:
    """Logistic boosting with histogram splits. One class alone gives its prior."""
    share = min(max(float(y.mean()) if len(y) else 0.0, 0.01), 0.99)
    base, inner = float(np.log(share / (1 - share))), 2**DEPTH - 1
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    coded = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
    total, features_, thresholds, values = np.full(len(x), base), [], [], []
    width, shift = BINS + 1, np.arange(x.shape[1]) * (BINS + 1)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        feature, threshold, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(x), np.int64)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            if len(rows) >= 20:
                flat = (coded[rows] + shift).ravel()
                sums = [np.bincount(flat, np.repeat(a[rows], x.shape[1]), width * x.shape[1]).reshape(-1, width).cumsum(1) for a in (g, h)]
                gl, hl = sums[0][:, :-1], sums[1][:, :-1]
                gt, ht = g[rows].sum(), h[rows].sum()
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                f, b = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[f, b] > 1e-6 and b < len(cuts[f]):
                    feature[node], threshold[node] = f, cuts[f][b]
            at[rows] = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
        leaf = at - inner
        value = RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
        total += value[leaf]
        features_.append(feature), thresholds.append(threshold), values.append(value)
    return Boosted(np.array(features_), np.array(thresholds), np.array(values), base)


def decode(nodes: list[Node], raw: np.ndarray) -> np.ndarray:
    """The likeliest kept nodes of which each has a kept parent; the page itself is kept."""
    keep, drop = -np.logaddexp(0, -raw), -np.logaddexp(0, raw)
    for k in range(len(nodes) - 1, 0, -1):
        p = nodes[k].parent
        keep[p] += max(keep[k], drop[k])
        drop[p] += drop[k]
    kept = np.zeros(len(nodes), bool)
    kept[0] = True
    for k in range(1, len(nodes)):
        kept[k] = kept[nodes[k].parent] and keep[k] > drop[k]
    return kept


def marked(nodes: list[Node]) -> np.ndarray | None:
    """Nodes that have article text below them, by the page's own marks; none if it marks no article."""
    roots = [k for k, x in enumerate(nodes) if x.tag in ("article", "main")]
    if len(roots) != 1:
        return None
    label, bad = np.zeros(len(nodes), bool), {w for own in BAD.values() for w in own} - {"date", "author", "byline", "meta", "more", "side"}
    inside = np.zeros(len(nodes), bool)
    for k, x in enumerate(nodes):
        out = x.tag in ("nav", "aside", "form", "footer") or any(t in bad for t in x.tokens) or x.hidden
        inside[k] = k == roots[0] or (x.parent >= 0 and inside[x.parent] and not out)
    label |= inside
    k = roots[0]
    while k >= 0:
        label[k] = True
        k = nodes[k].parent
    return label


def layout(paragraphs: list[str], rng: random.Random) -> tuple[str, set[int]]:
    """A page built around paragraphs, and the numbers (in page order, the page is 0) of the nodes that
    lead to the article's text."""
    out, good, count, path = [], set(), [0], []
    words = " ".join(paragraphs).split() or ["text"]
    few = lambda a, b: " ".join(rng.choice(words) for _ in range(rng.randint(a, b)))

    def element(tag: str, body, attrs: str = "", content: bool = False) -> None:
        count[0] += 1
        path.append(count[0])
        if content:
            good.update(path)
        out.append(f"<{tag}{' ' + attrs if attrs else ''}>")
        body() if callable(body) else out.append(html_lib.escape(body))
        out.append(f"</{tag}>")
        path.pop()

    def named(kind: str) -> str:
        token = rng.choice(BAD[kind])
        return rng.choice([f'class="{token}"', f'id="{token}"', f'class="{rng.choice(["box", "site", "js", "c1"])}-{token}"', f'class="{token} {few(1, 1)}"'])

    def links(n: int) -> None:
        element("ul", lambda: [element("li", lambda: out.append(f'<a href="#">{html_lib.escape(few(1, 4))}</a>')) for _ in range(n)])

    def loose(text: str, content: bool = False) -> None:
        """Text directly in the page; a block has to follow."""
        count[0] += 1
        if content:
            good.add(count[0])
        out.append(rng.choice(["", "<b>", "<span>"]) + html_lib.escape(text).replace(". ", rng.choice([". ", ".<br><br>", ".<br>"])))

    def prose(n: int) -> None:
        for _ in range(n):
            element("p", few(3, 60))

    def top() -> None:
        plain = rng.random() < 0.4
        element("header" if plain else "div", lambda: (element("div", few(1, 4)), element("nav" if rng.random() < 0.5 else "div", lambda: links(rng.randint(3, 9)), named("menu"))), "" if plain else named("head"))
        if rng.random() < 0.5:
            element("nav", lambda: links(rng.randint(3, 9)))

    def aside(kind: str) -> None:
        tag = "aside" if kind == "side" and rng.random() < 0.5 else rng.choice(["div", "section"])
        body = rng.choice([lambda: links(rng.randint(2, 8)), lambda: prose(rng.randint(1, 4)), lambda: out.append(html_lib.escape(few(3, 25))), lambda: (element("h3", few(1, 4)), links(rng.randint(2, 6)))])
        element(tag, body, "" if tag == "aside" and rng.random() < 0.5 else named(kind))

    def form() -> None:
        element("form", lambda: (element("p", few(2, 12)), out.append('<label>x</label><input type="text"><button>ok</button>')), rng.choice(["", named("form"), named("notice")]))

    def talk() -> None:
        one = lambda: element("div", lambda: (element("p", few(1, 3)), prose(rng.randint(1, 2))), rng.choice([named("talk"), 'class="item"']))
        element(rng.choice(["div", "section"]), lambda: (element("h3", few(1, 3)), [one() for _ in range(rng.randint(1, 6))]), named("talk"))

    def story() -> None:
        element("h1", few(3, 12), content=True)
        if rng.random() < 0.3:
            element("div", few(2, 6), named("share"))
        for k, text in enumerate(paragraphs):
            r = rng.random()
            if r < 0.06:
                element("h2", few(2, 7), content=True)
            elif r < 0.10:
                element("ul", lambda: [element("li", few(3, 20), content=True) for _ in range(rng.randint(2, 5))])
            elif r < 0.13:
                element("blockquote", lambda: element("p", few(5, 40), content=True))
            elif r < 0.17:
                aside(rng.choice(["advert", "side", "notice"]))
            wrap = rng.random() < 0.05
            element("div", lambda t=text: element("p", t, content=True)) if wrap else element("p", text, content=True)
        if rng.random() < 0.3:
            talk()
        if rng.random() < 0.3:
            element("footer", few(3, 12))

    def bare() -> None:
        """An article whose text stands directly in the page."""
        element("h1", few(3, 12), content=True)
        for text in paragraphs:
            loose(text, content=True)
            rng.choice([lambda: element("h2", few(2, 7), content=True), lambda: element("p", few(5, 40), content=True), lambda: element("div", few(1, 6), named("advert"))])()

    def main() -> None:
        tag = rng.choice(["article", "main", "div", "div", "section"])
        token = rng.choice(GOOD)
        element(tag, story, rng.choice(["", f'class="{token}"', f'id="{token}"', f'class="{token}-{rng.choice(GOOD)}"']))

    top() if rng.random() < 0.85 else None
    for kind in rng.sample(["notice", "advert", "side"], rng.randint(0, 3)):
        aside(kind)
    if rng.random() < 0.15:
        bare()
    else:
        main() if rng.random() < 0.5 else element("div", lambda: (main(), aside("side") if rng.random() < 0.5 else None), rng.choice(["", 'id="wrapper"', 'class="container"']))
    for kind in rng.sample(["side", "advert", "share"], rng.randint(0, 2)):
        aside(kind)
    talk() if rng.random() < 0.5 else None
    form() if rng.random() < 0.4 else None
    if rng.random() < 0.1:
        loose(few(2, 8))
        aside("share")
    if rng.random() < 0.85:
        plain = rng.random() < 0.5
        element("footer" if plain else "div", lambda: (out.append(html_lib.escape(few(3, 25))), links(rng.randint(0, 6))), "" if plain else named("foot"))
    return "".join(out), good | {0}


def train(pages: list[str], seed: int = 9) -> Boosted:
    rng, rows, labels = random.Random(seed), [], []
    for page in pages:
        nodes, runs = parse(page)
        label = marked(nodes)
        long = [t for _, t in runs if len(t) > 40]
        if label is not None:
            rows.append(features(nodes)), labels.append(label)
            long = [t for k, t in runs if label[k] and nodes[k].tag == "p"] or long
        for _ in range(LAYOUTS if long else 0):
            size = rng.randint(1, 12) if rng.random() < 0.95 else rng.randint(200, 400)
            made, good = layout(rng.sample(long, min(len(long), size)) if size <= 12 else rng.choices(long, k=size), rng)
            nodes, _ = parse(made)
            rows.append(features(nodes)), labels.append(np.isin(np.arange(len(nodes)), list(good)))
    if not rows:
        rows, labels = [features([Node("body", -1, 0)])], [np.ones(1, bool)]
    return boost(np.concatenate(rows), np.concatenate(labels).astype(float))


def extract(pages: list[str], model: Boosted) -> list[str]:
    """Main text of each page: kept blocks in page order, two line feeds between them."""
    parsed = [parse(p) for p in pages]
    raw = model.raw(np.concatenate([features(n) for n, _ in parsed])) if parsed else np.zeros(0)
    out, at = [], 0
    for nodes, runs in parsed:
        kept = decode(nodes, raw[at : at + len(nodes)])
        at += len(nodes)
        bare = all(x.tag == LOOSE for x in nodes[1:])
        out.append("\n\n".join(t for k, t in runs if kept[k] or bare))
    return out


def training_pages(pages: DataFrame) -> list[str]:
    """At most SAMPLE_PAGES pages of at most SAMPLE_CHARS characters, in the order of a hash of the page."""
    own = pages.select("html").filter((F.length("html") > 0) & (F.length("html") <= SAMPLE_CHARS))
    return sorted(r["html"] for r in own.orderBy(F.xxhash64("html"), "html").limit(SAMPLE_PAGES).collect())


def main_text(pages: DataFrame, model: Boosted) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars``. A null or empty page, and one without an article, has an empty
    text; a page without any block element is text as a whole, and text directly in the page between
    blocks is judged like a block. Repeated rows, nulls in other columns and an
    empty table are kept as they are; columns named ``text`` or ``n_chars`` are replaced."""
    names = [c for c in pages.columns if c not in ("text", "n_chars")]
    sent = pages.sparkSession.sparkContext.broadcast(model)  # TREES small trees

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for own in batches:
            found: list[str] = []
            for at in range(0, len(own), 64):
                found += extract(own.iloc[at : at + 64].tolist(), sent.value)
            yield pd.Series(found, dtype=object)

    return pages.select(*names).withColumn("text", texts(text_or_empty("html"))).withColumn("n_chars", F.length("text").cast("long"))


def op4_html_trees(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return main_text(pages, train(training_pages(pages))).select("page_id", "url", "text", "n_chars")
