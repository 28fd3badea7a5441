"""Operator 9: main text of web pages by boosted trees over the page's nodes.

Every element and every run of text of a page is a node with features of its
subtree (size, text density, links), its place (depth, siblings, position) and
its words (tag, class, id, role; its own and its ancestors'). Gradient-boosted
trees give each node log-odds of holding main text. Decoding is hierarchical:
a node is kept only with all its ancestors, and of all such choices the one
with the largest sum is taken, so a kept block never stands in a dropped part.

The trees are trained here, on a bounded sample of the pages: each as it is
(its <article> or <main> is the main text), with those tags replaced by blocks
without a telling name, and laid out anew at random with other tags, class
names and nameless blocks, where the parts are known. Most main texts seen have
no name, so the trees have to go by density, depth and siblings.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filinglens.llm.common import renamed, staged, strings

# A value may hold ">" only in quotes after "="; where such quotes leave the
# tag without an end, the first ">" ends it. No part gives back what it took.
OPEN_ENDED = r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)"
TOKEN = re.compile(OPEN_ENDED + r"""|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+(?=>)|[^>]*+)>""", re.S)
TAIL = re.compile(OPEN_ENDED + "|(?!)()()()", re.S)  # what may still stand after the page's last ">"
ATTRIBUTE = re.compile(r"""(?:^|[\s/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[a-z]+|[0-9]+")

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe".split())  # without an end they take the rest of the page
LEFT_BY_BLOCKS = frozenset("select svg".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup "
                   "time tt u var wbr img data".split())
CLOSES_P = frozenset("address article aside blockquote details dialog div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
                     "hr li main menu nav ol p pre section table tbody td tfoot th thead tr ul body html".split())
SELF_CLOSING = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}
TWIN = {"dt": "dd", "dd": "dt", "td": "th", "th": "td"}
GROUPS = ("article main", "nav menu", "header", "footer", "aside", "form button input fieldset", "p", "h1 h2 h3 h4 h5 h6", "ul ol li dl dt dd", "table tr td th tbody",
          "div section", "pre blockquote figure", "body html", "#text")
GROUP = {tag: i for i, g in enumerate(GROUPS) for tag in g.split()}
OWN, ABOVE = 192, 192  # slots for words of a node and of its ancestors
NUMBERS = 18
WIDTH = NUMBERS + len(GROUPS) + OWN + ABOVE


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    words: list[str]
    text: str = ""
    chars: int = 0
    linked: int = 0
    tags: int = 0
    stops: int = 0
    runs: int = 0
    paragraphs: int = 0
    items: int = 0
    inputs: int = 0
    start: int = 0
    children: list[int] = field(default_factory=list)


def tree(page: str) -> list[Node]:
    """Nodes in page order, the root first; runs of text are nodes ``#text``
    of their block element, white space in them made one space."""
    nodes = [Node("#root", -1, 0, [])]
    stack: list[tuple[str, int]] = [("#root", 0)]  # blocks that are open
    opened: Counter[str] = Counter()  # of the stack's tags
    inline: Counter[str] = Counter()
    buffer: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        raw = "".join(buffer)
        buffer.clear()
        # References are decoded before white space is counted.
        text = " ".join(raw.split())
        if text:
            at = stack[-1][1]
            nodes.append(Node("#text", at, nodes[at].depth + 1, [], text=text, chars=len(text), linked=min(linked, len(text)), runs=1,
                              stops=sum(text.count(c) for c in ".,;:!?")))
            nodes[at].children.append(len(nodes) - 1)
        linked = 0

    def said(raw: str) -> None:
        nonlocal linked
        text = html.unescape(raw) if "&" in raw else raw
        buffer.append(text)
        if inline["a"]:
            linked += len(" ".join(text.split()))

    def close(k: int) -> None:
        opened.subtract(t for t, _ in stack[k:])
        del stack[k:]

    at, last = 0, page.rfind(">") + 1
    while True:
        m = (TOKEN if page.find("<", at, last) >= 0 else TAIL).search(page, at)
        said(page[at : m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        if m[1] is not None:
            buffer.append(m[1])
        if not m[3]:
            continue
        tag, closing = m[3].lower(), bool(m[2])
        if tag in RAW:
            if not closing and not m[4].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            if tag not in ("script", "style", "template", "title"):
                flush()
                nodes[stack[-1][1]].inputs += tag == "textarea"
            continue
        if tag in INLINE:
            if closing:
                inline[tag] -= inline[tag] > 0
            elif tag not in VOID:
                inline[tag] += 1
            nodes[stack[-1][1]].tags += not closing
            continue
        flush()
        if tag in VOID:
            nodes[stack[-1][1]].tags += 1
            nodes[stack[-1][1]].inputs += tag == "input"
            continue
        if closing:
            if opened[tag]:
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                close(k)
                inline.clear()
            continue
        if tag in CLOSES_P and any(opened[t] for t in LEFT_BY_BLOCKS):
            close(next(k for k in range(1, len(stack)) if stack[k][0] in LEFT_BY_BLOCKS))
        if tag in CLOSES_P and stack[-1][0] == "p":
            close(len(stack) - 1)
            inline.clear()
        if tag in SELF_CLOSING and (opened[tag] or opened[TWIN.get(tag, tag)]):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in SELF_CLOSING[tag]:
                    break
                if stack[k][0] in (tag, TWIN.get(tag)):
                    close(k)
                    break
        words = [w for a in ATTRIBUTE.finditer(m[4]) for w in PART.findall((a[2] or a[3] or a[4] or "").lower())] if m[4] else []
        up = stack[-1][1]
        nodes.append(Node(tag, up, nodes[up].depth + 1, words))
        nodes[up].children.append(len(nodes) - 1)
        if not m[4].rstrip().endswith("/"):
            stack.append((tag, len(nodes) - 1))
            opened[tag] += 1
    flush()

    seen = 0
    for v in nodes:  # page order: text before a node is what was seen so far
        v.start = seen
        seen += v.chars
    for i in range(len(nodes) - 1, 0, -1):
        v, up = nodes[i], nodes[nodes[i].parent]
        up.chars += v.chars
        up.linked += v.linked
        up.tags += v.tags + (v.tag != "#text")
        up.stops += v.stops
        up.runs += v.runs
        up.paragraphs += v.paragraphs + (v.tag == "p")
        up.items += v.items + (v.tag == "li")
        up.inputs += v.inputs + (v.tag in ("form", "button", "select"))
    return nodes


def slot(word: str, n: int) -> int:
    return zlib.crc32(word.encode()) % n


def features(nodes: list[Node], known: frozenset[str]) -> np.ndarray:
    """A row of features per node; words that aren't ``known`` say nothing."""
    x = np.zeros((len(nodes), WIDTH), dtype=np.float32)
    total = max(nodes[0].chars, 1)
    log = np.log1p
    for i, v in enumerate(nodes):
        up = nodes[v.parent] if i else v
        same = len(up.children)
        place = up.children.index(i) if i and same < 64 else 0
        x[i, :NUMBERS] = (
            v.depth, log(v.chars), v.linked / max(v.chars, 1), log(v.tags), log(v.chars / (v.tags + 1)), log(v.stops), log(v.chars / max(v.runs, 1)),
            same, place / max(same - 1, 1), v.chars / total, v.start / total, log(v.paragraphs), log(v.items), v.inputs,
            up.linked / max(up.chars, 1), v.chars / max(up.chars, 1), log(up.chars / (up.tags + 1)), up.inputs,
        )
        if v.tag in GROUP:
            x[i, NUMBERS + GROUP[v.tag]] = 1
        own = NUMBERS + len(GROUPS)
        if i:
            x[i, own + OWN :] = x[v.parent, own + OWN :]
        for w in known.intersection([v.tag, *v.words]):
            x[i, own + slot(w, OWN)] = 1
            if v.tag != "#text":
                x[i, own + OWN + slot(w, ABOVE)] = 1
    return x


@dataclass
class Trees:
    """Boosted trees as arrays: a child of -1 marks a leaf. ``known``: the tags
    and words of attributes that the features tell apart."""

    feature: list[np.ndarray]
    threshold: list[np.ndarray]
    left: list[np.ndarray]
    right: list[np.ndarray]
    value: list[np.ndarray]
    known: frozenset[str] = frozenset()

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.zeros(len(x)), np.arange(len(x))
        for f, t, lo, hi, v in zip(self.feature, self.threshold, self.left, self.right, self.value, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            while (lo[at] >= 0).any():
                at = np.where(lo[at] < 0, at, np.where(x[rows, f[at]] <= t[at], lo[at], hi[at]))
            out += v[at]
        return 2.0 * out


def arrays_of(model, known: frozenset[str]) -> Trees:
    """The trained trees of a classification model, read node by node."""
    out = Trees([], [], [], [], [], known)
    for tree_, weight in zip(model.trees, model.treeWeights, strict=True):
        f, t, lo, hi, v = [], [], [], [], []

        def add(node) -> int:
            i = len(f)  # noqa: B023
            leaf = node.getClass().getSimpleName() == "LeafNode"
            f.append(0 if leaf else node.split().featureIndex())  # noqa: B023
            t.append(0.0 if leaf else node.split().threshold())  # noqa: B023
            v.append(weight * node.prediction())  # noqa: B023
            lo.append(-1)  # noqa: B023
            hi.append(-1)  # noqa: B023
            if not leaf:
                lo[i], hi[i] = add(node.leftChild()), add(node.rightChild())  # noqa: B023
            return i

        add(tree_._java_obj.rootNode())
        for into, got in zip((out.feature, out.threshold, out.left, out.right, out.value), (f, t, lo, hi, v), strict=True):
            into.append(np.array(got))
    return out


def decode(nodes: list[Node], odds: np.ndarray) -> str:
    """The texts of the choice of nodes, closed under ancestors, with the
    largest sum of log-odds; a text is kept only if its own are above 0 too."""
    best = odds.copy()
    for i in range(len(nodes) - 1, 0, -1):
        if best[i] > 0:
            best[nodes[i].parent] += best[i]
    kept = np.zeros(len(nodes), dtype=bool)
    kept[0] = True
    for i, v in enumerate(nodes[1:], 1):
        kept[i] = kept[v.parent] and best[i] > 0
    return "\n".join(v.text for v, k in zip(nodes, kept, strict=True) if k and v.text)


# Words that layouts give to their parts, for the pages laid out anew.
MAIN = ("article", "main", "div.content", "div#main-content", "div.post", "div.entry-content", "section.story", "div.article-body", "div.post-content", "div[role=main]", "section.article")
REST = {
    "menu": ("nav", "div.menu", "ul.navigation", "div#nav", "div.breadcrumbs", "ul.nav", "div[role=navigation]", "div.navbar"),
    "head": ("header", "div.header", "div#masthead", "div.topbar", "div.site-header", "div[role=banner]"),
    "foot": ("footer", "div.footer", "div#footer", "div.site-footer", "div.copyright", "div[role=contentinfo]"),
    "side": ("aside", "div.sidebar", "div#sidebar", "div.related", "div.widget", "section.recommended", "div.trending", "div[role=complementary]"),
    "ad": ("div.ad", "div.ads", "div.advert", "div.advertisement", "div.sponsored", "div.banner", "div.promo", "aside.ad"),
    "notice": ("div.cookie-notice", "div.notice", "div#cookies", "div.consent", "div.alert", "div.popup", "div.newsletter", "div.subscribe"),
    "form": ("form", "form.search", "form.login", "div.form", "form#newsletter"),
    "comments": ("div.comments", "section.comments", "div#comments", "ol.comment-list", "div.comment", "div.replies", "section#discussion", "div.reader-comments"),
    "share": ("div.share", "div.social", "ul.tags", "div.byline", "div.pagination"),
}


LAYOUT_WORDS = frozenset(GROUP) | frozenset(w for spec in [*MAIN, *sum(REST.values(), ())] for w in PART.findall(spec))


def _open(spec: str) -> tuple[str, str]:
    tag, _, rest = spec.partition("[")
    name, mark, word = re.fullmatch(r"(\w+)([.#]?)(.*)", tag).groups()
    if rest:
        return f"<{name} {rest.rstrip(']')}>", f"</{name}>"
    return f"<{name}" + (f" class={word!r}" if mark == "." else f' id="{word}"' if mark else "") + ">", f"</{name}>"


def nameless(r: np.random.Generator) -> tuple[str, str]:
    """A block without a class, or with one that tells nothing."""
    tag = ("div", "div", "section")[int(r.integers(3))]
    word = "".join(chr(97 + int(c)) for c in r.integers(0, 26, int(r.integers(2, 8)))) + ("" if r.random() < 0.5 else str(int(r.integers(100))))
    return f"<{tag}" + (f' class="{word}"' if r.random() < 0.6 else "") + ">", f"</{tag}>"


def unmarked(page: str, r: np.random.Generator) -> str:
    """The page with <article> and <main> replaced by nameless blocks; its nodes stay the same."""
    a, z = nameless(r)
    return re.sub(r"(?i)</(article|main)\s*>", z, re.sub(r"(?i)<(article|main)(?=[\s/>])", a[:-1], page))


def laid_out(blocks: list[str], scraps: list[str], r: np.random.Generator) -> str:
    """A page with the blocks as its main text and the scraps around and in it.
    Scraps stand after a NUL, which no feature sees, so that labels follow."""
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    esc = lambda s: html.escape(s, quote=False)

    def part(kind: str) -> str:
        a, z = _open(pick(REST[kind])) if r.random() < 0.85 or kind in ("comments", "side") else nameless(r)
        texts = ["\0" + esc(pick(scraps)) for _ in range(int(r.integers(1, 6)))]
        if kind == "menu" or kind == "share":
            inner = "<ul>" + "".join(f'<li><a href="#">{t[:24]}</a></li>' for t in texts) + "</ul>"
        elif kind == "form":
            inner = "".join(f"<label>{t[:24]}</label><input>" for t in texts) + "<button>\0OK</button>"
        elif kind == "comments":
            inner = "".join(f'<div class="comment"><p>{t}</p></div>' if r.random() < 0.5 else f"<p>{t}</p>" for t in texts)
        elif kind in ("ad", "notice", "foot", "head") and r.random() < 0.6:
            inner = " ".join(texts[:2])
        else:
            inner = "".join(f"<p>{t}</p>" for t in texts)
        return a + inner + z

    inside = []
    for i, b in enumerate(blocks):
        if r.random() < 0.25:
            b = " ".join(b.split()[: int(r.integers(1, 8))])
        if r.random() < 0.1:
            inside.append(f"<p>{esc(b)}<br>{esc(b[:30])}</p>")
            continue
        inside.append(f"<h1>{esc(b)}</h1>" if i == 0 and r.random() < 0.7 else pick((f"<p>{esc(b)}</p>", f"<p>{esc(b)}</p>", f"<p>{esc(b)}</p>", f"<p><b>{esc(b)}</b></p>",
                      f"<blockquote><p>{esc(b)}</p></blockquote>", f"<ul><li>{esc(b)}</li></ul>", f"<h2>{esc(b)}</h2>" if len(b) < 80 else f"<p>{esc(b)}</p>", f"<div>{esc(b)}</div>")))
        if r.random() < 0.15:
            inside.append(part(pick(("ad", "side", "share", "notice"))))
    wrap = r.random()
    a, z = _open(pick(MAIN)) if wrap < 0.4 else nameless(r) if wrap < 0.9 else ("", "")  # some pages don't wrap their text
    if a and r.random() < 0.3:
        b, y = _open(pick(MAIN))
        a, z = a + b, y + z
    if r.random() < 0.2:
        inside.append(part("comments"))
    before = [part(k) for k in ("menu", "head", "notice", "ad", "form") if r.random() < 0.5]
    after = [part(k) for k in ("side", "comments", "share", "form", "foot", "notice", "ad", "menu") if r.random() < 0.5]
    body = "".join(before) + a + "".join(inside) + z + "".join(after)
    if r.random() < 0.5:
        b, y = _open(pick(("div.wrapper", "div#page", "div.container", "section.layout")))
        body = b + body + y
    return f"<html><head><title>x</title></head><body>{body}</body></html>"


def labelled(page: str, seed: int, known: frozenset[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features and labels of the nodes of a page, twice of the page
    without its marks and of two new layouts of it. A node's label: its subtree holds main text."""
    nodes = tree(page)
    main = np.zeros(len(nodes), dtype=bool)
    for i, v in enumerate(nodes[1:], 1):
        main[i] = main[v.parent] and v.tag not in ("nav", "aside", "form", "header", "footer") or v.tag in ("article", "main")
    texts = [i for i, v in enumerate(nodes) if v.text]
    blocks = [nodes[i].text for i in texts if main[i]]
    scraps = [nodes[i].text for i in texts if not main[i]]
    if not blocks:
        return
    r = np.random.default_rng(seed)
    for k in range(5):
        if 0 < k < 3:
            nodes = tree(unmarked(page, r))
            if len(nodes) != len(main):
                continue
        if k > 2:
            # Long scraps too: a comment may read like a paragraph.
            nodes = tree(laid_out(blocks[: int(r.integers(1, 24))], scraps + blocks[-2:] or blocks, r))
        y = np.zeros(len(nodes))
        for i, v in enumerate(nodes):
            if v.text:
                y[i] = main[i] if k < 3 else "\0" not in v.text
        for i in range(len(nodes) - 1, 0, -1):
            y[nodes[i].parent] = max(y[nodes[i].parent], y[i])
        yield features(nodes, known), y


def train(pages: DataFrame, sample_pages: int = 240, seed: int = 5, rounds: int = 20, depth: int = 5, words: int = 400) -> Trees:
    """Trees fitted on at most ``sample_pages`` pages, the smallest by a seeded
    hash of their html; without a page that marks its main text, on one of a
    few words. Known words: those of the layouts made here and the
    ``words`` that most of the sampled pages hold, in at least two."""

    def nodes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for page in strings(b["html"]):
                for x, y in labelled(page, zlib.crc32(page.encode()) ^ seed, known):
                    yield pa.RecordBatch.from_arrays([pa.array(list(x.astype(float)), pa.list_(pa.float64())), pa.array(y)], names=["x", "label"])

    marked = renamed(pages, html="html").where(F.lower(F.col("html")).rlike("<(article|main)[\\s>]"))
    # Only hashes are shuffled; then the pages that have the smallest, each once.
    marked = marked.withColumn("h", F.xxhash64(F.lit(seed), "html"))
    hashes = [r["h"] for r in marked.select("h").distinct().orderBy("h").limit(sample_pages).collect()]
    some = marked.where(F.col("h").isin(hashes)).groupBy("h").agg(F.min("html").alias("html")).orderBy("h").select("html")
    if not hashes:
        some = pages.sparkSession.createDataFrame([("<body><nav>menu</nav><article><h1>Some title</h1><p>Some words of a text, and more of them.</p></article></body>",)], "html string")
    some = staged(pages.sparkSession, some.coalesce(1), "sampled-pages")

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for page in strings(b["html"]):
                yield pa.RecordBatch.from_arrays([pa.array(sorted({w for v in tree(page) for w in (v.tag, *v.words)}), pa.string())], names=["w"])

    common = some.mapInArrow(words_of, "w string").groupBy("w").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "w").limit(words)
    known = frozenset(r["w"] for r in common.collect()) | LAYOUT_WORDS
    rows = some.coalesce(1).mapInArrow(nodes_of, "x array<double>, label double").select(array_to_vector("x").alias("features"), "label").cache()
    try:
        model = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=seed, maxBins=32).fit(rows)
    finally:
        rows.unpersist()
    return arrays_of(model, known)


def main_text(spark: SparkSession, pages: DataFrame, model: Trees) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url,
    html). Null, empty and text-free html gives an empty text; repeated rows
    each keep a row; other columns are not read. One pass without a shuffle;
    the broadcast model's size is set by its rounds and depth."""
    shared = spark.sparkContext.broadcast((model.feature, model.threshold, model.left, model.right, model.value, model.known))  # arrays: no class to import

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Trees(*shared.value)
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                trees = [tree(p) for p in strings(part["html"])]
                odds = model.log_odds(np.concatenate([features(t, model.known) for t in trees]))
                cut = np.cumsum([0, *map(len, trees)])
                texts = [decode(t, odds[i:j]) for t, i, j in zip(trees, cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                                 names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return renamed(pages, page_id="page_id", url="url", html="html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
