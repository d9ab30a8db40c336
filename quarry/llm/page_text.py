"""10. HTML extraction by a tree-structured graphical model.

A page becomes a tree of its block elements (inline elements belong to the block
around them).  Each node is content or not: unary potentials come from features
of the node, pairwise ones join it to its parent, by kind of child.  Sum-product
messages go up the tree and down again, for all pages of a batch at once, level by
level, and give every node's marginal; a block's text stays if it is above one half.

The weights are trained here, by gradient ascent on the exact likelihood: on a
bounded sample of the pages that mark their main part themselves (``article`` or
``main``, without the boilerplate nested in it), and on a few labelled pages below
that show what those may lack (comments, sidebars, pages without such marks).

Text: character references decoded, white space inside a block turned into one
space, blocks trimmed and joined in page order by one space.  Scripts, styles,
templates, drawings, comments and the head are no text; formulas and what an
``object`` holds are text of the block around them.  Unclosed and stray tags are repaired
as browsers do in the simple cases; a tag cut off by the page's end is dropped.  A tag
ends at its first ``>`` outside quotes; a quote that no white space, ``/`` or ``>`` follows
where it closes is taken as a stray one.  ``svg`` ends where it closes itself, or at the
end tag that matches; an unclosed ``svg``, ``template``, ``noscript`` or ``select`` holds nothing.
Null and empty pages give an empty text; a page of bare text is judged by its
root.  Repeated rows give equal texts; other columns do not matter.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.scan import as_id, hashed_fraction, scan

#: Pages that weights are trained on at most, beside the labelled ones below.
SAMPLE = 300

# HTML element names by what they do.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"iframe", "noembed", "noframes", "noscript", "script", "style", "svg", "template", "textarea", "title", "xmp", "select", "head", "annotation", "annotation-xml"}
#: Of these, those whose content is markup: without an end tag they hold nothing.
NO_RAW = {"svg", "template", "noscript", "select", "annotation", "annotation-xml"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
          "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "object",
          "math", "menclose", "merror", "mfenced", "mfrac", "mi", "mmultiscripts", "mn", "mo", "mover", "mpadded", "mphantom", "mroot", "mrow", "ms", "mspace", "msqrt",
          "mstyle", "msub", "msubsup", "msup", "mtable", "mtd", "mtext", "mtr", "munder", "munderover", "semantics"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "article", "section", "div", "main", "body", "nav", "aside", "footer", "header", "form", "blockquote"}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"(?=[\s/>]|\Z)|'[^']*'(?=[\s/>]|\Z)|["'])*)(?:>|\Z)""", re.S)
_SVG = re.compile(r"<(/?)svg\b([^>]*)>", re.I)
_NAMED = re.compile(r"""\b(?:class|id|role|itemprop|aria-label|data-main)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_BAD = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner\w*|sponsor\w*|promo\w*|nav\w*|menu\w*|side-?bar\w*|foot\w*|breadcrumb\w*|cookie\w*|consent|notice\w*|popup|modal|"
                  r"share|sharing|social\w*|related|recommend\w*|newsletter|subscri\w*|signup|login|search\w*|widget\w*|pagination|pager|toolbar|masthead|topbar|copyright|legal|disclaimer|alert\w*|outbrain|taboola|tags?|byline-share)(?=$|[\s_-])", re.I)
_COMMENT = re.compile(r"(?:^|[\s_-])(?:comments?\w*|disqus\w*|repl(?:y|ies)|respond|discussion|reviews?)(?=$|[\s_-])", re.I)
_GOOD = re.compile(r"(?:^|[\s_-])(?:article\w*|content|main\w*|post|post-?(?:body|content|text)|entry\w*|story\w*|text|body|prose)(?=$|[\s_-])", re.I)

GROUPS = [{"p"}, {"h1"}, {"h2", "h3", "h4", "h5", "h6"}, {"li", "ul", "ol", "dl", "dt", "dd"}, {"div"}, {"section"}, {"article", "main"},
          {"nav", "footer", "aside", "form", "menu", "button", "fieldset", "dialog", "address"}, {"header"}, {"table", "tr", "td", "th", "tbody", "thead", "caption"},
          {"blockquote", "pre", "figure", "figcaption"}, {"#page", "html", "body"}]
FEATURES = 1 + len(GROUPS) + 1 + 3 + 7
#: Kinds of children with potentials of their own: plain, boilerplate by tag or name, container, header.
KINDS = 4


_END = {tag: re.compile(rf"</{tag}\s*>" if tag != "head" else r"</head\s*>|(?=<body\b)", re.I) for tag in RAW}


def _svg_ends(s: str) -> dict[int, int]:
    """Where the drawings that start at the keys end, those within them left out."""
    ends, open_at = {}, []
    for m in _SVG.finditer(s):
        if not m.group(1):
            if not m.group(2).endswith("/"):
                open_at.append(m.start())
        elif open_at:
            ends[open_at.pop()] = m.end()
    return ends


class Page:
    """The block elements of a page and its runs of text."""

    __slots__ = ("tags", "names", "parents", "texts", "links", "runs")

    def __init__(self, source: str):
        self.tags, self.names, self.parents = ["#page"], [""], [-1]
        self.texts, self.links = [0], [0]  # letters directly in a node, and those inside links
        self.runs: list[tuple[int, str]] = []
        self._parse(source)

    def _parse(self, s: str) -> None:
        stack: list[tuple[str, int]] = [("#page", 0)]  # (tag, node); an inline tag has its block's node
        parts: list[str] = []
        linked = 0
        drawings, unclosed = None, set()

        def flush():
            nonlocal linked
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    node = stack[-1][1]
                    self.runs.append((node, text))
                    self.texts[node] += len(text)
                    self.links[node] += min(linked, len(text))
                parts.clear()
            linked = 0

        at = 0
        while True:
            m = _TAG.search(s, at)
            chunk = s[at:m.start() if m else len(s)]
            if chunk:
                chunk = entities.unescape(chunk) if "&" in chunk else chunk
                parts.append(chunk)
                if any(t == "a" for t, _ in reversed(stack[-3:])):
                    linked += len(chunk.strip())
            if not m:
                break
            at = m.end()
            close, tag = m.group(1), m.group(2)
            if tag is None or (m.group()[-1:] != ">" and at == len(s)):
                continue
            tag = tag.lower()
            if close:
                if tag in INLINE:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == tag:
                            del stack[k]
                            break
                        if stack[k][0] not in INLINE:
                            break
                elif any(t == tag for t, _ in stack):
                    flush()
                    while stack.pop()[0] != tag:
                        pass
                elif tag == "p":
                    flush()
                continue
            if tag in RAW:
                if tag == "svg":
                    drawings = _svg_ends(s) if drawings is None else drawings
                    end = drawings.get(m.start())
                else:
                    end = None if tag in unclosed else _END[tag].search(s, at)
                    if end is None:
                        unclosed.add(tag)  # nor from any later place
                    else:
                        end = end.end()
                if end is not None:
                    at = end
                elif tag != "head" and tag not in NO_RAW:
                    at = len(s)
                if tag not in ("svg", "script", "style", "head", "annotation", "annotation-xml") or tag == "head" and end is not None:
                    flush()
                continue
            if tag == "br":
                parts.append(" ")
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                continue
            if tag in INLINE:
                if not m.group(3).endswith("/"):
                    stack.append((tag, stack[-1][1]))
                continue
            flush()
            # a block start ends an open paragraph, and list or table parts their like
            ends = CLOSES.get(tag, set()) | {"p"}
            for k in range(len(stack) - 1, 0, -1):
                t = stack[k][0]
                if t in ends:
                    del stack[k:]
                    break
                if t in SCOPES:
                    break
            named = " ".join(x for y in _NAMED.findall(m.group(3)) for x in y if x) if "=" in m.group(3) else ""
            self.parents.append(stack[-1][1])
            self.tags.append(tag)
            self.names.append(named)
            self.texts.append(0)
            self.links.append(0)
            stack.append((tag, len(self.tags) - 1))
        flush()

    def kinds(self) -> np.ndarray:
        return np.array([1 if t in GROUPS[7] or _BAD.search(n) or _COMMENT.search(n) else 2 if t in ("div", "section", "article", "main", "body", "html") else 3 if t == "header" else 0
                         for t, n in zip(self.tags, self.names, strict=True)])

    def features(self) -> np.ndarray:
        n = len(self.tags)
        x = np.zeros((n, FEATURES))
        x[:, 0] = 1
        for i, tag in enumerate(self.tags):
            x[i, next((1 + g for g, tags in enumerate(GROUPS) if tag in tags), 1 + len(GROUPS))] = 1
        a = 2 + len(GROUPS)
        for i, name in enumerate(self.names):
            if name:
                bad, comment = bool(_BAD.search(name)), bool(_COMMENT.search(name))
                x[i, a:a + 3] = bad, comment, bool(_GOOD.search(name)) and not bad and not comment
        text, link = np.array(self.texts, float), np.array(self.links, float)
        below, below_link = text.copy(), link.copy()
        for i in range(n - 1, 0, -1):
            below[self.parents[i]] += below[i]
            below_link[self.parents[i]] += below_link[i]
        a += 3
        total = max(1.0, below[0])
        x[:, a] = np.log1p(text) / 5
        x[:, a + 1] = link / np.maximum(text, 1)
        x[:, a + 2] = np.log1p(below) / 8
        x[:, a + 3] = below_link / np.maximum(below, 1)
        x[:, a + 4] = below / total
        x[:, a + 5] = text == 0
        x[:, a + 6] = (below_link > 0.5 * below) & (below > 0)
        return x

    def text(self, content: np.ndarray) -> str:
        return " ".join(t for node, t in self.runs if content[node])

    def labels(self) -> np.ndarray | None:
        """Content by the page's own marks, or None if it has none."""
        main = [i for i, t in enumerate(self.tags) if t in ("article", "main")]
        marked = [i for i, n in enumerate(self.names) if "labelled-main" in n]
        if not main and not marked:
            return None
        y = np.zeros(len(self.tags), int)
        for i, (t, n) in enumerate(zip(self.tags, self.names, strict=True)):
            if i in (marked or main):
                y[i] = 1
            elif i and y[self.parents[i]]:
                y[i] = not (t in GROUPS[7] or _BAD.search(n) or _COMMENT.search(n))
        return y


class Forest:
    """Many pages as one node table with its levels, for messages over all at once."""

    def __init__(self, parents: list[np.ndarray], kinds: list[np.ndarray], features: list[np.ndarray]):
        sizes = np.array([len(p) for p in parents])
        base = np.repeat(np.cumsum(sizes) - sizes, sizes)
        own = np.concatenate(parents)
        self.parent = np.where(own < 0, -1, own + base)
        self.kind, self.x, self.sizes = np.concatenate(kinds), np.concatenate(features), sizes
        depth = np.zeros(own.size, int)
        level = np.flatnonzero(self.parent < 0)
        self.levels = [level]
        order = np.argsort(self.parent, kind="stable")
        sorted_parent = self.parent[order]
        while level.size:
            lo, hi = np.searchsorted(sorted_parent, level), np.searchsorted(sorted_parent, level, "right")
            level = np.concatenate([order[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True) if b > a]) if (hi > lo).any() else level[:0]
            depth[level] = len(self.levels)
            if level.size:
                self.levels.append(level)

    def marginals(self, unary: np.ndarray, pair: np.ndarray, edges: bool = False):
        """(log Z, node marginals, edge marginals or None); ``unary`` (n, 2) and ``pair`` (kind, parent's, child's label) are log potentials."""
        n = len(unary)
        up, message = unary.copy(), np.zeros((n, 2))  # up: beliefs from below; message: to the parent
        for level in reversed(self.levels[1:]):
            m = np.logaddexp(*(pair[self.kind[level]][:, :, c] + up[level][:, None, c] for c in (0, 1)))
            message[level] = m
            for c in (0, 1):
                up[:, c] += np.bincount(self.parent[level], m[:, c], n)
        roots = self.levels[0]
        z = np.logaddexp(up[roots, 0], up[roots, 1])
        belief = up.copy()  # and from above
        joint = np.zeros((n, 2, 2)) if edges else None
        for level in self.levels[1:]:
            above = belief[self.parent[level]] - message[level]
            both = above[:, :, None] + pair[self.kind[level]] + up[level][:, None, :]
            belief[level] = np.logaddexp(both[:, 0], both[:, 1])
            if edges:
                e = np.exp(both - both.max(axis=(1, 2), keepdims=True))
                joint[level] = e / e.sum(axis=(1, 2), keepdims=True)
        b = np.exp(belief - belief.max(axis=1, keepdims=True))
        return z, b / b.sum(axis=1, keepdims=True), joint


class Model:
    def __init__(self):
        self.unary, self.pair = np.zeros(FEATURES), np.zeros((KINDS, 2, 2))

    def marginals(self, forest: Forest, edges: bool = False):
        score = forest.x @ self.unary
        return forest.marginals(np.stack([-score, score], axis=1) / 2, self.pair, edges)

    def texts(self, sources: list[str | None]) -> list[str]:
        pages = [Page(s or "") for s in sources]
        forest = Forest([np.array(p.parents) for p in pages], [p.kinds() for p in pages], [p.features() for p in pages])
        content = self.marginals(forest)[1][:, 1] > 0.5
        ends = np.cumsum(forest.sizes)
        return [p.text(content[e - k:e]) for p, e, k in zip(pages, ends, forest.sizes, strict=True)]


def fit(trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]], steps: int = 250, rate: float = 0.25, l2: float = 1e-3) -> Model:
    """Weights from (parents, kinds, features, labels, weight) of labelled pages, by Adagrad on the exact log-likelihood."""
    model = Model()
    forest = Forest(*(list(x) for x in zip(*(t[:3] for t in trees), strict=True)))
    y = np.concatenate([t[3] for t in trees])
    weight = np.repeat([t[4] for t in trees], forest.sizes)
    weight = weight / weight.sum()
    child = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((len(y), 2, 2))
    seen[child, y[forest.parent[child]], y[child]] = 1
    squares = np.full(FEATURES, 1e-8), np.full((KINDS, 2, 2), 1e-8)
    for _ in range(steps):
        _, p, joint = model.marginals(forest, edges=True)
        g_unary = forest.x.T @ (weight * (y - p[:, 1])) - l2 * model.unary / 100
        miss = weight[:, None, None] * (seen - joint)
        g_pair = np.stack([miss[forest.kind == k].sum(axis=0) for k in range(KINDS)]) - l2 * model.pair / 100
        for value, square, g in ((model.unary, squares[0], g_unary), (model.pair, squares[1], g_pair)):
            square += g * g
            value += rate * g / np.sqrt(square)
    return model


# Labelled pages: the element named labelled-main is the main part, without boilerplate in it.
LABELLED = [
    """<html><body><div id="top"><div class="logo">Daily Paper</div><ul class="menu"><li><a href="/">Home</a></li><li><a href="/w">World</a></li></ul></div>
    <div class="sidebar"><h3>Most read</h3><ul><li><a href="/1">One story about rain</a></li><li><a href="/2">Another story</a></li></ul></div>
    <div id="labelled-main" class="content"><h1>Rain falls on the town</h1><p>It rained all day, and the river rose by a metre.</p><p>Short.</p><ul><li>First point, in words</li><li>Second</li></ul><blockquote>We saw it come, said a man.</blockquote></div>
    <div class="comments"><h2>Comments</h2><div class="comment"><p>I was there too, and it was wet.</p></div><div class="comment"><p>Thanks for the report!</p></div></div>
    <div id="footer"><p>Copyright the Daily Paper. All rights reserved.</p></div></body></html>""",
    """<html><body><header><h1>My site</h1><nav><a href="/a">A</a> <a href="/b">B</a></nav></header><div class="cookie-notice"><p>We use cookies. Do you agree?</p><button>Yes</button></div>
    <main data-main="labelled-main"><header><h1>How to bake bread</h1></header><p>Take flour, water and salt.</p><section><h2>Steps</h2><p>Mix. Wait. Bake for an hour.</p><pre>220 degrees</pre><table><tr><td>Flour</td><td>500 g</td></tr></table></section>
    <aside><p>Buy our pans, they are cheap and good.</p></aside><form><p>Your mail address, please:</p><input name="m"></form></main>
    <section class="comments"><h3>What readers say</h3><p>My bread was fine. I liked it, and so did they.</p></section><footer><p>Made with care. Contact us.</p></footer></body></html>""",
    """<html><body><nav><ul><li><a href="/x">X</a></li></ul></nav><div class="ad"><p>Buy now, while it lasts! A very good offer, today only.</p></div>
    <article class="labelled-main"><h1>Title</h1><p>Word.</p><div><p>The text goes on here, in a plain division.</p></div><div class="share"><a href="/s">Share</a></div><p>End of it.</p><section class="comments"><p>First! A reader wrote this, with joy.</p></section></article>
    <aside class="related"><h3>Related</h3><p><a href="/r">A related story about bread</a></p></aside><footer>&copy; Site</footer></body></html>""",
    """<html><body><table><tr><td class="nav"><a href="/h">Home</a></td><td><div class="post labelled-main"><h2>A note</h2><p>Some notes, written by hand, on one page.</p><p>More of them.</p></div></td></tr></table><div class="newsletter"><p>Get our letter each week. Sign up.</p></div></body></html>""",
    """<html><body><header><p>The town's own paper, since 1901.</p></header><article class="labelled-main"><header><h1>News</h1><p>By a writer, on Monday.</p></header><p>It is new, they say.</p></article><footer><p>The end.</p></footer></body></html>""",
    """<body><header class="site"><h1>A blog</h1><p>Words on things, every day</p></header><div class="post labelled-main"><h2>Things</h2><p>They are many.</p></div></body>""",
    """<article class="labelled-main"><h1>Alone</h1><p>Nothing stands around this text, which is all there is.</p><p>Two.</p></article>""",
    """<html><body><main class="labelled-main"><p>Only a main part, and a long one at that; it goes on and on.</p></main></body></html>""",
    """<p class="labelled-main">A paragraph without a page.</p><p class="labelled-main">And a second one, of more words.</p>""",
    """<html><body class="labelled-main">Bare text in the body, without any marks.<p>A paragraph too.</p></body></html>""",
]


def _example(page: Page, weight: float):
    y = page.labels()
    page.names = [n.replace("labelled-main", "").strip() for n in page.names]  # a mark is no feature
    return None if y is None else (np.array(page.parents), page.kinds(), page.features(), y, weight)


def train(pages: DataFrame, page_id: str = "page_id", markup: str = "html", sample: int = SAMPLE, seed: int = 5) -> Model:
    """Weights from the labelled pages and about ``sample`` pages, drawn by hash, that mark their main part."""
    total = pages.count()
    drawn = pages.where(hashed_fraction(seed, page_id) < min(1.0, sample / max(1, total))).select(F.col(markup).alias("html"))

    def make():
        def work(batch):
            out = {"parents": [], "kinds": [], "x": [], "y": []}
            for s in batch.column(0).to_pylist():
                if made := _example(Page(s or ""), 1.0):
                    for name, value in zip(out, made, strict=False):
                        out[name].append(value.ravel())
            return out
        return work

    got = scan(drawn, ["html"], make, "parents array<int>, kinds array<int>, x array<double>, y array<int>").collect()
    trees = sorted(((r.parents, r.kinds, r.x, r.y) for r in got), key=repr)
    trees = [(np.array(p), np.array(k), np.array(x).reshape(len(p), FEATURES), np.array(y), 1.0) for p, k, x, y in trees]
    by_hand = [_example(Page(s), max(1.0, len(trees) / len(LABELLED))) for s in LABELLED]
    return fit(trees + by_hand)


def page_texts(pages: DataFrame, model: Model, page_id: str = "page_id", markup: str = "html", url: str = "url") -> DataFrame:
    """Per page: page_id, url, text, n_chars."""

    def make():
        def work(batch):
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                texts = model.texts(part.column(2).to_pylist())
                yield {page_id: part.column(0), url: part.column(1), "text": texts, "n_chars": [len(t) for t in texts]}
        return work

    return scan(pages, [as_id(page_id), F.col(url).cast("string").alias(url), markup], make, f"{page_id} long, {url} string, text string, n_chars long")


def extract(pages: DataFrame, page_id: str = "page_id", markup: str = "html", url: str = "url") -> DataFrame:
    """The main text of every page, by a model trained on these pages' own marks."""
    return page_texts(pages, train(pages, page_id, markup), page_id, markup, url)
