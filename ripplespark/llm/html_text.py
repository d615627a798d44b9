"""Main text of web pages by a tree-structured graphical model over DOM nodes.

Every element of a page is a node that is content or not.  A node has potentials from its
tag, the words in its class, id and role, its text and its links; every edge from parent
to child has a potential for each pair of labels, one table for inline and one for block
children.  As the graph is a tree, sum-product messages passed once upward and once
downward give exact marginals; nodes of many pages pass their messages together, level by
level.  Text counts where its element's marginal is a half or more; of pages without such
text the likeliest counts, unless it stands aside (menus, footers and the like).

The potentials maximise the likelihood of labelled pages.  No corpus of labels is at hand,
so ``labelled_pages`` writes pages from a set of layouts and knows the label of each node;
``TRAIN_PAGES`` bounds them.  The model is small and its size doesn't depend on the pages.

Scripts, styles, templates, comments and the head are never text.  A block's white space
becomes single spaces; blocks are joined by line breaks.  Null, empty or wordless pages
give an empty text.  Unclosed and cut-off tags are put up with; nothing is cut short.
Repeated rows give repeated results; other columns of the pages play no part.
"""

from __future__ import annotations

import html
import random
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat, tables

TRAIN_PAGES = 600
STEPS = 200
#: Elements nested deeper are no nodes; their text is that of the deepest node around it, as in browsers.
DEPTH = 512

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|template|textarea|iframe)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<node>noscript|svg|select|object)\b[^>]*>(?:(?!<(?P=node)\b).)*?</(?P=node)\s*>"
    r"|<head\b[^>]*>(?:(?!<(?:head|body)\b).)*?</head\s*>"
    r"""|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:"[^"]*+"|'[^']*+'|[^'">])*+)>"""
    r"|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|style)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile("[a-z]+")
#: A tag that closes itself; the slash behind a value without quotes is part of the value.
_CLOSED = re.compile(r"""(?<![^\s"'/])/\Z|(?:\A|[\s"'/])[^\s"'/=]+/\Z""")
#: Never text; where the end tag is missing, the head ends at the first element or text of the body, the others at a block.
_NEVER = frozenset("head noscript svg select object".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr img br".split())
_TAGS = (
    "html body div p article main section aside nav header footer h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tr td th form button fieldset "
    "label blockquote pre figure figcaption details summary address center a b strong i em span code small img br hr other"
).split()
_TAG = {t: k for k, t in enumerate(_TAGS)}
#: Parts of class, id and role names, in groups that mean the same.
_NAMES = [
    "article post entry story", "content main body text prose", "nav navigation menu navbar breadcrumb breadcrumbs tabs", "header masthead top banner topbar",
    "footer bottom colophon copyright legal", "sidebar aside rail widget complementary", "ad ads advert advertisement adsense sponsor sponsored promo promotion",
    "cookie cookies consent gdpr notice alert warning popup modal overlay dialog", "comment comments reply replies respond discussion disqus feedback", "share social follow like",
    "related recommended more popular trending also", "newsletter subscribe signup login search form", "meta byline author date tags tag category", "pagination pager next prev page",
]
_NAME = {w: k for k, group in enumerate(_NAMES) for w in group.split()}
_CLOSES_P = frozenset("address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table ul".split())
_SIBLING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": (), "tbody": ("thead", "tbody", "tr", "td", "th")}
_STOPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "option": ()}


_BLOCKS = _CLOSES_P | frozenset("body li dt dd thead tbody tr td th caption".split())


class Page(NamedTuple):
    """Nodes of a page in page order, and its texts as (node, block number, text)."""

    parent: list[int]
    tag: list[int]
    names: list[int]  # bits of the groups in ``_NAMES``; the next bit: hidden
    inline: list[bool]
    texts: list[tuple[int, int, str]]


def parse(page: str) -> Page:
    """The page's tree; texts of one block number belong together."""
    parent, tag, names, inline, texts = [-1], [_TAG["html"]], [0], [False], []
    stack: list[tuple[str, int]] = [("html", 0)]
    block, at, never = 0, 0, 0  # never: place in the stack of an open element that is never text

    def text(piece: str) -> None:
        if never and (stack[-1][0] != "head" or piece.isspace()):
            return
        if never:
            close_to(never)
        if piece and not piece.isspace():
            texts.append((stack[-1][1], block, html.unescape(piece)))
        elif piece and texts and texts[-1][1] == block:
            texts.append((stack[-1][1], block, " "))

    def close_to(depth: int) -> None:
        nonlocal block, never
        never = never if never < depth else 0
        if any(t not in _INLINE for t, _ in stack[depth:]):
            block += 1
        del stack[depth:]

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        name = m["tag"]
        if name is None:
            continue
        name = name.lower()
        if m["close"]:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name), 0)
            if depth:
                close_to(depth)
            elif name in ("p", "br"):
                block += name == "p"
            continue
        if never:
            if name in _BLOCKS or stack[never][0] == "head" and (name in _INLINE or name in _TAG) and name != "html":
                close_to(never)
            else:
                if name == "title":
                    stack.append((name, stack[-1][1]))
                continue
        elif name in _NEVER:
            if name != "svg" or not _CLOSED.search(m["attrs"]):  # only foreign elements close themselves
                never = len(stack)
                stack.append((name, stack[-1][1]))
            continue
        if name in ("html", "body") and len(stack) > 1 and any(t == name for t, _ in stack):
            continue
        if name == "html":
            continue
        if name in _CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    close_to(k)
                    break
                if stack[k][0] not in _INLINE:
                    break
        if name in _SIBLING:
            depth = 0
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in _STOPS.get(name, ()):
                    break
                if stack[k][0] in _SIBLING[name]:
                    depth = k
            if depth:
                close_to(depth)
        if name in _VOID:
            if name == "br" and texts and texts[-1][1] == block:
                texts.append((stack[-1][1], block, " "))
            elif name not in _INLINE:
                block += 1
            continue
        bits = 0
        if m["attrs"]:
            for a in _ATTRIBUTE.finditer(m["attrs"]):
                value = (a[2] or a[3] or a[4] or "").lower()
                if a[1].lower() == "style":
                    bits |= ("display:none" in value.replace(" ", "")) << len(_NAMES)
                else:
                    for part in _PART.findall(value):
                        if part in _NAME:
                            bits |= 1 << _NAME[part]
            if " hidden" in m["attrs"].lower():
                bits |= 1 << len(_NAMES)
        if len(stack) > DEPTH:
            block += name not in _INLINE
            continue
        parent.append(stack[-1][1])
        tag.append(_TAG.get(name, _TAG["other"]))
        names.append(bits)
        inline.append(name in _INLINE)
        if name not in _INLINE:
            block += 1
        stack.append((name, len(parent) - 1))
    if at < len(page):
        text(page[at:])
    return Page(parent, tag, names, inline, texts)


class Forest(NamedTuple):
    """Nodes of many pages: parents (-1 for roots), depths, inline or not, and features."""

    parent: np.ndarray
    depth: np.ndarray
    inline: np.ndarray
    features: np.ndarray
    aside: np.ndarray = np.zeros(0, bool)  # whether a tag or name of its own or above says that it is no article


_SIZES = np.array([1, 25, 80, 200, 600])
_N_FEATURES = 1 + len(_TAGS) + len(_NAMES) + 1 + (len(_SIZES) + 1) + 4 + 4 + 3 + 6
#: Tags and groups of names whose text is left out when a node's share of the page's likely text is worked out.
_ASIDE_TAGS = [_TAG[t] for t in "nav header footer aside form button".split()]
_ASIDE_NAMES = sum(1 << k for k in (2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 13, len(_NAMES)))


def forest(pages: list[Page]) -> Forest:
    first = np.cumsum([0] + [len(p.parent) for p in pages])
    n = int(first[-1])
    parent = np.concatenate([np.array(p.parent) + np.where(np.array(p.parent) >= 0, a, 0) for p, a in zip(pages, first, strict=False)])
    tag, bits, inline = (np.concatenate([np.array(x, t) for x in xs]) for xs, t in (([p.tag for p in pages], np.int64), ([p.names for p in pages], np.int64), ([p.inline for p in pages], bool)))
    own, ends = np.zeros(n), np.zeros(n)
    for p, a in zip(pages, first.tolist(), strict=False):
        for node, _, text in p.texts:
            size = len(text.strip())
            own[a + node] += size
            ends[a + node] += text.count(".") + text.count("!") + text.count("?") + text.count(",") if size else 0
    depth = np.zeros(n, np.int64)
    aside = np.isin(tag, _ASIDE_TAGS) | (bits & _ASIDE_NAMES > 0)
    for k in range(n):  # parents come first
        if parent[k] >= 0:
            depth[k] = depth[parent[k]] + 1
            aside[k] |= aside[parent[k]]
    all_text, stops, links, likely = own.copy(), ends.copy(), np.where(tag == _TAG["a"], own, 0.0), np.where(aside, 0.0, own)
    kids = np.bincount(parent[parent >= 0], minlength=n)
    for d in range(int(depth.max()), 0, -1):
        at = np.flatnonzero(depth == d)
        for sums in (all_text, stops, links, likely):
            np.add.at(sums, parent[at], np.where(tag[at] == _TAG["a"], all_text[at], sums[at]) if sums is links else sums[at])
    root = np.repeat(first[:-1], np.diff(first))
    share = all_text / np.maximum(1, all_text[root])
    density = links / np.maximum(1, all_text)
    prose = stops / np.maximum(1, all_text)
    x = np.zeros((n, _N_FEATURES), np.float32)
    x[:, 0] = 1
    x[np.arange(n), 1 + tag] = 1
    c = 1 + len(_TAGS)
    for k in range(len(_NAMES) + 1):
        x[:, c + k] = bits >> k & 1
    c += len(_NAMES) + 1
    x[np.arange(n), c + np.searchsorted(_SIZES, own, "right")] = 1
    c += len(_SIZES) + 1
    x[np.arange(n), c + np.searchsorted([0.1, 0.4, 0.8], density, "right")] = all_text > 0
    c += 4
    x[np.arange(n), c + np.searchsorted([0.02, 0.2, 0.6], share, "right")] = 1
    c += 4
    x[:, c + 3] = aside
    likely /= np.maximum(1, likely[root])
    x[np.arange(n), c + 4 + np.searchsorted([1e-9, 0.05, 0.3, 0.7], likely, "right")] = 1
    x[:, c], x[:, c + 1], x[:, c + 2] = (prose > 0.005) & (all_text > 25), kids > 3, all_text == 0
    return Forest(parent, depth, inline, x, aside)


class Model(NamedTuple):
    """Log odds of content by feature; edges[inline][parent's label][child's label]."""

    weights: np.ndarray
    edges: np.ndarray


def marginals(trees: Forest, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """For each node the probability of content, and of each pair of its parent's label and its own (sum-product)."""
    n = len(trees.parent)
    node = np.zeros((n, 2))
    node[:, 1] = trees.features @ model.weights
    edge = model.edges[trees.inline.astype(int)]
    up = np.zeros((n, 2))  # message to the parent
    belief = node.copy()
    levels = [np.flatnonzero(trees.depth == d) for d in range(int(trees.depth.max()) + 1)] if n else []
    for at in reversed(levels[1:]):
        up[at] = np.logaddexp(*(edge[at][:, :, y] + belief[at][:, y : y + 1] for y in (0, 1)))
        np.add.at(belief, trees.parent[at], up[at])
    down = np.zeros((n, 2))
    pair = np.zeros((n, 2, 2))
    for at in levels[1:]:
        above = belief[trees.parent[at]] + down[trees.parent[at]] - up[at]
        joint = above[:, :, None] + edge[at] + belief[at][:, None, :]
        down[at] = np.logaddexp(*(above[:, y : y + 1] + edge[at][:, y, :] for y in (0, 1)))
        joint -= joint.max((1, 2), keepdims=True)
        joint = np.exp(joint)
        pair[at] = joint / joint.sum((1, 2), keepdims=True)
    total = belief + down
    return 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -50, 50))), pair


def train(pages: list[Page], labels: list[np.ndarray], steps: int = STEPS, decay: float = 2e-4) -> Model:
    """Maximum likelihood: what the labels show less what the model expects is the gradient."""
    trees, y = forest(pages), np.concatenate(labels).astype(float)
    child = np.flatnonzero(trees.parent >= 0)
    kind = trees.inline[child].astype(int)
    shown = np.zeros((2, 2, 2))
    np.add.at(shown, (kind, y[trees.parent[child]].astype(int), y[child].astype(int)), 1)
    theta = np.zeros(_N_FEATURES + 8)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        p, pair = marginals(trees, Model(theta[:_N_FEATURES], theta[_N_FEATURES:].reshape(2, 2, 2)))
        expected = np.stack([pair[child][kind == k].sum(0) for k in (0, 1)])
        gradient = np.r_[trees.features.T @ (y - p), (shown - expected).ravel()] / len(pages) - decay * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return Model(theta[:_N_FEATURES].astype(np.float32), theta[_N_FEATURES:].reshape(2, 2, 2))


def extract(pages: list[Page], model: Model) -> list[str]:
    """The main text of each page.

    A page none of whose texts reaches a half, such as a bare paragraph, gives the texts of
    at least half the page's greatest marginal, without those that a tag or name sets aside.
    """
    if not pages:
        return []
    trees = forest(pages)
    p = marginals(trees, model)[0]
    out, a = [], 0
    for page in pages:
        held = np.unique(np.fromiter((a + node for node, _, text in page.texts if text != " "), np.int64))
        least = 0.5
        if len(held) and p[held].max() < least:
            held = held[~trees.aside[held]]
            least = p[held].max() / 2 if len(held) else 2.0
        blocks: dict[int, list[str]] = {}
        for node, block, text in page.texts:
            if p[a + node] >= least and (least == 0.5 or not trees.aside[a + node]):
                blocks.setdefault(block, []).append(text)
        lines = (" ".join("".join(parts).split()) for parts in blocks.values())
        out.append("\n".join(x for x in lines if x))
        a += len(page.parent)
    return out


# labelled pages ----------------------------------------------------------------------


def _words(rng: random.Random, low: int, high: int) -> str:
    made = ["".join(rng.choice(("ta", "ne", "ro", "mi", "su", "el", "an", "ó", "ü", "is", "qu", "ber")) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(low, high))]
    for k in range(len(made)):
        if rng.random() < 0.12:
            made[k] += rng.choice([",", ".", ".", "!", "?"])
    return " ".join(made).capitalize() + rng.choice([".", ".", ".", ""])


class _Layout:
    """Writes a page; what is written inside ``True`` is marked by an attribute that training reads and removes."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def tag(self, name: str, inner: str, label: bool, attrs: str = "", close: bool = True) -> str:
        return f"<{name}{' ' + attrs if attrs else ''} data-y={int(label)}>{inner}{f'</{name}>' if close else ''}"

    def inline(self, text: str, label: bool) -> str:
        r, words = self.r, text.split(" ")
        if len(words) > 6 and r.random() < 0.5:
            a = r.randrange(len(words) - 3)
            name = r.choice(["a", "b", "em", "strong", "span", "i", "code"])
            words[a : a + 3] = [self.tag(name, " ".join(words[a : a + 3]), label, 'href="/x"' if name == "a" else "")]
        return " ".join(words)

    def paragraph(self, label: bool) -> str:
        r = self.r
        text = self.inline(_words(r, 1, r.choice([4, 15, 60, 150] if r.random() < 0.97 else [1500])), label)
        kind = r.random()
        if kind < 0.25:
            return self.tag("p", self.tag("b", text, label, close=False) + "<br>", label, close=False)
        return self.tag("p", text, label, close=r.random() < 0.85)

    def article_part(self) -> str:
        r, kind = self.r, self.r.random()
        if kind < 0.7:
            return self.paragraph(True)
        if kind < 0.78:
            return self.tag(r.choice(["h2", "h3"]), _words(r, 2, 7), True)
        if kind < 0.84:
            return self.tag(r.choice(["ul", "ol"]), "".join(self.tag("li", self.inline(_words(r, 2, 25), True), True, close=r.random() < 0.8) for _ in range(r.randint(2, 5))), True)
        if kind < 0.88:
            return self.tag("blockquote", self.paragraph(True), True)
        if kind < 0.91:
            return self.tag("table", "".join(self.tag("tr", "".join(self.tag("td", _words(r, 1, 4), True) for _ in range(3)), True) for _ in range(3)), True)
        if kind < 0.93:
            return self.tag("pre", _words(r, 5, 30), True)
        if kind < 0.96:
            return self.tag("figure", "<img src=x>" + self.tag("figcaption", _words(r, 3, 12), True), True)
        return self.tag("div", _words(r, 10, 60), True)

    def links(self, label: bool = False) -> str:
        r = self.r
        return self.tag("ul", "".join(self.tag("li", self.tag("a", _words(r, 1, 3), label, 'href="/y"'), label) for _ in range(r.randint(3, 9))), label)

    def clutter(self, where: str) -> str:
        r = self.r
        named = lambda *names: f'{r.choice(["class", "id", "class"])}="{r.choice(names)}"'
        prose = "".join(self.paragraph(False) if r.random() < 0.6 else _words(r, 3, 40) for _ in range(r.randint(1, 3)))
        kinds = {
            "nav": [self.tag("nav", self.links(), False), self.tag("div", self.links(), False, named("menu", "main-nav", "breadcrumbs", "navbar"))],
            "header": [self.tag("header", self.tag("div", _words(r, 1, 6), False) + self.links(), False), self.tag("div", _words(r, 1, 8), False, named("header", "masthead", "site-header")), self.tag("header", self.tag("h1", _words(r, 1, 4), False) + _words(r, 2, 8), False)],
            "ad": [self.tag("div", _words(r, 3, 40), False, named("ad", "ads", "advert", "banner-ad", "sponsored", "promo", "ad-slot")), self.tag("aside", prose, False, named("promo", "sponsored")), self.tag("div", self.paragraph(False), False, named("advertisement", "ad box"))],
            "notice": [self.tag("div", _words(r, 5, 40) + self.tag("button", _words(r, 1, 2), False), False, named("cookie-notice", "consent", "notice", "alert", "popup")), self.tag("div", self.paragraph(False), False, named("notice", "cookies", "warning"))],
            "side": [self.tag("aside", self.tag("h3", _words(r, 1, 4), False) + prose, False), self.tag("div", prose + self.links(), False, named("sidebar", "widget", "right-rail")), self.tag("div", self.tag("h3", _words(r, 1, 4), False) + self.links(), False, named("related", "recommended", "popular"))],
            "form": [self.tag("form", self.tag("label", _words(r, 1, 4), False) + "<input type=text>" + self.tag("button", _words(r, 1, 2), False), False), self.tag("form", self.tag("p", _words(r, 4, 20), False) + "<input>", False, named("newsletter", "search", "signup"))],
            "comments": [self.tag(r.choice(["section", "div"]), self.tag("h3", _words(r, 1, 3), False) + "".join(self.tag(r.choice(["div", "article", "li"]), self.tag("span", _words(r, 1, 2), False) + self.paragraph(False), False, 'class="comment"' if r.random() < 0.7 else "") for _ in range(r.randint(1, 5))), False, named("comments", "discussion", "replies", "comment-list"))],
            "share": [self.tag("div", self.links(), False, named("share", "social"))],
            "footer": [self.tag("footer", "&copy; " + _words(r, 1, 12), False), self.tag("footer", self.links() + self.tag("p", _words(r, 3, 30), False), False), self.tag("div", _words(r, 3, 30) + self.links(), False, named("footer", "site-footer", "legal"))],
        }
        return r.choice(kinds[where])

    def page(self) -> str:
        r = self.r
        some = lambda p, kind: self.clutter(kind) if r.random() < p else ""
        parts = [self.tag("h1", _words(r, 2, 9), True)] if r.random() < 0.85 else []
        bare = r.random() < 0.15  # a short text, with little around it
        for _ in range(r.randint(1, 2) if bare else r.randint(1, 12)):
            parts.append(self.paragraph(True) if bare else self.article_part())
            if r.random() < 0.06:
                parts.append(self.clutter(r.choice(["ad", "notice", "share", "form", "side"])))
        inner = "".join(parts)
        shape = r.random()
        if shape < 0.5:
            body = self.tag("article", inner, True)
        elif shape < 0.62:
            body = self.tag("main", inner, True)
        elif shape < 0.72:
            body = self.tag("main", self.tag("article", inner, True), True)
        elif shape < 0.9:
            body = self.tag(r.choice(["div", "section"]), inner, True, f'{r.choice(["class", "id"])}="{r.choice(["content", "post", "entry-content", "article-body", "story", "main-content", "post-text"])}"')
        elif shape < 0.95:
            body = self.tag(r.choice(["div", "div", "section", "td"]), inner, True)
        else:  # straight in the body
            body = inner
        own = shape > 0.98  # text of the body's own
        if own:
            body = self.inline(_words(r, 2, r.choice([15, 150])), True) + r.choice(["", "<br>", "<hr>"]) + body * (r.random() < 0.5)
        some = (lambda p, kind: self.clutter(kind) if r.random() < p / 4 else "") if bare else some
        body += some(0.35, "comments") + some(0.1, "share") + some(0.15, "side")
        if r.random() < 0.3 and not own:
            body = self.tag("div", some(0.3, "side") + body + some(0.4, "side"), False, r.choice(["", 'class="wrapper"', 'id="page"']))
        before = [some(0.4, "header"), some(0.7, "nav"), some(0.45, "ad"), some(0.25, "notice"), some(0.15, "form")]
        after = [some(0.2, "ad"), some(0.2, "form"), some(0.15, "notice"), some(0.8, "footer")]
        r.shuffle(before)
        text = "<!DOCTYPE html><html><head><title>x</title></head>" + self.tag("body", "".join(before) + body + "".join(after), own) + "</html>"
        return text[: r.randint(len(text) // 2, len(text))] if r.random() < 0.1 else text


def labelled_pages(n: int = TRAIN_PAGES, seed: int = 5) -> tuple[list[Page], list[np.ndarray]]:
    """Pages of varied layouts, and for each the labels of its nodes."""
    pages, labels = [], []
    for k in range(n):
        marked = _Layout(1000 * seed + k).page()
        y = [int(x) for x in re.findall(r"<[a-z0-9]+[^<>]*? data-y=([01])>", marked)]
        page = parse(re.sub(r" data-y=[01]>", ">", marked))
        if len(page.parent) == len(y) + 1:  # the root has no mark; void elements are no nodes
            pages.append(page)
            labels.append(np.array([0, *y]))
    return pages, labels


_trained: dict[int, Model] = {}


def trained(n: int = TRAIN_PAGES) -> Model:
    """The model of so many labelled pages; fitted once in a driver, in some seconds."""
    if n not in _trained:
        _trained[n] = train(*labelled_pages(n))
    return _trained[n]


def main_text(df: DataFrame, id_col: str = "page_id", html_col: str = "html", *more: str, model: Model | None = None) -> DataFrame:
    """Rows (id, the columns of ``more``, text, n_chars)."""
    shared = df.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches):
        for batch in batches:
            _, offsets = flat.views(batch.column(1))
            for a, b in flat.blocks(offsets):
                texts = extract([parse(p) for p in batch.column(1).slice(a, b - a).to_pylist()], shared.value)
                own = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([own.column(0), *own.columns[2:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names)

    src = tables.texts(df, id_col, html_col, *(F.col(c).alias(c) for c in more))
    names = ["id", *more, "text", "n_chars"]
    kinds = [src.schema["id"].dataType.simpleString(), *(src.schema[c].dataType.simpleString() for c in more), "string", "long"]
    return src.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))).withColumnRenamed("id", id_col)
