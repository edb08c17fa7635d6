"""Main-text extraction from HTML by minimum-cut labelling of text blocks.

A page is read into blocks of text with their place in the tree. A block's cost has two parts: what the tags around it say, and
a linear classifier of its own text, links and tag and of the names of the elements around it. The classifier is fitted on blocks of
a sample of the pages whose tags leave no doubt (``article`` against ``nav``, ``footer`` and the like); names are features
among others, so that text and neighbours can outweigh them. A form speaks against its text only if that is mostly labels and fields. The sum is
a terminal capacity (to the source if it speaks for content, to the sink if against). Blocks next to each other, and next
of the same parent, are joined by smoothness edges that weaken with their distance in the tree. The cheapest labelling is a
minimum cut, that is, one that a maximum flow fills; the source's side is content.

Edges between blocks of one parent lie inside each other or apart, as elements do, so the network reduces block by block
to a single edge with a cost for each labelling of its ends: the cut takes time in proportion to the blocks, where flow along
augmenting paths takes the square of their number.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixmine.llm.store import bound, columns_for

#: Pages that the classifier is fitted on at most, the first by a hash of page_id and url, and blocks of each that it sees at most.
FIT_PAGES, FIT_BLOCKS = 2000, 64

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>]+)))?")
_INVISIBLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
_HINTS = ("class", "id", "role", "aria-label")
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "button", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"} | {"math", "mfrac", "mi", "mn", "mo", "mover", "mroot", "mrow", "ms", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtext", "munder", "semantics"}
_HIDDEN = {"head", "script", "style", "noscript", "template", "svg", "select", "option", "textarea", "object", "canvas", "iframe", "audio", "video", "datalist", "dialog", "title", "xmp", "noembed", "noframes"}
#: How far a tag speaks for (or against) the blocks in it; the strongest against counts, else the strongest for.
_TAG_SCORE = {"nav": -9, "footer": -9, "aside": -9, "menu": -9, "article": 4, "main": 3, "header": -5, "fieldset": -9}
#: A form's score if it holds fewer words of text than so many for each field, and these besides.
_FORM, _FIELD_WORDS, _FORM_WORDS = -9, 15, 10
_FIELDS = {"input", "select", "textarea", "button", "label"}
#: Words of names that speak against an element, by how strongly.
_ADS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promoted", "promotion"}
_READERS = {"comment", "comments", "disqus", "reply", "replies", "respond"}
_ASIDE = {
    "cookie", "cookies", "consent", "gdpr", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related", "recommended", "recommendations", "widget", "hidden",
}
_LAYOUT_WORDS = {
    "banner", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "sidebar", "aside", "footer", "foot", "header", "masthead", "topbar", "notice", "alert", "register", "search", "toolbar", "pagination", "pager", "copyright", "legal",
    "disclaimer", "contentinfo", "complementary", "form",
}
_AGAINST = {**dict.fromkeys(_ADS | _READERS, 7), **dict.fromkeys(_ASIDE, 5), **dict.fromkeys(_LAYOUT_WORDS, 3)}
#: Elements that group others; inside an article only their classes and roles count.
_GROUPS = {"div", "section", "ul", "ol", "dl", "nav", "aside", "span", "details", "iframe", "header", "footer", "form"}
#: What stands before a word of ``_AGAINST`` that only names a part of the layout, and what a layout's wrapper is called.
_EXCUSE = {"has", "with", "no", "without", "is"}
_LAYOUT = {"wrap", "wrapper", "layout", "container", "grid", "row", "columns", "page", "site"}
#: Words against whose elements hold articles of their own, which are not the page's.
_OTHERS = _ADS | _READERS | _ASIDE - {"cookie", "cookies", "consent", "gdpr", "overlay", "subscribe", "subscription", "signup", "login", "share", "sharing", "social"}
_FOR = {"article": 3, "content": 2, "main": 3, "post": 2, "entry": 2, "body": 1, "story": 2, "text": 1}
#: Smoothness between neighbours at no distance, and how it falls with each step in the tree.
_SMOOTH, _FALL = 1.5, 0.5


class _Node:
    __slots__ = ("against", "body", "depth", "fields", "firm", "form", "hidden", "in_article", "in_aside", "in_label", "mixed", "others", "parent", "pro", "tag", "weak", "words")

    def __init__(self, tag: str, attributes: str, parent: _Node | None):
        self.tag, self.parent, self.depth = tag, parent, parent.depth + 1 if parent else 0
        self.in_article = bool(parent and (parent.in_article or parent.tag == "article"))
        self.in_aside = bool(parent and (parent.in_aside or parent.tag in ("nav", "aside", "footer", "menu")))
        self.in_label = tag in ("label", "legend", "button") or bool(parent and parent.in_label)
        self.mixed = False  # whether blocks of other elements are directly below
        self.words = self.fields = 0  # of a form
        self.hidden = tag in _HIDDEN or bool(parent and parent.hidden) or (tag == "button" and not self.in_article)
        self.others = bool(parent and parent.others)
        self.body = bool(parent and parent.body)  # inside something named after content
        self.form = self if tag == "form" else parent.form if parent else None
        # what tags and roles say against, what names say for, and against: the two strongest, strong and weak
        self.firm, self.pro = (parent.firm, parent.pro) if parent else (0, 0)
        self.against, self.weak = (parent.against, parent.weak) if parent else ((), ())
        fresh = parent is not None and (tag == "main" or (tag == "article" and not parent.others))
        if fresh:  # the page's own text begins anew
            self.against, self.weak, self.others = (), (), False
            if not self.in_aside:
                self.form = None  # a form around the whole page
        own = _TAG_SCORE.get(tag, 0)
        if own > 0:
            self.pro = max(self.pro, own) if fresh or not self.others else self.pro
        elif not (tag == "header" and (self.in_article or self.body)):  # an article's own heading
            self.firm = min(self.firm, own)
        if attributes:
            self._read(tag, _attributes(attributes))

    def _read(self, tag: str, named: dict[str, str]) -> None:
        if "hidden" in named or named.get("aria-hidden", "").strip().lower() == "true" or _INVISIBLE.search(named.get("style", "")):
            self.hidden = self.hidden or tag not in ("html", "body", "article", "main")
        if tag in ("html", "body"):
            return
        if tag in ("div", "section") and _hinted(named.get("role", "").split())[1]:
            self.firm = min(self.firm, -9)
        names = ("class", "role", "aria-label") if self.in_article else _HINTS
        tokens = [t for name, value in named.items() if name in names for t in value.split()]
        if tag not in _GROUPS and (self.in_article or tag in _HEADINGS):
            tokens = [t for t in tokens if t in _ADS] if tag not in _HEADINGS else []
        if tag == "form":
            tokens = [t for t in tokens if _words(t)[-1:] != ["form"]]
        best, bad = _hinted(tokens, own_heading=self.in_article or self.body)
        self.others |= any(_OTHERS.intersection(_words(t)) for t in tokens) and bad > 0
        if bad > 3:
            self.against = tuple(sorted((*self.against, bad))[-2:])
        elif bad:
            self.weak = tuple(sorted((*self.weak, bad))[-2:])
        if best and not self.others:
            self.pro, self.body = max(self.pro, best), True

    @property
    def tags(self) -> int:
        """What the tags say, with the form that the block is in."""
        form = _FORM if self.form and self.form.words < _FIELD_WORDS * self.form.fields + _FORM_WORDS else 0
        worst = min(self.firm, form)
        return worst if worst < 0 else self.pro


def _attributes(text: str) -> dict[str, str]:
    """Values by lower-case name, empty for a name alone; the first of a repeated name counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def _words(token: str) -> list[str]:
    """The words of a name, up to one after which only a part of the layout is named."""
    return list(takewhile(lambda w: w not in _EXCUSE, (w.lower() for w in _WORD.findall(token))))


def _hinted(tokens: list[str], own_heading: bool = False) -> tuple[int, int]:
    """How far names speak for an element and against it; names that contradict each other say nothing."""
    against = best = 0
    for token in tokens:
        words = _words(token)
        if "hidden" in words and (":" in token or words[0] in ("overflow", "backface") or words[0] == "hidden" != words[-1]):
            continue  # hides an overflow, or only on some screens
        if "sidebar" in words and _LAYOUT.intersection(words) and any(w in _FOR for w in words) and not _OTHERS.intersection(words):
            continue  # around both a page's text and its sidebar
        if "header" in words and (own_heading or set(words) & {"article", "post", "entry", "story"}):
            continue
        bad = max((_AGAINST.get(w, 0) for w in words), default=0)
        if bad:
            against = max(against, bad)
        else:
            best = max([best, *(_FOR.get(w, 0) for w in words)])
    return (0, 0) if against and best else (best, against)


def blocks_of(page: str) -> list[tuple[str, int, _Node]]:
    """(text, characters of links, element) of each block with text, in page order."""
    root = _Node("#root", "", None)
    node, at, n = root, 0, len(page)
    out: list[tuple[str, int, _Node]] = []
    parts: list[str] = []
    links, in_link, home, begun = 0, 0, root, False
    open_tags: Counter[str] = Counter()  # of the elements that the reader is in

    def up() -> None:
        nonlocal node
        open_tags[node.tag] -= 1
        node = node.parent

    def flush() -> None:
        nonlocal links, begun
        text = " ".join("".join(parts).split())
        if text:
            out.append((text, links, home))
        parts.clear()
        links, begun = 0, False

    def add(raw: str) -> None:
        nonlocal links, home, begun
        if raw and not node.hidden:
            text = html.unescape(raw) if "&" in raw else raw
            if not begun and text.strip():
                begun, home = True, node
                while home.tag in _INLINE and home.parent:
                    home = home.parent
            parts.append(text)
            if node.form and not node.in_label:
                node.form.words += len(text.split())
            if in_link:
                links += len(text.strip())

    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in _INLINE:
                if tag == "a":
                    in_link = 0
                scan = node
                while open_tags[tag] and scan.parent and scan.tag in _INLINE and scan.tag != tag:
                    scan = scan.parent
                if scan.tag == tag and scan.parent:
                    while node is not scan:
                        up()
                    up()
                continue
            flush()
            if open_tags[tag]:
                while node.tag != tag:
                    up()
                up()
                in_link = 0
            continue
        if tag in _FIELDS and node.form and not (tag == "input" and _attributes(m[3]).get("type", "").lower() == "hidden"):
            node.form.fields += 1
        if tag in _VOID:
            if tag in ("br", "wbr"):
                parts.append(" " if tag == "br" else "")
            elif tag == "hr":
                flush()
            continue
        if tag not in _INLINE:
            flush()
            while node.tag in _INLINE and node.parent:  # an inline element that was left open ends with its block
                up()
                in_link = 0
            closes = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}.get(tag, ("p",) if node.tag == "p" else ())
            while node.tag in closes and node.parent:
                up()
            node.mixed = True
        if m[3].rstrip().endswith("/") and tag not in _RAW and tag not in ("p", "div", "article", "main", "section"):
            continue
        child = _Node(tag, m[3], node)
        if tag in _RAW:
            end = re.compile(rf"</{tag}[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        node = child
        open_tags[tag] += 1
        if tag == "a":
            in_link = 1
    flush()
    return out


#: Weights of ``features`` before any page is seen; the fit is drawn towards them. The last three are of names.
PRIOR = np.array([-0.5, 1.0, -5.0, 0.7, -0.8, -1.0, 0.0, 0.0, 0.0, -1.0, -1.0])
#: How strongly, how far the text can go either way below a tag or name, how far the weight of a name moves, and where the density of links counts less.
_PULL, _MOST, _NAMES, _SURE = 0.05, 2.5, (-1.5, -0.5), 3
_PLAIN = ("p", "blockquote", "pre", "h1", "h2", "h3", "#root")
_SHORT = ("h1", "h2", "h3", "h4", "p", "li", "td", "pre", "blockquote")


def features(text: str, links: int, node: _Node) -> list[float]:
    """What a block shows: one, length, share of links, its tag, shortness, a copyright sign, marks and digits; and what names say against it."""
    words = text.count(" ") + 1
    return [
        1.0, min(2.0, words / 12), min(1.0, links / max(1, len(text))), float(node.tag in _PLAIN), float(words < 4 and node.tag not in _SHORT), float("\N{COPYRIGHT SIGN}" in text),
        float(text[-1] in ".!?:;\N{IDEOGRAPHIC FULL STOP}\N{HORIZONTAL ELLIPSIS}"), min(1.0, sum(map(text.count, ",;.")) / words), sum(c.isdigit() for c in text[:200]) / min(200, len(text)),
        float(sum(node.weak)), float(sum(node.against)),
    ]


def score(text: str, links: int, node: _Node, weights: np.ndarray = PRIOR) -> float:
    """Over 0 if the block looks like content by itself: what its tags say and what the classifier says."""
    x, tags = features(text, links, node), node.tags
    if tags >= _SURE:
        x[2] /= 5  # lists of links are part of an article
    named = tags or x[9] or x[10]
    if named:
        x[0] = x[5] = 0.0
    *own, weak, strong = weights.tolist()
    of_names = min(max(weak, _NAMES[0]), _NAMES[1]) * x[9] + min(max(strong, _NAMES[0]), _NAMES[1]) * x[10]
    return tags + of_names + max(-_MOST if named else -5.0, min(_MOST, sum(a * b for a, b in zip(x, own, strict=False))))


def fit_weights(rows: np.ndarray, content: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Weights of a balanced logistic classifier of blocks, drawn towards ``PRIOR``; ``PRIOR`` without blocks of both kinds."""
    n = len(content)
    if not 0 < content.sum() < n:
        return PRIOR
    w = PRIOR.copy()
    balance = np.where(content, 0.5 / content.mean(), 0.5 / (1 - content.mean())) / n
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        grad = rows.T @ (balance * (p - content)) + _PULL * (w - PRIOR)
        bend = (rows * (balance * p * (1 - p))[:, None]).T @ rows + _PULL * np.eye(len(w))
        step = np.linalg.solve(bend, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def minimum_cut(scores: list[float], chain: list[float], arcs: list[tuple[int, int, float]]) -> list[bool]:
    """Which blocks are on the source's side of a minimum cut; with several cuts, one of them.

    chain: capacity between each block and the next; arcs (first, last, capacity): further edges, none of which crosses another.
    """
    n = len(scores)
    if not n:
        return []
    cost = [(max(0.0, x), max(0.0, -x)) for x in scores]  # of the sink's side, of the source's side
    ending: dict[int, list[tuple[int, float]]] = {}
    for first, last, w in arcs:
        ending.setdefault(last, []).append((first, w))
    # a segment: first, last, cost by labels of both, and how it was joined from two segments
    stack: list[tuple] = []

    def joined(x: tuple, y: tuple) -> tuple:
        middle, cells, pick = x[1], [], []
        for a in (0, 1):
            for b in (0, 1):
                low, high = (x[2][2 * a + v] + cost[middle][v] + y[2][2 * v + b] for v in (0, 1))
                cells.append(min(low, high))
                pick.append(int(high < low))
        return (x[0], y[1], tuple(cells), (x, y, middle, tuple(pick)))

    for i in range(1, n):
        w = chain[i - 1]
        stack.append((i - 1, i, (0.0, w, w, 0.0), None))
        for first, w in sorted(ending.get(i, ()), reverse=True):
            top = stack.pop()
            while top[0] > first:
                top = joined(stack.pop(), top)
            c = top[2]
            stack.append((top[0], top[1], (c[0], c[1] + w, c[2] + w, c[3]), top[3]))
    label = [0] * n
    if not stack:
        return [cost[0][1] < cost[0][0]]
    whole = stack[0]
    for part in stack[1:]:
        whole = joined(whole, part)
    label[0], label[-1] = min(((a, b) for a in (0, 1) for b in (0, 1)), key=lambda ab: cost[0][ab[0]] + cost[-1][ab[1]] + whole[2][2 * ab[0] + ab[1]])
    todo = [whole]
    while todo:
        first, last, _, how = todo.pop()
        if how:
            x, y, middle, pick = how
            label[middle] = pick[2 * label[first] + label[last]]
            todo += (x, y)
    return [x == 1 for x in label]


def _distance(a: _Node, b: _Node) -> int:
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def main_text(page: str | None, weights: np.ndarray = PRIOR) -> str:
    """The content blocks of a page, one a line; empty if there are none."""
    blocks = blocks_of(page or "")
    scores = [score(*b, weights) for b in blocks]
    if all(s > 0 for s in scores):
        return "\n".join(b[0] for b in blocks)
    chain, arcs, last = [], [], {}
    for i, (_, _, node) in enumerate(blocks):
        if i:
            chain.append(_SMOOTH * _FALL ** min(60, _distance(blocks[i - 1][2], node)))
        # text beside other blocks of its element is a child of that element, else the element is the block
        home = node if node.mixed else node.parent or node
        if last.get(home, i) < i - 1:
            arcs.append((last[home], i, _SMOOTH * _FALL**2))
        last[home] = i
    return "\n".join(b[0] for b, inside in zip(blocks, minimum_cut(scores, chain, arcs), strict=True) if inside)


def examples(page: str | None) -> list[tuple[list[float], bool]]:
    """(features, content) of blocks whose tags leave no doubt, at most ``FIT_BLOCKS``, evenly over the page.

    Names don't decide what is an example, but for those of adverts, comments and the like inside an article, which are left out.
    """
    sure = []
    for b in blocks_of(page or ""):
        node = b[2]
        inside = node.in_article or node.tag == "article"
        if node.tags < 0 or (inside and node.pro >= _SURE and not node.against and not node.others):
            sure.append((features(*b), node.tags >= _SURE))
    return sure[:: -(-len(sure) // FIT_BLOCKS) or 1]


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [e for p in batch["html"].to_pylist() for e in examples(p)]
        yield pa.record_batch([pa.array([x for x, _ in found], pa.list_(pa.float64())), pa.array([y for _, y in found], pa.bool_())], names=["x", "y"])


def fit(pages: DataFrame) -> np.ndarray:
    """Weights of the classifier from at most ``FIT_PAGES`` of the pages; ``PRIOR`` if they hold no blocks of both kinds."""
    rows = columns_for(pages, page_id="long", url="string", html="string").withColumn("place", F.xxhash64("page_id", "url"))
    share = min(1.0, 2 * FIT_PAGES / max(1, pages.count()))
    some = rows.where(F.col("place") <= F.lit(bound(share))).orderBy("place").limit(FIT_PAGES)
    taken = some.select("html").mapInArrow(_examples, "x array<double>, y boolean").toPandas()
    return fit_weights(np.array(taken["x"].to_list(), float).reshape(-1, len(PRIOR)), taken["y"].to_numpy(bool)) if len(taken) else PRIOR


def extract(pages: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html and any other columns).

    weights: of the classifier, by default fitted on a sample of these pages. Null and empty pages have the empty text; null ids
    and urls stay; repeated rows are each extracted. An empty table gives an empty table.
    """
    weights = fit(pages) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, weights) for p in batch["html"].to_pylist()]
            yield pa.record_batch([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return columns_for(pages, page_id="long", url="string", html="string").mapInArrow(run, "page_id long, url string, text string, n_chars long")
