"""Main text of web pages by boosted trees over DOM nodes.

A page is parsed into elements and text blocks (runs of inline text).  Every
node has features of its own, its subtree, its siblings, its depth and the
words of its class, id and role; boosted trees give the probability that the
node holds main text.  Decoding is hierarchical: the most likely labelling in
which no node below a dropped node is kept, found bottom-up.

The model is trained on page layouts written by ``training_page`` (a bounded
number, a documented parameter): articles among menus, headers, footers,
sidebars, notices, adverts, forms and comments, with many namings and
nestings, and labels by construction.

Scripts, styles, templates and the head hold no text.  A head without its end
tag ends at the first tag or text that may not stand in it, another silent
element without one with the block around it.  Character references
are decoded, white space inside a block becomes one space, blocks are joined
by one space.  Null or empty html: empty text.  Text without any markup is
one block and is kept if the model says so.  Repeated rows get equal texts.
Input columns named text or n_chars give way to the output.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trenchline.llm.boosting import BoostedTrees
from trenchline.llm.words import pieces, schema_of, tune

#: layouts that the model is trained on
TRAINING_PAGES = 800

# Element names of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("script style head template noscript iframe svg object canvas audio video select textarea title datalist".split())
HEAD = set("html head title style script noscript template base basefont bgsound link meta noframes".split())  # start tags that may stand in a head
BLOCK = set(
    "html body div p ul ol li dl dt dd table thead tbody tfoot tr td th caption section article main nav aside header footer form fieldset legend "
    "h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address details summary dialog hr menu center hgroup search".split()
)
CLOSES_P = BLOCK - {"html", "body", "li", "td", "th", "tr", "dt", "dd"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = {"ul", "ol", "dl", "table", "menu", "div", "section", "article", "body", "main", "td"}
GROUPS = ["#text", "p", "h", "article", "main", "section", "div", "nav", "header", "footer", "aside", "form", "list", "li", "table", "quote", "figure", "body"]
GROUP_OF = {"ul": "list", "ol": "list", "dl": "list", "menu": "list", "dt": "li", "dd": "li", "tr": "table", "td": "table", "th": "table", "tbody": "table", "thead": "table"}
GROUP_OF |= {f"h{i}": "h" for i in range(1, 7)} | {"blockquote": "quote", "pre": "quote", "figcaption": "figure", "html": "body", "fieldset": "form", "dialog": "aside"}
CONTROLS = {"input", "button", "select", "textarea", "option", "label"}
TOKEN = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{2,}")


class Node:
    __slots__ = ("tag", "parent", "children", "attrs", "text", "depth", "links", "controls", "images", "label")

    def __init__(self, tag: str, parent: Node | None, attrs: str = ""):
        self.tag, self.parent, self.attrs = tag, parent, attrs
        self.children: list[Node] = []
        self.text: list[str] = []
        self.depth = parent.depth + 1 if parent else 0
        self.links = self.controls = self.images = 0
        self.label = 0


class Dom(HTMLParser):
    """Block elements as nodes; inline text goes to '#text' nodes of the nearest block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", None)
        self.stack: list[tuple[str, Node]] = [("html", self.root)]
        self.silent: list[str] = []
        self.in_link = 0
        self.open_text: Node | None = None

    def _node(self) -> Node:
        return self.stack[-1][1]

    def _close_to(self, i: int) -> None:
        for tag, _ in self.stack[i:]:
            if tag == "a":
                self.in_link = max(0, self.in_link - 1)
            if tag in BLOCK:
                self.open_text = None
        del self.stack[i:]

    def _close_open(self, tags: set, stops: set) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[i][0]
            if tag in tags:
                return self._close_to(i)
            if tag in stops:
                return None
        return None

    def handle_starttag(self, tag, attrs):
        if self.silent and (tag == "body" and "head" in self.silent or self.silent == ["head"] and tag not in HEAD):
            self.silent.clear()  # the head's end tag is omitted
        if self.silent:
            if tag not in VOID and tag not in ("html", "head", "body"):
                self.silent.append(tag)
            return
        node = self._node()
        if tag in SILENT:
            if tag in CONTROLS:
                node.controls += 1
            if tag == "head" and len(self.stack) > 1:
                return
            self.silent.append(tag)
            return
        if tag in ("br", "wbr"):
            self._text(" " if tag == "br" else "")
            return
        if tag in VOID:
            node.controls += tag == "input"
            node.images += tag == "img"
            if tag == "hr":
                self.open_text = None
            return
        if tag == "body" or tag == "html":
            if tag == "body":
                self.root.attrs += " " + _attributes(attrs)
            return
        if tag in BLOCK:
            if tag in CLOSES_P:
                self._close_open({"p"}, STOPS)
            if tag in SAME:
                self._close_open(SAME[tag], STOPS - {"div", "section", "article", "td"} if tag not in ("td", "th") else {"table"})
            child = Node(tag, self._node(), _attributes(attrs))
            child.label = any(k == "data-y" for k, _ in attrs)
            self._node().children.append(child)
            self.stack.append((tag, child))
            self.open_text = None
            return
        if tag == "a":
            self.in_link += 1
        node.controls += tag in CONTROLS
        self.stack.append((tag, node))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.silent:
            if tag in self.silent:
                del self.silent[len(self.silent) - 1 - self.silent[::-1].index(tag) :]
                return
            if "head" in self.silent:
                if tag == "html":
                    self.silent.clear()
                return
            if tag not in BLOCK or tag not in (name for name, _ in self.stack[1:]):
                return
            self.silent.clear()  # never closed: ends with the block around it
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                return self._close_to(i)
            if tag not in BLOCK and self.stack[i][0] in BLOCK:
                return None  # an inline end tag does not close blocks
        return None

    def _text(self, data: str) -> None:
        node = self._node()
        if self.open_text is None or self.open_text.parent is not node:
            if not data.strip():
                return
            self.open_text = Node("#text", node)
            node.children.append(self.open_text)
        self.open_text.text.append(data)
        if self.in_link:
            self.open_text.links += len(data)

    def handle_data(self, data):
        if self.silent == ["head"] and data.strip():
            self.silent.clear()  # text may not stand in a head
        if not self.silent:
            self._text(data)


def _attributes(attrs: list[tuple[str, str | None]]) -> str:
    return " ".join(v for k, v in attrs if v and (k in ("class", "id", "role", "itemprop", "aria-label") or k == "data-role"))


#: elements whose content is no markup, and comments, also one that is never closed
RAW = re.compile(r"(?is)<(script|style|textarea|title|xmp|iframe|noembed|noframes)\b[^>]*>.*?</\1\b|<!--(?:.*?--!?>|.*)")


def _without_open_comment(html: str) -> str:
    """A comment that is never closed reaches to the end of the page."""
    if html.count("<!--") <= html.count("-->"):
        return html
    return RAW.sub(lambda m: "" if m[0].startswith("<!--") and not m[0].endswith(("-->", "--!>")) else m[0], html)


def parse(html: str) -> Node:
    dom = Dom()
    html = _without_open_comment(html)
    # a page whose head is never closed would be silent to its end
    if "<body" in html.lower() and "</head" not in html.lower():
        html = re.sub(r"(?i)<body", "</head><body", html, count=1)
    dom.feed(html)
    dom.close()
    return dom.root


def walk(root: Node) -> list[Node]:
    """Nodes with a text block below them, parents before children, in page order."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(reversed(node.children))
    return order


def tokens(attrs: str) -> list[str]:
    words = [w.lower() for w in TOKEN.findall(attrs)]
    return words + [w[:4] + "*" for w in words]


def names(node: Node) -> list[str]:
    """Attribute words of a node, and its tag."""
    return [*tokens(node.attrs), "<" + node.tag]


def block_text(node: Node) -> str:
    return " ".join("".join(node.text).split())


NUMBERS = ["chars", "words", "links", "marks", "blocks", "long_blocks", "paragraphs", "controls", "images", "tags", "heads"]


def node_features(root: Node, odds: dict[str, float]) -> tuple[list[Node], np.ndarray]:
    """Nodes and their feature rows."""
    order = walk(root)
    place = {id(n): i for i, n in enumerate(order)}
    n = len(order)
    sums = np.zeros((n, len(NUMBERS)))
    for i, node in enumerate(order):
        if node.tag == "#text":
            text = block_text(node)
            sums[i, :6] = len(text), text.count(" ") + 1, min(node.links, len(text)), sum(text.count(c) for c in ".,;!?"), 1, len(text) > 120
        sums[i, 6:] = node.tag == "p", node.controls, node.images, node.tag != "#text", node.tag in ("h1", "h2")
    parent = np.array([place[id(x.parent)] if x.parent else 0 for x in order])
    own = sums.copy()
    for i in range(n - 1, 0, -1):
        sums[parent[i]] += sums[i]
    chars = np.maximum(sums[:, 0], 1)
    before = np.concatenate([[0.0], np.cumsum(own[:, 0])])[:-1]  # text before the node
    total = max(sums[0, 0], 1)
    group = [GROUP_OF.get(x.tag, x.tag) for x in order]
    good, bad = np.zeros(n), np.zeros(n)
    above_good, above_bad = np.zeros(n), np.zeros(n)
    nth, siblings = np.zeros(n), np.ones(n)
    inside = np.zeros((n, 4))  # in article or main, in list, in table, in form
    for i, node in enumerate(order):
        values = [odds.get(t, 0.0) for t in names(node)]
        good[i], bad[i] = max(values, default=0.0), min(values, default=0.0)
        if i:
            p = parent[i]
            above_good[i], above_bad[i] = max(above_good[p], good[p]), min(above_bad[p], bad[p])
            inside[i] = inside[p]
            g = group[p]
            inside[i, 0] += g in ("article", "main")
            inside[i, 1] += g == "list"
            inside[i, 2] += g == "table"
            inside[i, 3] += g == "form"
        for k, child in enumerate(node.children):
            j = place[id(child)]
            nth[j], siblings[j] = k / len(node.children), len(node.children)
    cols = [np.array([g == name for g in group], float) for name in GROUPS]
    cols += [np.log1p(sums[:, k]) for k in range(len(NUMBERS))]
    cols += [sums[:, 2] / chars, sums[:, 3] / chars, sums[:, 0] / np.maximum(sums[:, 9], 1), sums[:, 0] / np.maximum(sums[:, 4], 1), sums[:, 5] / np.maximum(sums[:, 4], 1)]
    cols += [sums[:, 0] / np.maximum(sums[parent, 0], 1), sums[:, 0] / total, before / total, (before + sums[:, 0]) / total]
    cols += [np.array([x.depth for x in order], float), nth, siblings, good, bad, above_good, above_bad, *inside.T]
    cols += [good[parent], bad[parent], np.log1p(sums[parent, 0]), sums[parent, 2] / chars[parent], sums[parent, 9]]
    parent_group = [group[p] for p in parent]
    cols += [np.array([g == name for g in parent_group], float) for name in ("article", "main", "div", "nav", "header", "footer", "aside", "form", "li", "body", "section")]
    return order, np.stack(cols, axis=1)


def lone_text(node: Node) -> bool:
    """The only text of its block: decided with the block, not by itself."""
    return node.tag == "#text" and node.parent is not None and len(node.parent.children) == 1


def decode(order: list[Node], logit: np.ndarray) -> np.ndarray:
    """Most likely labels in which a kept node has kept ancestors only."""
    place = {id(n): i for i, n in enumerate(order)}
    logit = np.array([logit[place[id(n.parent)]] if lone_text(n) else v for n, v in zip(order, logit)])
    keep, drop = -np.logaddexp(0, -logit), -np.logaddexp(0, logit)
    below_drop, best = drop.copy(), np.zeros(len(order))
    stay = np.zeros(len(order), bool)
    inner = keep.copy()
    for i in range(len(order) - 1, -1, -1):
        stay[i] = inner[i] > below_drop[i]
        best[i] = max(inner[i], below_drop[i])
        if i:
            p = place[id(order[i].parent)]
            below_drop[p] += below_drop[i]
            inner[p] += best[i]
    for i in range(1, len(order)):
        stay[i] &= stay[place[id(order[i].parent)]]
    return stay


# --- training layouts ---------------------------------------------------------

CONTENT_NAMES = "content article post entry story main body text article-body post-content entry-content story-body page-content main-content blog-post single articleBody prose".split()
BAD_NAMES = {
    "nav": "nav menu navbar navigation main-menu topnav breadcrumb breadcrumbs pagination site-nav toc tabs".split(),
    "header": "header site-header masthead topbar banner page-header logo brand".split(),
    "footer": "footer site-footer copyright bottom legal colophon page-footer".split(),
    "aside": "sidebar aside related widget side recommended popular trending most-read rail secondary promo see-also".split(),
    "notice": "notice cookie cookie-banner consent alert gdpr popup modal overlay announcement paywall warning message".split(),
    "ad": "ad ads advert advertisement sponsor sponsored banner-ad ad-slot adsbox promoted ad-container commercial".split(),
    "form": "form newsletter signup subscribe search login contact-form search-form register".split(),
    "comments": "comments comment comment-list responses disqus replies discussion reader-comments comment-body".split(),
    "share": "share social share-buttons tags tag-list meta byline author-box toolbar print".split(),
}
SEMANTIC = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}


class Writer:
    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)

    def one(self, options):
        return options[int(self.rng.integers(len(options)))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def word(self) -> str:
        return "".join(self.one(["th", "er", "on", "an", "re", "la", "de", "ie", "ch", "un", "os", "ado", "ing", "eau", "st", "a", "o", "é"]) for _ in range(int(self.rng.integers(1, 5))))

    def sentence(self, least: int, most: int) -> str:
        words = [self.word() + ("," if self.chance(0.08) else "") for _ in range(int(self.rng.integers(least, most + 1)))]
        return " ".join(words).capitalize() + "."

    def prose(self, sentences: int) -> str:
        return " ".join(self.sentence(1, 25) for _ in range(sentences))

    def attrs(self, names: list[str], p: float = 0.8) -> str:
        if not self.chance(p):
            return ""
        return f' {self.one(["class", "class", "id"])}="{self.one(names)}{self.one(["", "", " x" + str(self.rng.integers(99)), " clearfix", " row"])}"'

    def link_list(self) -> str:
        items = [f'<li><a href="/{self.word()}">{self.word()}{" " + self.word() if self.chance(0.3) else ""}</a></li>' for _ in range(int(self.rng.integers(2, 10)))]
        return "<ul>" + "".join(items) + "</ul>"

    def links(self) -> str:
        return " | ".join(f'<a href="/{self.word()}">{self.word()}</a>' for _ in range(int(self.rng.integers(2, 7))))

    def bad(self, kind: str) -> str:
        tag = SEMANTIC[kind] if kind in SEMANTIC and self.chance(0.6) else self.one(["div", "div", "section"] if kind != "ad" else ["div", "aside", "p", "section"])
        attrs = self.attrs(BAD_NAMES[kind], 0.35 if tag == SEMANTIC.get(kind) else 1.0)
        short = lambda a, b: self.sentence(a, b)
        if kind == "nav":
            body = self.one([self.link_list, self.links])()
        elif kind == "header":
            body = self.one([f"<h1>{self.word()}</h1>", f"<a href='/'>{self.word()}</a>", f"<p>{short(2, 8)}</p>", f"<div>{self.word()}</div>"]) + (f"<nav>{self.link_list()}</nav>" if self.chance(0.5) else "")
        elif kind == "footer":
            body = self.one([f"&copy; {self.word()}.example &middot; {short(3, 14)}", f"<p>&copy; {short(3, 14)}</p>{self.link_list()}", f"<p>{self.links()}</p><p>{short(3, 20)}</p>"])
        elif kind == "aside":
            body = self.one([f"<h3>{self.word()}</h3>{self.link_list()}", f"<h2>{short(1, 3)}</h2><p>{self.prose(2)}</p>", f"<p>{self.prose(3)}</p>", f"{short(3, 20)}", "".join(f"<p>{self.prose(2)}</p>" for _ in range(3))])
        elif kind == "notice":
            body = self.one([f"<p>{self.prose(2)}</p><button>{self.word()}</button>", f"{short(4, 25)}", f"<p>{self.prose(3)}</p>", f"{short(3, 12)} <a href='/p'>{self.word()}</a>"])
        elif kind == "ad":
            body = self.prose(int(self.rng.integers(1, 4))) if tag == "p" else self.one([self.prose(int(self.rng.integers(1, 4))), f"<p>{self.prose(2)}</p>", f"<a href='/x'><img src=i.png>{short(2, 8)}</a>", f"<h3>{short(1, 4)}</h3><p>{self.prose(1)}</p>"])
        elif kind == "form":
            body = f"<label>{self.word()}</label><input name=q>{self.one(['', '<p>' + self.prose(1) + '</p>'])}<button>{self.word()}</button>"
        elif kind == "comments":
            item = lambda: self.one([f"<div{self.attrs(['comment', 'reply', 'comment-body'])}><b>{self.word()}</b><p>{self.prose(int(self.rng.integers(1, 5)))}</p></div>", f"<li><p>{self.prose(2)}</p></li>", f"<article{self.attrs(['comment'])}><p>{self.prose(3)}</p></article>", f"<p>{self.prose(2)}</p>"])
            body = (f"<h3>{short(1, 3)}</h3>" if self.chance(0.5) else "") + "".join(item() for _ in range(int(self.rng.integers(1, 6))))
        else:
            body = self.one([self.links(), f"<a href='#'>{self.word()}</a> <a href='#'>{self.word()}</a>", f"<span>{self.word()}</span> <span>{self.word()}</span>"])
        return f"<{tag}{attrs}>{body}</{tag}>"

    def content_block(self) -> str:
        x = self.rng.random()
        if x < 0.72:
            text = self.one([self.prose, self.prose, lambda n: self.sentence(1, 3)])(int(self.rng.integers(1, 9)))
            if self.chance(0.15):
                text = f"<b>{text}<br>"
            elif self.chance(0.2):
                text += f' <a href="/w">{self.word()}</a> {self.sentence(2, 8)}'
            return f"<p data-y>{text}</p>"
        if x < 0.82:
            tag = self.one(["h2", "h3"])
            return f"<{tag} data-y>{self.sentence(1, 8)}</{tag}>"
        if x < 0.9:
            return "<ul>" + "".join(f"<li data-y>{self.sentence(2, 20)}</li>" for _ in range(int(self.rng.integers(2, 7)))) + "</ul>"
        if x < 0.95:
            return f"<blockquote><p data-y>{self.prose(2)}</p></blockquote>"
        if x < 0.98:
            return "<table><tr>" + "".join(f"<td data-y>{self.word()}</td>" for _ in range(3)) + "</tr></table>"
        return f"<pre data-y>{self.prose(2)}</pre>"

    def page(self) -> str:
        title = f"<h1 data-y>{self.sentence(2, 12)}</h1>"
        if self.chance(0.15):
            title = f"<header>{title}</header>"
        blocks = [title] if self.chance(0.9) else []
        blocks += [self.content_block() for _ in range(int(self.one([1, 1, 1, 2, 2, 3, 4, 6, 9, 14, 30])))]
        for kind in ("ad", "share", "aside", "form", "notice"):
            if self.chance(0.2):
                blocks.insert(int(self.rng.integers(1, len(blocks) + 1)), self.bad(kind))
        if self.chance(0.15):
            blocks.append(self.bad("comments"))
        if self.chance(0.1):
            blocks.append(self.bad("footer"))
        body = "".join(blocks)
        x = self.rng.random()
        if x < 0.45:
            main = f"<article{self.attrs(CONTENT_NAMES, 0.3)}>{body}</article>"
        elif x < 0.6:
            main = f"<main{self.attrs(CONTENT_NAMES, 0.3)}>{body}</main>"
        elif x < 0.95:
            main = f"<div{self.attrs(CONTENT_NAMES, 0.85)}>{body}</div>"
        else:
            main = body
        for _ in range(int(self.rng.integers(0, 3))):
            if self.chance(0.4):
                tag = self.one(['div', 'section', 'main'])
                main = f"<{tag}{self.attrs(['container', 'wrapper', 'row', 'col', 'page', *CONTENT_NAMES[:3]], 0.5)}>{main}</{tag}>"
        column = [main]
        if self.chance(0.4):
            column.insert(int(self.rng.integers(0, 2)), self.bad("aside"))
        if self.chance(0.3):
            column.append(self.bad("comments"))
        head = [self.bad(k) for k, p in (("notice", 0.3), ("header", 0.4), ("nav", 0.75), ("ad", 0.5), ("form", 0.15)) if self.chance(p)]
        tail = [self.bad(k) for k, p in (("aside", 0.15), ("form", 0.2), ("nav", 0.2), ("ad", 0.2), ("footer", 0.85), ("notice", 0.15)) if self.chance(p)]
        inner = "".join(column)
        if self.chance(0.3):
            inner = f"<div{self.attrs(['container', 'wrapper', 'layout', 'page'], 0.6)}>{inner}</div>"
        return f"<html><head><title>{self.word()}</title></head><body>{''.join(head)}{inner}{''.join(tail)}</body></html>"


def training_page(seed: int) -> str:
    """An article in one of many layouts; blocks of main text carry ``data-y``."""
    return Writer(seed).page()


def mark(root: Node) -> list[Node]:
    """Nodes in page order; label 1 where the node holds main text."""
    order = walk(root)
    for node in order:
        if node.parent and node.parent.label and node.tag == "#text":
            node.label = 1
    for node in reversed(order):
        if node.label and node.parent:
            node.parent.label = 1
    return order


@lru_cache(maxsize=2)
def train(n_pages: int = TRAINING_PAGES, seed: int = 11) -> tuple[BoostedTrees, dict[str, float]]:
    """Trees and the log odds of attribute words, from ``n_pages`` layouts."""
    roots = [parse(training_page(seed * 100_003 + i)) for i in range(n_pages)]
    orders = [mark(r) for r in roots]
    seen, good = Counter(), Counter()
    for order in orders:
        for node in order:
            for t in set(names(node)):
                seen[t] += 1
                good[t] += bool(node.label)
    odds = {t: float(np.log((good[t] + 0.5) / (seen[t] - good[t] + 0.5))) for t in seen if seen[t] >= 3}
    xs, ys = [], []
    for root, order in zip(roots, orders):
        _, x = node_features(root, odds)
        use = np.array([not lone_text(n) for n in order])
        xs.append(x[use])
        ys.append(np.array([float(bool(n.label)) for n in order])[use])
    return BoostedTrees(rounds=60).fit(np.concatenate(xs), np.concatenate(ys)), odds


def extract(pages: list[str], model: BoostedTrees, odds: dict[str, float]) -> list[str]:
    orders, rows = [], []
    for html in pages:
        order, x = node_features(parse(html), odds)
        orders.append(order), rows.append(x)
    logit = model.logit(np.concatenate(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for order in orders:
        stay = decode(order, logit[at : at + len(order)])
        at += len(order)
        out.append(" ".join(filter(None, (block_text(n) for n, s in zip(order, stay) if s and n.tag == "#text"))))
    return out


def extract_pages(pages: DataFrame, n_pages: int = TRAINING_PAGES) -> DataFrame:
    """All rows with text (main text, empty if none) and n_chars; html is dropped."""
    spark = pages.sparkSession
    tune(spark)
    shared = spark.sparkContext.broadcast(train(n_pages))  # bounded: trees of fixed number and depth
    schema = schema_of(pages, [("text", T.StringType()), ("n_chars", T.LongType())], drop=("html",))
    carry = [f.name for f in schema.fields[:-2]]

    def run(batches):
        model, odds = shared.value
        for batch in pieces(batches, "html", 2 << 20):
            texts = extract([h or "" for h in batch.column("html").to_pylist()], model, odds)
            cols = [*[batch.column(c) for c in carry], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return pages.withColumn("html", F.col("html").cast("string")).mapInArrow(run, schema)
