"""Main text of web pages by a tree-structured graphical model over DOM nodes.

A page becomes a tree of elements. Each element is a binary variable, content
or not, with a unary potential from its features (tag, words of class, id and
role, text and link amounts, position) and a pairwise potential with its
parent that depends on the child's kind of tag. Marginals come from sum-product message
passing, once from the leaves to the root and once back. Both potentials are
trained on labelled pages by the gradient of the likelihood, for which the
same messages give the expectations.

Labelled pages are not part of the inputs; ``labelled_pages`` writes a bounded
number of them, many layouts with known main text and boilerplate of all kinds,
in words drawn at random, so that no real page is needed and none is learned
by heart. The trained model is a few hundred numbers.

The text of a page is that of the content elements, block by block in page
order: references decoded, white space within a block one blank, trimmed,
blocks joined by a newline. Scripts, styles and other elements without
readable text are no text whatever their marginal.

Defined cases: null html is empty; a page without markup is one block; broken
markup never raises (unclosed paragraphs and items end where the next begins,
end tags without start are ignored, unfinished tags are dropped); depth and
length are unbounded, nothing is recursive.
"""

from __future__ import annotations

import html as _html
import random
import re
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, log1p

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import held, prepare_python

# Fixed values of the HTML standard: elements that never have content, that hold raw text, that end a paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
SILENT = frozenset("script style head title noscript template iframe textarea select option button svg math canvas object video audio datalist input label noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: What an opening tag ends, within the nearest of the second set.
CLOSES: dict[str, tuple[frozenset, frozenset]] = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_TELLING = frozenset("class id role aria-label itemprop hidden aria-hidden".split())
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I | re.A) for t in RAW}
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+")


@dataclass
class Node:
    tag: str
    parent: int
    attrs: str = ""


class _Open:
    """The open elements. Where each tag and each block is among them is kept, so nothing is searched for."""

    def __init__(self, nodes: list[Node]):
        self.nodes, self.stack, self.blocks = nodes, [0], []
        self.at: dict[str, list[int]] = {}

    def push(self, node: int) -> None:
        tag = self.nodes[node].tag
        self.at.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def cut(self, depth: int) -> bool:
        """Close all from that depth on; whether a block was among them."""
        for node in reversed(self.stack[depth:]):
            self.at[self.nodes[node].tag].pop()
        del self.stack[depth:]
        block = False
        while self.blocks and self.blocks[-1] >= depth:
            self.blocks.pop()
            block = True
        return block

    def end(self, tag: str) -> bool:
        """An end tag closes the nearest element of its kind; those of inline elements do not reach over a block."""
        own = self.at.get(tag)
        if not own or (tag not in BLOCK and self.blocks and self.blocks[-1] > own[-1]):
            return False
        return self.cut(own[-1])

    def begin(self, tag: str) -> None:
        """What an opening tag closes: an open paragraph, and items of its kind within the nearest list or table."""
        if tag in BLOCK and self.blocks and self.nodes[self.stack[self.blocks[-1]]].tag == "p":
            self.cut(self.blocks[-1])
        if tag in CLOSES:
            ends, limit = CLOSES[tag]
            low = max((own[-1] for t in limit if (own := self.at.get(t))), default=0)
            found = [own[k] for t in ends if (own := self.at.get(t)) and (k := bisect_right(own, low)) < len(own)]
            if found:
                self.cut(min(found))


def parse(page: str | None) -> tuple[list[Node], list[tuple[int, int, str]]]:
    """The elements in page order (parents first), and the events (node, kind, text): 1 text, 0 a line break, 2 the edge of a block."""
    nodes = [Node("#page", -1)]
    events: list[tuple[int, int, str]] = []
    if not page:
        return nodes, events
    open_ = _Open(nodes)
    stack = open_.stack
    at, end = 0, len(page)
    raw = ""
    while at < end:
        if raw:
            m = _RAW_END[raw].search(page, at)
            if not m:
                break
            at, raw = m.start(), ""
        m = _TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            events.append((stack[-1], 1, page[at:stop]))
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if open_.end(tag):
                events.append((stack[-1], 2, ""))
            continue
        if tag == "br":
            events.append((stack[-1], 0, ""))
            continue
        open_.begin(tag)
        if tag in BLOCK:
            events.append((stack[-1], 2, ""))
            if tag == "hr":
                continue
        nodes.append(Node(tag, stack[-1], m[3] or ""))
        if tag in VOID or (m[3] or "").endswith("/") and tag not in BLOCK:
            continue
        open_.push(len(nodes) - 1)
        if tag in RAW:
            raw = tag
    return nodes, events


# --- features -----------------------------------------------------------------------------------------------------

#: Words of class, id and role by what they say; fixed values.
HINTS: dict[str, str] = {
    "main": "article main content post entry story body text hentry prose chapter blogpost",
    "menu": "nav navigation navbar menu menubar breadcrumb breadcrumbs tabs pager pagination toc topbar toolbar skip",
    "head": "header masthead banner branding logo hero top",
    "foot": "footer foot bottom copyright colophon legal",
    "side": "sidebar side aside rail widget related recommended trending popular more promoted recirc teaser tags",
    "note": "cookie consent notice gdpr modal popup overlay alert newsletter subscribe signup paywall disclaimer warning message toast",
    "ad": "ad ads advert advertisement adsbygoogle sponsor sponsored promo promotion dfp banner commercial",
    "form": "form search login comment-form contact field input signin",
    "talk": "comment comments commentlist reply replies respond discussion disqus thread reader feedback response responses review reviews",
    "share": "share sharing social follow facebook twitter print meta byline tools buttons",
}
_HINT_OF = {w: k for k, ws in HINTS.items() for w in ws.split()}
_TAGS = ("p h1 h2 h3 h4 h5 h6 li ul ol dl dd dt div span a b strong i em u article main section nav aside header footer form table tr td th "
         "blockquote pre code figure figcaption body html #page img button label small address details summary center font").split()
_NAMES = [f"tag:{t}" for t in _TAGS] + ["tag:other"] + [f"hint:{k}" for k in HINTS] + [f"up:{k}" for k in HINTS] + [
    "bias", "hidden", "words:0", "words:1", "words:5", "words:15", "words:40", "words:120", "links:0", "links:lo", "links:mid", "links:hi",
    "stops", "marks", "early", "late", "in:article", "in:nav", "in:aside", "in:footer", "in:header", "in:form", "in:main", "share:lo", "share:hi"]
_AT = {n: k for k, n in enumerate(_NAMES)}
#: Kinds of child in the pairwise potential: what a tag, a region or a named region may do to what it inherits.
_EDGE = ["inline", "heading", "paragraph", "item", "box", "region", "named", "silent"]


def _hints(attrs: str) -> tuple[list[str], bool]:
    found, hidden = [], False
    if attrs:
        for name, a, b, c in _ATTR.findall(attrs):
            name = name.lower()
            if name not in _TELLING:
                continue
            if name in ("hidden", "aria-hidden"):
                hidden |= (a or b or c).lower() != "false"
                continue
            words = re.sub(r"([a-z])([A-Z])", r"\1 \2", a or b or c).lower()
            found += [h for w in _WORD.findall(words) if (h := _HINT_OF.get(w))]
    return found, hidden


def featurize(nodes: list[Node], events: list[tuple[int, int, str]]) -> tuple[list[list[int]], np.ndarray, np.ndarray, np.ndarray]:
    """Per element: numbers of its active features, edge kind, parent, and whether it is silent."""
    n = len(nodes)
    parent = np.fromiter((x.parent for x in nodes), np.int64, n)
    words, marks = [0] * n, [0] * n
    first = [-1] * n
    texts = 0
    for i, kind, text in events:
        if kind == 1:
            words[i] += text.count(" ") + text.count("\n") + 1 if not text.isspace() else 0
            marks[i] += text.count(".") + text.count(",")
            if first[i] < 0:
                first[i] = texts
            texts += 1
    linked = [w if x.tag == "a" else 0 for w, x in zip(words, nodes)]
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        words[p] += words[i]
        marks[p] += marks[i]
        if nodes[i].tag == "a":
            linked[i] = words[i]
        linked[p] += linked[i]
    total = max(1, words[0])
    rows, edge, silent = [], np.zeros(n, np.int64), np.zeros(n, bool)
    above: list[set[str]] = [set()] * n
    regions: list[set[str]] = [set()] * n
    for i, x in enumerate(nodes):
        tag = x.tag
        hints, hidden = _hints(x.attrs)
        if i:
            above[i] = above[x.parent]
            regions[i] = regions[x.parent]
        silent[i] = tag in SILENT or (i > 0 and silent[x.parent])
        f = [_AT["bias"], _AT.get(f"tag:{tag}", _AT["tag:other"])]
        f += {_AT[f"hint:{h}"] for h in hints}
        f += [_AT[f"up:{h}"] for h in above[i]]
        if hidden:
            f.append(_AT["hidden"])
        w = words[i]
        f.append(_AT["words:0" if w == 0 else "words:1" if w < 5 else "words:5" if w < 15 else "words:15" if w < 40 else "words:40" if w < 120 else "words:120"])
        if w:
            share = linked[i] / w
            f.append(_AT["links:0" if share == 0 else "links:lo" if share < 0.25 else "links:mid" if share < 0.6 else "links:hi"])
            if marks[i] / w > 0.04:
                f.append(_AT["marks"])
            if w / total > 0.5:
                f.append(_AT["share:hi"])
            elif w / total < 0.05:
                f.append(_AT["share:lo"])
        if first[i] >= 0 and texts > 8:
            place = first[i] / texts
            if place < 0.1:
                f.append(_AT["early"])
            elif place > 0.9:
                f.append(_AT["late"])
        f += [_AT[f"in:{r}"] for r in regions[i]]
        if hints:
            above[i] = above[i] | set(hints)
        if tag in ("article", "nav", "aside", "footer", "header", "form", "main"):
            regions[i] = regions[i] | {tag}
        edge[i] = (7 if silent[i] else 6 if hints and tag in BLOCK else 5 if tag in ("article", "main", "nav", "aside", "header", "footer", "form", "body", "html", "section")
                   else 2 if tag in ("p", "pre", "blockquote") else 1 if tag[0] == "h" and tag[1:].isdigit() else 3 if tag in ("li", "dd", "dt", "td", "th", "tr")
                   else 4 if tag in BLOCK else 0)
        rows.append(f)
    return rows, edge, parent, silent


# --- the model ----------------------------------------------------------------------------------------------------


@dataclass
class Model:
    unary: np.ndarray  #: weight of each feature, for content against not
    pair: np.ndarray  #: [edge kind, parent state, child state]


def marginals(rows, edge, parent, model: Model, joint: bool = False):
    """P(content) of each element by messages up and down the tree; with joint, also the sums of pair marginals by edge kind."""
    n = len(rows)
    w = model.unary.tolist()
    pair = model.pair.tolist()
    score = [sum(map(w.__getitem__, f)) for f in rows]  # log potential of state 1 against 0
    par, kinds = parent.tolist(), edge.tolist()
    # Upward: what a child says about its parent, as log-odds up to a common term.
    b0, b1 = [0.0] * n, score[:]
    m0, m1 = [0.0] * n, [0.0] * n
    for i in range(n - 1, 0, -1):
        t = pair[kinds[i]]
        x0, x1 = b0[i], b1[i]
        p, q = x0 + t[0][0], x1 + t[0][1]
        u0 = p + log1p(exp(q - p)) if p > q else q + log1p(exp(p - q))
        p, q = x0 + t[1][0], x1 + t[1][1]
        u1 = p + log1p(exp(q - p)) if p > q else q + log1p(exp(p - q))
        m0[i], m1[i] = u0, u1
        b0[par[i]] += u0
        b1[par[i]] += u1
    # Downward: the parent's belief without this child.
    down = [0.0] * n  # log-odds of what comes from above
    out = [0.0] * n
    sums = np.zeros_like(model.pair) if joint else None
    for i in range(n):
        if i:
            p_ = par[i]
            c0 = b0[p_] - m0[i]
            c1 = b1[p_] + down[p_] - m1[i]
            t = pair[kinds[i]]
            p, q = c0 + t[0][0], c1 + t[1][0]
            d0 = p + log1p(exp(q - p)) if p > q else q + log1p(exp(p - q))
            p, q = c0 + t[0][1], c1 + t[1][1]
            d1 = p + log1p(exp(q - p)) if p > q else q + log1p(exp(p - q))
            down[i] = d1 - d0
            if joint:
                j = np.array([[c0 + t[0][0] + b0[i], c0 + t[0][1] + b1[i]], [c1 + t[1][0] + b0[i], c1 + t[1][1] + b1[i]]])
                j = np.exp(j - j.max())
                sums[kinds[i]] += j / j.sum()
        z = b1[i] - b0[i] + down[i]
        out[i] = 1 / (1 + exp(-z)) if z > -700 else 0.0
    return (np.array(out), sums) if joint else out


def train(pages: list[tuple[str, set[str]]], epochs: int = 12, rate: float = 0.1, decay: float = 1e-3) -> Model:
    """Fit both potentials to (html, marks) pages: an element is content if its own text has a mark of the set or its text-bearing
    descendants are mostly content; AdaGrad on the likelihood."""
    model = Model(np.zeros(len(_NAMES)), np.zeros((len(_EDGE), 2, 2)))
    data = []
    for page, wanted in pages:
        nodes, events = parse(page)
        rows, edge, parent, silent = featurize(nodes, events)
        good, bad = np.zeros(len(nodes)), np.zeros(len(nodes))
        for i, kind, text in events:
            if kind == 1 and not text.isspace() and not silent[i]:
                (good if any(t in wanted for t in text.split()) else bad)[i] += len(text)
        own = good > 0
        bare = (good + bad) == 0
        for i in range(len(nodes) - 1, 0, -1):
            good[parent[i]] += good[i]
            bad[parent[i]] += bad[i]
        y = np.where(bare, good > bad, own)
        # Elements without any text take their parent's state.
        for i in range(1, len(nodes)):
            if good[i] + bad[i] == 0:
                y[i] = y[parent[i]] and not silent[i]
        data.append((rows, edge, parent, y.astype(int)))
    squares_u, squares_p = np.full_like(model.unary, 1e-2), np.full_like(model.pair, 1e-2)
    for _ in range(epochs):
        for rows, edge, parent, y in data:
            p, sums = marginals(rows, edge, parent, model, joint=True)
            g = np.zeros_like(model.unary)
            for f, d in zip(rows, y - p):
                g[f] += d
            seen = np.zeros_like(model.pair)
            np.add.at(seen, (edge[1:], y[parent[1:]], y[1:]), 1)
            h = seen - sums
            g -= decay * model.unary
            h -= decay * model.pair
            squares_u += g * g
            squares_p += h * h
            model.unary += rate * g / np.sqrt(squares_u)
            model.pair += rate * h / np.sqrt(squares_p)
    return model


def labelled_pages(count: int = 480, seed: int = 3) -> list[tuple[str, set[str]]]:
    """Pages of many layouts with the set of the words of their main text; words are random, so they say nothing by themselves."""
    rng = random.Random(seed)
    syllables = [a + b for a in "b c d f g l m n p r s t v".split() for b in "a e i o u".split()]
    out = []
    for number in range(count):
        main: set[str] = set()

        def word(keep: bool) -> str:
            w = "".join(rng.choices(syllables, k=rng.randint(1, 4))) + ("x" if keep else "z")
            if keep:
                main.add(w)
            return w

        def words(n: int, keep: bool) -> str:
            ws = [word(keep) for _ in range(n)]
            for k in range(len(ws)):
                if rng.random() < 0.12:
                    mark = rng.choice([".", ",", ".", "&amp;", "!"])
                    if keep:
                        main.add(_html.unescape(ws[k] + mark))
                        main.add(ws[k] + mark)
                    ws[k] += mark
            return " ".join(ws)

        def link(keep: bool, n: int) -> str:
            return f'<a href="/{rng.randint(1, 999)}">{words(n, keep)}</a>'

        def wrap(inner: str, tag: str, names: str, unnamed: float = 0.0) -> str:
            shape = rng.random()
            # Names that say nothing are common: what tells such an element is its shape.
            name = "".join(rng.choices(syllables, k=rng.randint(2, 3))) if rng.random() < unnamed else rng.choice(names.split())
            attr = f' class="{name}"' if shape < 0.6 else f' id="{name}"' if shape < 0.9 else f' class="{name}-{rng.choice(["box", "wrap", "list", "area"])}"'
            return f"<{tag}{attr}>{inner}</{tag}>"

        def items(n: int, linked: bool) -> str:
            return "<ul>" + "".join(f"<li>{link(False, rng.randint(1, 3)) if linked else words(rng.randint(1, 8), False)}" + rng.choice(["</li>", "</li>", ""]) for _ in range(n)) + "</ul>"

        def plain(low: int, high: int) -> str:
            return "".join(f"<p>{words(rng.randint(low, high), False)}</p>" for _ in range(rng.randint(1, 2))) if rng.random() < 0.6 else words(rng.randint(low, high), False)

        def paragraph() -> str:
            kind = rng.random()
            n = rng.choice([1, 2, 4, 8, 15, 30, 60, 90])
            if kind < 0.62:
                return f"<p>{words(n, True)}</p>"
            if kind < 0.7:
                return f"<p><b>{words(n, True)}<br>"
            if kind < 0.76:
                return f"<p>{words(n, True)} {link(True, 2)} {words(3, True)}</p>"
            if kind < 0.82:
                return f"<h2>{words(rng.randint(1, 6), True)}</h2>"
            if kind < 0.87:
                return "<ul>" + "".join(f"<li>{words(rng.randint(2, 12), True)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
            if kind < 0.9:
                return f"<blockquote>{words(n, True)}</blockquote>"
            if kind < 0.93:
                return "<table>" + "".join(f"<tr><td>{words(2, True)}</td><td>{words(3, True)}</td></tr>" for _ in range(rng.randint(1, 3))) + "</table>"
            if kind < 0.96:
                return f"<figure><img src=x><figcaption>{words(rng.randint(3, 9), True)}</figcaption></figure>"
            return f"<div>{words(n, True)} <em>{words(2, True)}</em></div>"

        def boiler(where: str) -> str:
            made = {
                "nav": lambda: f"<nav>{items(rng.randint(3, 8), True)}</nav>",
                "menu": lambda: wrap(items(rng.randint(3, 8), True), rng.choice(["div", "ul", "section"]), HINTS["menu"], 0.3),
                "crumb": lambda: wrap(" &gt; ".join(link(False, 1) for _ in range(3)), "div", "breadcrumb breadcrumbs navigation", 0.3),
                "header": lambda: f"<header>{rng.choice([f'<h1>{words(2, False)}</h1>', '', f'<p>{words(4, False)}</p>'])}{rng.choice([items(4, True), link(False, 2)])}</header>",
                "head": lambda: wrap(plain(2, 10), "div", HINTS["head"]),
                "footer": lambda: f"<footer>&copy; {plain(3, 25)}{rng.choice(['', items(3, True)])}</footer>",
                "foot": lambda: wrap(plain(3, 25), "div", HINTS["foot"]),
                "aside": lambda: f"<aside>{rng.choice([plain(5, 50), items(5, True), f'<h3>{words(2, False)}</h3>' + items(4, True)])}</aside>",
                "side": lambda: wrap(rng.choice([plain(5, 50), items(5, True), f"<h3>{words(2, False)}</h3>" + items(4, True)]), rng.choice(["div", "section"]), HINTS["side"]),
                "note": lambda: wrap(plain(4, 40) + rng.choice(["", "<button>ok</button>"]), rng.choice(["div", "section"]), HINTS["note"]),
                "ad": lambda: wrap(plain(3, 40), rng.choice(["div", "div", "section", "p"]), HINTS["ad"]),
                "form": lambda: f"<form>{words(rng.randint(1, 8), False)}<input name=q><button>{words(1, False)}</button></form>",
                "talk": lambda: wrap("".join(f'<div class="{rng.choice(["comment", "reply", "item", "response"])}"><b>{words(1, False)}</b><p>{words(rng.randint(4, 60), False)}</p></div>'
                                             for _ in range(rng.randint(1, 4))), rng.choice(["div", "section", "ol"]), HINTS["talk"]),
                "share": lambda: wrap(items(3, True), "div", HINTS["share"], 0.3),
                "links": lambda: wrap(f"<h3>{words(2, False)}</h3>" + items(rng.randint(3, 6), True), "div", HINTS["side"], 0.6),
                "script": lambda: f'<script>var t="{words(3, False)} </p>";</script>',
                "bare": lambda: "<!-- " + words(3, False) + " -->",
            }
            return made[where]()

        before = ["nav", "menu", "crumb", "header", "head", "note", "ad", "form", "script", "bare", "share"]
        after = ["footer", "foot", "aside", "side", "links", "note", "ad", "form", "talk", "share", "script", "nav"]
        inside = ["ad", "side", "share", "note", "aside", "script"]
        title = words(rng.randint(2, 10), True)
        blocks = [rng.choice([f"<h1>{title}</h1>", f"<h1>{title}</h1>", f"<header><h1>{title}</h1></header>", ""])]
        for _ in range(rng.choice([1, 2, 3, 5, 8, 14])):
            blocks.append(paragraph())
            if rng.random() < 0.08:
                blocks.append(boiler(rng.choice(inside)))
        if rng.random() < 0.15:
            blocks.append(boiler("talk"))
        body = "".join(blocks)
        holder = rng.random()
        if holder < 0.5:
            body = f"<article>{body}</article>"
        elif holder < 0.65:
            body = f"<main>{body}</main>"
        elif holder < 0.95:
            body = wrap(body, rng.choice(["div", "section", "div"]), "content main article post entry story post-content article-body main-content entry-content", 0.25)
        else:
            body = f"<div>{body}</div>"
        if rng.random() < 0.2:
            body = f"<main>{body}{boiler('side') if rng.random() < 0.4 else ''}</main>"
        top = "".join(boiler(rng.choice(before)) for _ in range(rng.randint(1, 4)))
        low = "".join(boiler(rng.choice(after)) for _ in range(rng.randint(1, 4)))
        if rng.random() < 0.05:  # some frameworks put the whole page into one form
            top, low = "<form>" + top, low + "</form>"
        if rng.random() < 0.12:  # a text and nothing else, as parts of pages and plain documents are
            text = "".join(blocks) if rng.random() < 0.5 else body
            out.append((rng.choice([text, f"<html><body>{text}</body></html>", f"<div>{text}</div>", f"<div>{words(rng.randint(1, 9), True)}</div>", words(rng.randint(1, 9), True)]), main))
            continue
        page = f"<!DOCTYPE html><html><head><title>{words(3, False)}</title><style>p{{margin:0}}</style></head><body>{top}{body}{low}</body></html>"
        out.append((page, main))
    return out


_TRAINED: dict[tuple[int, int], Model] = {}


def default_model(count: int = 480, seed: int = 3) -> Model:
    """The model of labelled_pages(count, seed), trained once a process."""
    if (count, seed) not in _TRAINED:
        _TRAINED[count, seed] = train(labelled_pages(count, seed))
    return _TRAINED[count, seed]


def blocks_of(page: str | None, model: Model, threshold: float = 0.5) -> list[str]:
    """The text blocks of the content elements of a page, in page order."""
    nodes, events = parse(page)
    if not events:
        return []
    if len(nodes) == 1:
        keep = [1.0]
        silent = np.zeros(1, bool)
    else:
        rows, edge, parent, silent = featurize(nodes, events)
        keep = marginals(rows, edge, parent, model)
    block = [0] * len(nodes)  # the block element that text of this one belongs to
    for i, x in enumerate(nodes):
        block[i] = i if i == 0 or x.tag in BLOCK else block[x.parent]
    out: list[str] = []
    held: list[str] = []
    last = -1
    for i, kind, text in events:
        if silent[i]:
            continue
        if kind == 2 or block[i] != last:
            if held:
                out.append("".join(held))
            held, last = [], block[i]
        if kind == 0:
            held.append(" ")
        elif kind == 1 and keep[i] >= threshold:
            held.append(_html.unescape(text))
    if held:
        out.append("".join(held))
    return [b for t in out if (b := _SPACE.sub(" ", t).strip())]


def extract(page: str | None, model: Model, threshold: float = 0.5) -> str:
    return "\n".join(blocks_of(page, model, threshold))


def extract_pages(pages: DataFrame, model: Model | None = None, *, threshold: float = 0.5, html_col: str = "html", out: str = "text") -> DataFrame:
    """pages with the main text as column ``out``."""
    prepare_python(pages.sparkSession)
    sent, key = pages.sparkSession.sparkContext.broadcast(model or default_model()), uuid.uuid4().hex

    @F.pandas_udf("string")
    def main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = held(key, lambda: sent.value)
        for htmls in batches:
            yield pd.Series([extract(h, own, threshold) for h in htmls], dtype=object)

    return pages.withColumn(out, main_text(F.col(html_col)))
