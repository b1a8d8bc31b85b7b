"""Main-text extraction from HTML with gradient-boosted trees over DOM nodes.

A tolerant parser builds a tree of block elements and runs of inline text. Boosted trees score every node from the density of
its subtree, its tag and attribute tokens, its depth and its siblings. Decoding is hierarchical: a node that is left out takes
its whole subtree with it, so the chosen labelling is the likeliest in which no kept node lies under a dropped one.

The trees are trained here on pages that a seeded generator lays out in many templates with known roles.
"""

from __future__ import annotations

import html
import random
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import _slices
from .common import ship

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Content of these is markup and never text.
SKIP = frozenset("script style head title noscript template svg iframe object select textarea math canvas audio video datalist".split())
RAW = frozenset("script style title textarea iframe noscript template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var br wbr img button input ruby rt rp meter progress output picture source map area".split())
#: A start tag of the key closes an open element of the values.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody"), "thead": ("caption", "colgroup"),
}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "tfoot": ("table",), "thead": ("table",), "option": ("select",)}
_TAG = re.compile(r"""<(?:!--(?P<c>.*?)(?:-->|\Z)|(?P<d>[!?][^>]*>?)|(?P<e>/?)(?P<n>[A-Za-z][A-Za-z0-9:_-]*)(?P<a>(?:[^"'<>]|"[^"]*"|'[^']*')*+)>|(?P<u>/?[A-Za-z][^<>]*)(?=<|\Z))""", re.S)
_ATTR = re.compile(r"""([a-zA-Z_:][-a-zA-Z0-9_:.]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_SPACE = re.compile(r"\s+")
_TOKEN = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "tokens", "parent", "children", "text", "links", "controls", "order")

    def __init__(self, tag: str, tokens: tuple[str, ...], parent):
        self.tag, self.tokens, self.parent = tag, tokens, parent
        self.children: list[Node] = []
        self.text, self.links, self.controls = "", 0, 0
        if parent is not None:
            parent.children.append(self)


def attribute_tokens(raw: str) -> tuple[str, ...]:
    out: dict[str, None] = {}
    for m in _ATTR.finditer(raw):
        if (k := m[1].lower()) in ("class", "id", "role", "itemprop", "aria-label", "data-role", "data-component"):
            v = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4]
            for t in _TOKEN.findall(_CAMEL.sub(" ", v).lower()):
                out[t] = None
        elif k in ("hidden", "aria-hidden"):
            out["hidden"] = None
    return tuple(out)


def parse(page: str | None) -> Node:
    """The tree of block elements below a root; '#text' leaves hold runs of inline text, blanks already collapsed."""
    root = Node("#root", (), None)
    at_node, parts, links, controls = root, [], 0, 0
    open_tags: list[tuple[str, Node]] = []  # block elements carry their node, inline ones the node around them
    opened: dict[str, int] = defaultdict(int)
    in_link, pos, n = 0, 0, len(page or "")
    page = page or ""

    def flush():
        nonlocal parts, links, controls
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                leaf = Node("#text", (), at_node)
                leaf.text, leaf.links = text, min(links, len(text))
        at_node.controls += controls
        parts, links, controls = [], 0, 0

    def add(raw: str):
        nonlocal links
        text = html.unescape(raw)
        parts.append(text)
        if in_link:
            links += len(text)

    def pop_to(i: int):
        nonlocal at_node, in_link
        for tag, _ in open_tags[i:]:
            in_link -= tag == "a"
            opened[tag] -= 1
        if any(tag not in INLINE for tag, _ in open_tags[i:]):
            flush()
        del open_tags[i:]
        at_node = next((node for tag, node in reversed(open_tags) if tag not in INLINE), root)

    while pos < n:
        lt = page.find("<", pos)
        if lt < 0:
            add(page[pos:])
            break
        if lt > pos:
            add(page[pos:lt])
        m = _TAG.match(page, lt)
        if not m:
            add("<")
            pos = lt + 1
            continue
        pos = m.end()
        name = (m["n"] or "").lower()
        if not name:
            continue
        if m["e"]:
            if name == "br":
                parts.append(" ")
            for i in range(len(open_tags) - 1, -1, -1) if opened[name] else ():
                if open_tags[i][0] == name:
                    pop_to(i)
                    break
                if name in INLINE and open_tags[i][0] not in INLINE:
                    break
            continue
        if name in SKIP:
            if name in RAW:
                end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, pos)
                pos = end.end() if end else n
            elif not m["a"].rstrip().endswith("/"):
                pos = _skip(page, name, pos)
            continue
        if name in INLINE:
            if name == "br":
                parts.append(" ")
            elif name in ("button", "input"):
                controls += 1
            if name == "a" and in_link:
                i = max(k for k, (tag, _) in enumerate(open_tags) if tag == "a")
                del open_tags[i]
                in_link -= 1
                opened["a"] -= 1
            if name not in VOID:
                open_tags.append((name, at_node))
                opened[name] += 1
                in_link += name == "a"
            continue
        for i in range(len(open_tags) - 1, -1, -1):  # a block closes an open paragraph
            tag = open_tags[i][0]
            if tag == "p" or tag in CLOSES.get(name, ()):
                pop_to(i)
                if tag == "p" and name not in CLOSES:
                    break
            elif tag in _SCOPE.get(name, ()) or tag not in INLINE and name not in CLOSES:
                break
        flush()
        if name in VOID:
            continue
        at_node = Node(name, attribute_tokens(m["a"]) if m["a"] else (), at_node)
        open_tags.append((name, at_node))
        opened[name] += 1
        if name == "form":
            at_node.controls += 1
    flush()
    return root


def _skip(page: str, name: str, pos: int) -> int:
    """The end of an element whose content is not text; head also ends where the body begins."""
    ends = rf"</{name}\b[^>]*>" + (r"|(?=<(?:body|article|main|nav|div|p|h1|section)\b)" if name == "head" else "")
    depth, both = 1, re.compile(rf"<{name}\b[^>]*>|{ends}", re.I)
    while m := both.search(page, pos):
        depth += 1 if m[0].startswith(f"<{name}") and not m[0].endswith("/>") else -1
        if m.end() == m.start():
            return m.end()
        pos = m.end()
        if depth == 0:
            return pos
    return len(page)


def nodes_of(root: Node) -> list[Node]:
    """All nodes but the root, parents before children, in page order."""
    out, stack = [], [*reversed(root.children)]
    while stack:
        x = stack.pop()
        x.order = len(out)
        out.append(x)
        stack += reversed(x.children)
    return out


FEATURES = 40
_STOPS = re.compile(r"[.!?,;:]")


def features(nodes: list[Node], odds: dict[str, float]) -> np.ndarray:
    """A row per node, in time linear in the nodes whatever their siblings. odds: log-odds of tags ('<tag') and attribute tokens,
    from training."""
    n = len(nodes)
    if not n:
        return np.zeros((0, FEATURES), dtype=np.float32)
    up, end, tag_of, shape_of, numbers = [-1] * n, [0] * n, [0] * n, [0] * n, []
    depth, own, low, high, attr_low, attr_high = [0] * n, [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n
    kinds: dict[object, int] = {}
    for i, x in enumerate(nodes):
        kids, text = x.children, x.text
        if x.tag == "#text":
            size = len(text)
            numbers.append((size, x.links, 1, size if x.parent.tag == "p" else 0, len(_STOPS.findall(text)), text.count(" ") + 1, "©" in text, x.controls, 0, 0))
        else:
            numbers.append((0, 0, 0, 0, 0, 0, 0, x.controls, len(kids), len(x.tokens)))
        tag_of[i] = kinds.setdefault(x.tag, len(kinds))
        # what repeated blocks have alike: the tag, the first child's tag and whether there are several
        shape_of[i] = kinds.setdefault((x.tag, kids[0].tag if kids else "", min(2, len(kids))), len(kinds))
        o = odds.get("<" + x.tag, 0.0)
        own[i] = o
        if x.tokens:
            known = [odds.get(t, 0.0) for t in x.tokens]
            attr_low[i], attr_high[i] = min(known), max(known)
        if x.parent.parent is not None:
            j = up[i] = x.parent.order
            depth[i] = depth[j] + 1
            low[i], high[i] = min(low[j], o, attr_low[i]), max(high[j], o, attr_high[i])
        else:
            low[i], high[i] = min(0.0, o, attr_low[i]), max(0.0, o, attr_high[i])
    for i in range(n - 1, -1, -1):
        end[i] = max(end[i], i + 1)
        if up[i] >= 0:
            end[up[i]] = max(end[up[i]], end[i])
    at, end, up = np.arange(n), np.array(end), np.array(up)
    leaf = np.array(numbers, dtype=np.float64)
    sums = np.concatenate([np.zeros((1, leaf.shape[1])), np.cumsum(leaf, axis=0)])
    chars, links, runs, paras, stops, words, marks, ctrl = (sums[end, k] - sums[:-1, k] for k in range(8))
    tags, before, total = end - at, sums[:-1, 0], max(1.0, sums[-1, 0])
    text, heading, listed = (np.array([f(x.tag) for x in nodes], dtype=bool) for f in (_is_text, _is_heading, _is_list))
    some, density = np.maximum(chars, 1), links / np.maximum(chars, 1)
    # siblings, one group after the other
    order = np.argsort(up, kind="stable")
    first = np.flatnonzero(np.append(True, up[order][1:] != up[order][:-1]))
    size = np.diff(np.append(first, n))

    def spread(x: np.ndarray) -> np.ndarray:
        """A value per group to its nodes."""
        out = np.empty(n)
        out[order] = np.repeat(x, size)
        return out

    def grouped(x: np.ndarray, f) -> np.ndarray:
        return spread(f.reduceat(x[order], first))

    def alike(x: list[int]) -> np.ndarray:
        _, which, count = np.unique((up + 1) * len(kinds) + np.array(x), return_inverse=True, return_counts=True)
        return count[which]

    k, place = spread(size), np.empty(n)
    place[order] = np.arange(n) - np.repeat(first, size)
    most = grouped(chars, np.maximum)
    largest = grouped(np.where(chars == most, place, n), np.minimum)
    heads = np.cumsum(heading[order]) - heading[order]
    heads_before = np.empty(n)
    heads_before[order] = heads - np.repeat(heads[first], size)
    prev, following = np.full(n, -1.0), np.full(n, -1.0)
    inner = np.flatnonzero(up[order][1:] == up[order][:-1])
    prev[order[inner + 1]] = np.log1p(chars[order[inner]])
    following[order[inner]] = np.log1p(chars[order[inner + 1]])
    above = lambda x: np.where(up >= 0, np.asarray(x)[up], 0.0)
    return np.stack([
        depth, np.log1p(chars), density, np.log(tags), chars / tags, paras / some, stops / some, words / np.maximum(runs, 1),
        own, attr_low, attr_high, low, high, above(own), above(attr_low), above(attr_high),
        place / k, k, chars / np.maximum(grouped(chars, np.add), 1), chars / total, (grouped(density, np.add) - density) / np.maximum(k - 1, 1), alike(tag_of) / k, before / total, text,
        heading, np.minimum(ctrl, 5), listed, prev, following, np.log1p(most), above(density), above(paras / some), (before + chars) / total, text & (marks > 0),
        alike(shape_of) / k, leaf[:, 8], np.sign(place - largest), heads_before, marks, leaf[:, 9],
    ], axis=1).astype(np.float32)


def _is_text(tag: str) -> bool:
    return tag == "#text"


def _is_heading(tag: str) -> bool:
    return tag[0] == "h" and tag[1:].isdigit()


def _is_list(tag: str) -> bool:
    return tag in ("li", "ul", "ol")


class Boosted:
    """Boosted regression trees on logistic loss with histogram splits."""

    def __init__(self, trees: int = 100, depth: int = 4, rate: float = 0.25, bins: int = 48):
        self.trees, self.depth, self.rate, self.bins = trees, depth, rate, bins

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.bins)[1:-1])) for k in range(x.shape[1])]
        b = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], axis=1)
        share = float((w * y).sum() / w.sum())
        self.start = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        score, self.model = np.full(len(y), self.start), []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = w * (y - p), w * p * (1 - p) + 1e-9
            at = np.zeros(len(y), dtype=np.int64)
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, 1 << 30)
            for d in range(self.depth):
                k, base = 2**d, 2**d - 1
                best = np.full(k, 1e-6)
                gs, hs = (np.bincount(at, v, minlength=k) for v in (g, h))
                for j in range(x.shape[1]):
                    cell = at * self.bins + b[:, j]
                    cg, ch = (np.cumsum(np.bincount(cell, v, minlength=k * self.bins).reshape(k, self.bins), axis=1) for v in (g, h))
                    rg, rh = gs[:, None] - cg, hs[:, None] - ch
                    gain = cg**2 / (ch + 1) + rg**2 / (rh + 1) - (gs**2 / (hs + 1))[:, None]
                    gain[(ch < 0.5) | (rh < 0.5)] = 0
                    s = gain.argmax(axis=1)
                    v = gain[np.arange(k), s]
                    for m in np.flatnonzero(v > best):
                        best[m], feature[base + m], cut[base + m] = v[m], j, s[m]
                at = 2 * at + (b[np.arange(len(y)), feature[base + at]] > cut[base + at])
            leaves = self.rate * np.bincount(at, g, minlength=2**self.depth) / (np.bincount(at, h, minlength=2**self.depth) + 1)
            score += leaves[at]
            limit = np.array([self.edges[j][c] if c < len(self.edges[j]) else np.inf for j, c in zip(feature, cut, strict=True)])
            self.model.append((feature, limit, leaves))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Log-odds per row."""
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, limit, leaves in self.model:
            at = np.zeros(len(x), dtype=np.int64)
            for d in range(self.depth):
                k = 2**d - 1 + at
                at = 2 * at + (x[rows, feature[k]] > limit[k])
            out += leaves[at]
        return out


def decode(nodes: list[Node], score: np.ndarray) -> np.ndarray:
    """The likeliest labelling in which everything under a dropped node is dropped. score: log-odds that a node holds main
    text, given that its parent does."""
    below = np.zeros(len(nodes))  # log-likelihood of the best labelling of what lies under a kept node
    keep, drop = -np.logaddexp(0, -score), -np.logaddexp(0, score)
    for x in reversed(nodes):
        if (p := x.parent).parent is not None:
            below[p.order] += max(keep[x.order] + below[x.order], drop[x.order])
    chosen = keep + below > drop
    for x in nodes:
        if x.parent.parent is not None and not chosen[x.parent.order]:
            chosen[x.order] = False
    return chosen


class Extractor:
    """Token log-odds and trees."""

    def __init__(self, pages: int = 2400, seed: int = 11):
        made = [generate(random.Random(seed * 100_003 + i)) for i in range(pages)]
        parsed = [(parse(p), kept) for p, kept in made]
        counts: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
        rows, all_nodes = [], []
        for root, kept in parsed:
            nodes = nodes_of(root)
            y = np.zeros(len(nodes), dtype=bool)
            for x in reversed(nodes):
                if x.tag == "#text":
                    y[x.order] = x.text.split(" ", 1)[0][:1] == MARK
                if y[x.order] and x.parent.parent is not None:
                    y[x.parent.order] = True
            for x in nodes:
                if x.tag == "#text":
                    x.text = x.text.replace(MARK, "")
                for t in ("<" + x.tag, *x.tokens):
                    counts[t][int(y[x.order])] += 1
            rows.append(y)
            all_nodes.append(nodes)
        self.odds = {t: float(np.clip(np.log((b + 0.5) / (a + 0.5)), -4, 4)) for t, (a, b) in counts.items() if a + b >= 8}
        x = np.concatenate([features(nodes, self.odds) for nodes in all_nodes])
        y = np.concatenate(rows)
        # a node counts only where its parent holds main text, as decoding asks for nothing else
        asked = np.concatenate([[z.parent.parent is None or bool(own[z.parent.order]) for z in nodes] for nodes, own in zip(all_nodes, rows, strict=True)])
        self.trees = Boosted().fit(x[asked], y[asked].astype(float), np.ones(int(asked.sum())))

    def __call__(self, pages: list[str | None]) -> list[str]:
        all_nodes = [nodes_of(parse(p)) for p in pages]
        x = np.concatenate([np.zeros((0, FEATURES), np.float32), *(features(nodes, self.odds) for nodes in all_nodes)])
        score, at, out = self.trees.predict(x), 0, []
        for nodes in all_nodes:
            chosen = decode(nodes, score[at : at + len(nodes)])
            at += len(nodes)
            out.append("\n".join(x.text for x in nodes if x.tag == "#text" and chosen[x.order]))
        return out


#: Marks main text in generated pages (a private-use character); it is taken out again before features are made.
MARK = "\ue000"


def _words(r: random.Random, lo: int, hi: int, mark: bool = False) -> str:
    out = ["".join(r.choice("aeiounrstlhdmcé") for _ in range(r.randint(1, 9))) for _ in range(r.randint(lo, hi))]
    for i in range(r.randint(4, 12), len(out), r.randint(5, 14)):
        out[i] += r.choice([".", ",", ".", "!", " |"])
    text = " ".join(out).capitalize() + r.choice([".", ".", "", "!"])
    if r.random() < 0.06:
        text = " ".join(w.upper() + "!!" for w in text.split())
    return MARK + text if mark else text


def generate(r: random.Random) -> tuple[str, None]:
    """A page with main text marked. Templates differ in the elements and names that carry each role."""

    def pick(*x):
        return r.choice(x)

    def attr(*names):
        k = r.random()
        name = pick(*names)
        if r.random() < 0.3:
            name += pick("-", "_", " ") + pick("wrap", "box", "inner", "block", "container", "area", "x1")
        return f' class="{name}"' if k < 0.6 else f' id="{name}"' if k < 0.85 else f" class='{pick('c1', 'x', 'row')} {name}'"

    def link(lo=1, hi=3):
        return f'<a href="/{_words(r, 1, 1)}">{_words(r, lo, hi)}</a>'

    def links(k):
        return "<ul>" + "".join(f"<li>{link()}" + pick("</li>", "") for _ in range(k)) + "</ul>" if r.random() < 0.7 else pick(" | ", " ").join(link() for _ in range(k))

    def named(tag, *names):
        """An element of that tag, or a div with such a name, or one whose name says nothing or that has none."""
        if bare:
            return "div", strange()
        return (tag, attr(*names) if r.random() < 0.3 else "") if tag and r.random() < 0.6 else (pick("div", "div", "section"), attr(*names))

    def strange():
        """No name, or an invented one."""
        return "" if r.random() < 0.6 else f' class="{"".join(r.choice("bcdfgklmnprstvz") + r.choice("aeiou") for _ in range(r.randint(2, 4)))}"'

    def wrap(tag_attr, body):
        return f"<{tag_attr[0]}{tag_attr[1]}>{body}</{tag_attr[0]}>"

    def prose(mark, k):
        out = []
        for _ in range(k):
            z = r.random()
            t = _words(r, *pick((1, 3), (3, 12), (10, 60), (30, 140), (60, 300), (100, 700) if k < 9 else (20, 90)), mark)
            if r.random() < 0.12:
                t = t + f' <a href="#">{_words(r, 1, 3)}</a> ' + _words(r, 1, 20)
            if z < 0.72:
                out.append(pick(f"<p>{t}</p>", f"<p>{t}</p>", f"<p>{t}", f"<p><b>{t}<br>", f"<p><em>{t}</em></p>"))
            elif z < 0.8:
                out.append(f"<{(h := pick('h2', 'h3'))}>{_words(r, 1, 7, mark)}</{h}>")
            elif z < 0.87:
                out.append("<ul>" + "".join(f"<li>{_words(r, 1, 20, mark)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif z < 0.92:
                out.append(f"<blockquote>{t}</blockquote>")
            elif z < 0.96:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{_words(r, 1, 3, mark)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>")
            else:
                out.append(f"<div>{t}</div>")
        return out

    def advert():
        return wrap(pick(("div", attr("ad", "ads", "advert", "advertisement", "banner", "sponsor", "promo")), ("aside", attr("ad", "promo", "sponsored"))), pick(_words(r, 1, 30), f"<p>{_words(r, 2, 30)}</p>", link(2, 6)))

    def notice():
        return wrap(("div", attr("cookie", "notice", "consent", "alert", "gdpr", "banner", "cookie-notice", "newsletter", "subscribe", "paywall", "modal")), pick(f"<p>{_words(r, 4, 50)}</p><button>ok</button>", _words(r, 3, 40), f"<p>{_words(r, 4, 40)} {link()}</p>"))

    def form():
        return f"<form{attr('search', 'login', 'signup', 'newsletter') if r.random() < 0.5 else ''}>" + pick(f"<label>{_words(r, 1, 4)}</label><input>", f"<p>{_words(r, 2, 25)}</p><input><button>{_words(r, 1, 2)}</button>", f"{_words(r, 2, 12)}<input>") + "</form>"

    def comments():
        odd = r.random() < (0.7 if bare else 0.5)
        if odd:  # known by their form alone: blocks alike, each with a name and a time or the like before its words
            tag, by = pick("div", "div", "li", "section"), pick("b", "strong", "cite", "span", "i", "a href=x")
            inner = strange() if r.random() < 0.5 else ""
            said = lambda: "".join(f"<p>{_words(r, 2, 80)}</p>" for _ in range(r.choice([1, 1, 1, 2])))
            each = [f"<{tag}{inner}>" + pick(f"<{by}>{_words(r, 1, 2)}</{by.split()[0]}>", f"<p><{by}>{_words(r, 1, 2)}</{by.split()[0]}></p>", f"<h4>{_words(r, 1, 2)}</h4>") + said() + pick("", link(1, 1)) + f"</{tag}>" for _ in range(r.randint(2, 7))]
            head = f"<{(h := pick('h2', 'h3', 'h4'))}>{_words(r, 1, 3)}</{h}>" if r.random() < 0.7 else ""
            return wrap((pick("section", "div", "div", "ul") if tag != "li" else pick("ul", "ol"), strange()), head + "".join(each))
        each = [
            wrap((pick("li", "div", "article"), attr("comment", "reply", "comment-body", "response")), pick(f"<b>{_words(r, 1, 2)}</b>", link(), f"<cite>{_words(r, 1, 2)}</cite>", "") + "".join(f"<p>{_words(r, 2, 80)}</p>" for _ in range(r.randint(1, 2))))
            if r.random() < 0.7
            else f"<p>{_words(r, 2, 60)}</p>"
            for _ in range(r.randint(1, 7))
        ]
        head = f"<h3>{_words(r, 1, 3)}</h3>" if r.random() < 0.6 else ""
        return wrap((pick("section", "div", "div", "ol"), attr("comments", "comment-list", "discussion", "responses", "disqus", "replies", "reader-comments")), head + "".join(each))

    def side():
        body = pick(links(r.randint(2, 7)), f"<h3>{_words(r, 1, 3)}</h3>{links(3)}", f"<p>{_words(r, 5, 70)}</p>", f"<h4>{_words(r, 1, 3)}</h4><p>{_words(r, 4, 60)}</p>{link()}")
        return wrap(named("aside", "sidebar", "related", "widget", "side", "aside", "trending", "popular", "more", "recommended", "share", "social", "tags", "author-bio", "breadcrumbs"), body)

    def nav():
        return wrap(named("nav", "nav", "menu", "navbar", "navigation", "topnav", "breadcrumb", "main-menu"), links(r.randint(2, 9)))

    def header():
        return wrap(named("header", "header", "masthead", "site-header", "top", "topbar", "branding", "page-header"), pick(link(), _words(r, 1, 8), f"<h2>{_words(r, 1, 4)}</h2>{nav()}", f"<p>{_words(r, 2, 20)}</p>", f"<div>{_words(r, 1, 6)}</div>" + nav()))

    def footer():
        body = pick("&copy; " + _words(r, 1, 2) + " &middot; " + _words(r, 1, 40), f"<p>&copy; {_words(r, 1, 20)}</p>", links(4) + _words(r, 2, 30), f"<p>{_words(r, 5, 60)}</p>")
        return wrap(named("footer", "footer", "foot", "bottom", "copyright", "site-footer", "legal", "colophon"), body)

    lone, bare = r.random() < 0.06, r.random() < 0.2
    body = prose(True, r.choice([1, 1, 2, 3, 5, 8, 12, 20, 40]) if not lone else r.randint(1, 3))
    if r.random() < 0.8:
        title = r.random()
        if title < 0.06 and not lone:  # a header's title goes with the header, as its other lines do
            body.insert(0, f"<header>{pick('', f'<p>{_words(r, 1, 4)}</p>')}<h1>{_words(r, 1, 12)}</h1>{pick('', f'<p>{_words(r, 2, 9)}</p>', f'<div>{_words(r, 2, 9)}</div>')}</header>")
        else:
            body.insert(0, f"<h1>{_words(r, 1, 12, True)}</h1>")
    for make, chance in ((advert, 0.25), (side, 0.15), (form, 0.08), (notice, 0.08)):
        if r.random() < chance:
            body.insert(r.randint(1, len(body)), make())
    if r.random() < 0.12:
        body.append(comments())
    if lone:
        return "".join(body) if r.random() < 0.5 else f"<html><body>{''.join(body)}</body></html>", None
    kind = r.random()
    shell = ("div", strange()) if bare else ("article", "") if kind < 0.5 else ("article", attr("post", "story", "entry", "article")) if kind < 0.62 else ("main", "") if kind < 0.7 else ("div", attr("content", "article", "post", "entry-content", "story", "article-body", "main", "text", "post-content")) if kind < 0.94 else ("body", None)
    if len(body) > 2 and r.random() < 0.08:  # in parts
        part = (pick("section", "section", "div"), strange() if r.random() < 0.4 else "")
        ends = sorted({len(body), *(r.randrange(1, len(body)) for _ in range(r.randint(1, 3)))})
        body = [wrap(part, "".join(body[a:b])) for a, b in zip([0, *ends], ends)]
    main = "".join(body) if shell[1] is None else wrap(shell, "".join(body))
    if shell[1] is not None and r.random() < 0.25:
        main = wrap(pick(("main", ""), ("div", attr("wrapper", "page", "container", "layout")), ("section", "")), main + (side() if r.random() < 0.3 else "") + (comments() if r.random() < 0.3 else ""))
    while shell[1] is not None and r.random() < 0.2:  # wrappers of layout alone
        main = wrap(("div", pick("", attr("row", "col", "inner", "grid", "columns", "wrap"))), main)
    before = [f() for f, c in ((header, 0.4), (nav, 0.75), (notice, 0.3), (advert, 0.45), (form, 0.2), (side, 0.2)) if r.random() < c]
    after = [f() for f, c in ((advert, 0.2), (side, 0.35), (comments, 0.45), (form, 0.2), (notice, 0.15), (nav, 0.15)) if r.random() < c]
    r.shuffle(before)
    r.shuffle(after)
    if r.random() < 0.8:
        after.append(footer())
    if shell[1] is not None and r.random() < (0.35 if bare else 0.04):  # laid out as a table
        cells = [f"<td>{x}</td>" for x in ("".join(before[1:2]), main, "".join(after[:1])) if x]
        rows = [*(f"<tr><td>{x}</td></tr>" for x in before[:1]), f"<tr>{''.join(cells)}</tr>", *(f"<tr><td>{x}</td></tr>" for x in [*before[2:], *after[1:]])]
        page = f"<table>{''.join(rows)}</table>"
    else:
        page = "".join([*before, main, *after])
    if r.random() < 0.15:
        page = wrap(("div", attr("page", "wrapper", "site", "container")), page)
    return f"<!DOCTYPE html><html><head><title>{_words(r, 1, 6)}</title><script>x()</script></head><body>{page}" + pick("</body></html>", ""), None


_fitted: dict[int, Extractor] = {}


def extractor(seed: int = 11) -> Extractor:
    if seed not in _fitted:
        _fitted[seed] = Extractor(seed=seed)
    return _fitted[seed]


def extract(df: DataFrame, page: str = "html", output: str = "text", seed: int = 11) -> DataFrame:
    """Adds `output`: the main text of each row's whole page. A header element is left out wherever it stands, with a title in
    it; a title outside of one belongs to the article. Character references are decoded, white space within a block is
    one space, blocks are joined by one line end in page order; an empty string for a null or empty page and where nothing is
    main text. Rows are independent; a column named `output` is replaced, others pass through."""
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(extractor(seed))  # some ten thousand numbers
    keep = [c for c in df.columns if c != output]
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(output, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for b in _slices(whole, page, 1_000_000):
                text = pa.array(model(b.column(page).to_pylist()), pa.string())
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], text], names=[*keep, output])

    return df.mapInArrow(run, schema)
