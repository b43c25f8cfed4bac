"""Main text of web pages by gradient-boosted trees over DOM nodes and hierarchical decoding.

A forgiving parser builds the element tree, in time linear in the page. Each element gets features: its tag and attribute tokens and those above it (tokens
count by log-odds of main text that are learned for hash buckets; there is no list of good or bad names), depth, link, punctuation and text density of its subtree, and its place and share among its siblings. Boosted trees, trained in numpy
on seeded invented pages of many layouts, give each element log-odds of main text. Decoding walks the tree
bottom up and takes, for every element, the best of keeping its whole subtree, dropping it, or deciding child by child at a
price; so a kept element never lies in a dropped one.

Defined results: null or empty html has empty text; a page without elements keeps its text; scripts, styles, comments, head
and hidden elements never count; repeated rows get equal rows; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache
from html import unescape
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

NAME, GAP, ATTRIBUTE, EQUALS, BARE = map(re.compile, (r"[^\s/>]+", r"[\s/]*", r"=?[^\s/>=]*", r"\s*=\s*", r"[^\s>]*"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template xmp iframe svg".split())
UNSEEN = frozenset("script style noscript template head title meta link iframe svg textarea select option button input".split())
BLOCKS = frozenset("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
#: What an opening tag closes first, and the elements that bound the search for it.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BOUNDS = {("li",): ("ul", "ol", "menu"), ("dt", "dd"): ("dl",), ("tr", "td", "th"): ("table",), ("td", "th"): ("tr", "table"), ("option",): ("select",), ("p",): ("td", "th", "li", "div", "article", "section", "main", "table")}
KINDS = list(BOUNDS)
#: Of a tag: the kinds that it is itself one of (1) or that it bounds (-1).
ROLES = {tag: [(k, 1 if tag in kind else -1) for k, kind in enumerate(KINDS) if tag in kind or tag in BOUNDS[kind]] for tag in {t for k, v in BOUNDS.items() for t in (*k, *v)}}

GROUPS = {"article": "article main", "div": "div section body html", "p": "p", "head": "h1 h2 h3 h4 h5 h6 hgroup", "list": "ul ol li dl dt dd menu", "nav": "nav", "header": "header", "footer": "footer", "aside": "aside dialog", "form": "form fieldset label", "table": "table tbody tr td th thead tfoot", "quote": "blockquote pre figure figcaption code", "link": "a"}
GROUP = {tag: i for i, tags in enumerate(GROUPS.values(), 1) for tag in tags.split()}
TAGS_OF_MAIN, TAGS_AROUND, TAGS_OF_FORMS = (1,), (6, 7, 8, 9), (10,)
#: Attribute tokens fall into so many buckets by hash.
BUCKETS = 1024
MARK = "\ue000"  # begins main text in invented pages


class Node:
    __slots__ = ("tag", "parent", "children", "words", "hidden", "depth", "size", "linked", "marks", "commas", "paragraphs", "own", "main", "at", "index")

    def __init__(self, tag: str, parent: Node | None, words: frozenset = frozenset(), hidden: bool = False) -> None:
        self.tag, self.parent, self.words, self.hidden = tag, parent, words, hidden
        self.children: list[Node | str] = []
        self.depth = parent.depth + 1 if parent else 0
        self.size = self.linked = self.marks = self.commas = self.paragraphs = self.own = self.main = self.at = self.index = 0


class _Open:
    """The elements that are open: a stack, how many of each tag, and for each kind of CLOSES the place of the nearest one that a new tag would close (-1: none)."""

    def __init__(self, root: Node) -> None:
        self.stack, self.tags, self.near = [root], Counter(), [(-1,) * len(KINDS)]

    def push(self, node: Node) -> None:
        near = self.near[-1]
        if roles := ROLES.get(node.tag):
            changed = list(near)
            for k, role in roles:
                changed[k] = len(self.stack) if role > 0 else -1
            near = tuple(changed)
        self.stack.append(node)
        self.near.append(near)
        self.tags[node.tag] += 1

    def cut(self, size: int) -> None:
        """Closes all but the first ``size`` elements."""
        for node in self.stack[size:]:
            self.tags[node.tag] -= 1
        del self.stack[size:], self.near[size:]

    def close(self, tag: str) -> bool:
        """Closes up to the nearest element of a tag, if one is open."""
        if not self.tags[tag]:
            return False
        at = len(self.stack) - 1
        while self.stack[at].tag != tag:
            at -= 1
        self.cut(at)
        return True

    def before(self, tag: str) -> None:
        """Closes what a new tag closes first: a paragraph, if it is a block, and its own kind."""
        for kind in ((("p",) if tag in BLOCKS else ()), CLOSES.get(tag, ())):
            if kind and (at := self.near[-1][KINDS.index(kind)]) > 0:
                while kind != ("p",) and at > 1 and self.stack[at - 1].tag in kind:
                    at -= 1
                self.cut(at)


def _tag_end(html: str, at: int, last: dict[str, int], attributes: list) -> int:
    """Where a tag ends whose name ends at ``at`` (-1: nowhere); ``last``: of each quote, its last place, so that one without an end is a character like others."""
    while True:
        at = GAP.match(html, at).end()
        if at >= len(html):
            return -1
        if html[at] == ">":
            return at + 1
        name = ATTRIBUTE.match(html, at)
        at = name.end()
        value = EQUALS.match(html, at)
        if not value:
            attributes.append((name.group(), ""))
            continue
        at = value.end()
        quote = html[at : at + 1]
        if quote and at < last.get(quote, -1):
            close = html.index(quote, at + 1)
            attributes.append((name.group(), html[at + 1 : close]))
            at = close + 1
        else:
            value = BARE.match(html, at)
            attributes.append((name.group(), value.group()))
            at = value.end()


def parsed(html: str) -> Node:
    """The page's element tree; text is unescaped, never-shown elements are left out.

    One pass whose time grows with the page's length, however its tags nest and its quotes and ends are missing: what a tag closes is looked up,
    and where quotes leave a tag without an end, quotes are plain characters from there on.
    """
    root = Node("html", None)
    open_, at, end = _Open(root), 0, len(html)
    last, last_end = {q: html.rfind(q) for q in "\"'"}, html.rfind(">")
    while at < end:
        here = open_.stack[-1]
        less = html.find("<", at)
        if less != at:
            here.children.append(unescape(html[at : less if less >= 0 else end]))
            at = less if less >= 0 else end
            continue
        if html.startswith("<!--", at):
            close = html.find("-->", at + 4)
            at = close + 3 if close >= 0 else end
            continue
        if html.startswith(("<!", "<?"), at):
            close = html.find(">", at)
            at = close + 1 if close >= 0 else end
            continue
        closing = html.startswith("/", at + 1)
        begin = at + 1 + closing
        if not html[begin : begin + 1].isascii() or not html[begin : begin + 1].isalpha():
            here.children.append("<")
            at += 1
            continue
        if begin > last_end:  # the page's end cuts this tag, unless it is text
            rest = html.find("<", begin)
            if rest >= 0:
                here.children.append(unescape(html[at:rest]))
            at = rest if rest >= 0 else end
            continue
        name, attributes = NAME.match(html, begin), []
        after = _tag_end(html, name.end(), last, attributes)
        if after < 0:
            last, attributes = {}, []
            after = _tag_end(html, name.end(), last, attributes)
        if after < 0:
            here.children.append("<")
            at += 1
            continue
        tag, shut, at = name.group().lower(), html[after - 2] == "/", after
        if closing:
            if not open_.close(tag) and tag == "p":
                here.children.append("\n")
            continue
        if tag in ("html", "body"):
            continue
        open_.before(tag)
        here = open_.stack[-1]
        if tag == "br" or tag == "hr":
            here.children.append("\n")
            continue
        if tag in VOID:
            continue
        words, hidden = _attributes(attributes) if attributes else (frozenset(), False)
        node = Node(tag, here, words, hidden or tag in UNSEEN)
        if tag not in RAW:
            here.children.append(node)
            open_.push(node)
        elif not shut or tag not in ("svg", "iframe"):
            close = _raw_end(tag).search(html, at)
            if not node.hidden:
                node.children.append(unescape(html[at : close.start() if close else end]))
                here.children.append(node)
            at = close.end() if close else end
    return root


@cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?:[\s/][^>]*)?(?:>|\Z)", re.I)


def _attributes(pairs: list) -> tuple[frozenset, bool]:
    words, hidden = set(), False
    for name, value in pairs:
        name = name.lower()
        if name in ("class", "id", "role", "itemprop", "aria-label"):
            words.update(re.findall(r"[a-z]+", value.lower()))
        hidden |= name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.lower().replace(" ", "")
    return frozenset(words), hidden


def ordered(root: Node) -> list[Node]:
    """Shown elements, parents first, with their subtrees' sums filled in."""
    nodes, todo, at = [], [root], 0
    while todo:
        node = todo.pop()
        node.index = len(nodes)
        nodes.append(node)
        node.at = at
        for c in node.children:
            if isinstance(c, str):
                plain = c.replace(MARK, "").strip()
                node.own += len(plain)
                if plain:
                    node.marks += plain.count(".") + plain.count("!") + plain.count("?")
                    node.commas += plain.count(",")
                    node.main += len(plain) if MARK in c else 0
                at += len(plain)
        todo += [c for c in reversed(node.children) if not isinstance(c, str) and not c.hidden]
    for node in reversed(nodes):
        node.size += node.own
        node.paragraphs += node.tag == "p"
        if node.tag == "a":
            node.linked = node.size
        if node.parent:
            for name in ("size", "linked", "marks", "commas", "paragraphs", "main"):
                setattr(node.parent, name, getattr(node.parent, name) + getattr(node, name))
    return nodes


@lru_cache(1 << 16)
def bucket(word: str) -> int:
    return crc32(word.encode()) % BUCKETS


def token_odds(pages: list[list[Node]], usual: float = 8.0) -> np.ndarray:
    """Of each bucket of attribute tokens: log-odds of main text in elements that have one, drawn towards those of all elements by ``usual`` elements."""
    counts = np.zeros((2, BUCKETS))
    whole = np.zeros(2)
    for nodes in pages:
        for node in nodes:
            if node.size:
                kind = int(node.main > 0.5 * node.size)
                whole[kind] += 1
                counts[kind, [bucket(w) for w in node.words]] += 1
    share = whole / max(whole.sum(), 1)
    bad, good = counts + usual * share[:, None] + 1e-6
    return np.where(counts.sum(0) > 0, np.log(good / bad) - np.log((share[1] + 1e-6) / (share[0] + 1e-6)), 0.0)


def features(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """A row of numbers per element; odds: what token_odds() learned."""
    total = max(nodes[0].size, 1)
    above: list[tuple] = []
    families: dict[int, tuple[Counter, int]] = {}  # of each parent: its elements' tags, and how many
    rows = []
    for node in nodes:
        group = GROUP.get(node.tag, 0)
        said = [odds[bucket(w)] for w in node.words]
        flags = (int(group in TAGS_OF_MAIN), int(group in TAGS_AROUND), int(group in TAGS_OF_FORMS), max(said, default=0.0), -min(said, default=0.0))
        over = above[node.parent.index] if node.parent else (0,) * len(flags)
        above.append(tuple(map(max, flags, over)))
        over_index = node.parent.index if node.parent else -1
        if over_index not in families:
            tags = Counter(c.tag for c in node.parent.children if not isinstance(c, str)) if node.parent else Counter([node.tag])
            families[over_index] = tags, tags.total()
        tags, family = families[over_index]
        size = max(node.size, 1)
        rows.append((group, node.depth, math.log1p(node.size), node.linked / size, node.marks / size * 100, node.commas / size * 100, node.own / size, node.paragraphs, size / (node.paragraphs + 1), len(node.children), family, tags[node.tag] / family, node.size / max(node.parent.size if node.parent else total, 1), node.size / total, node.at / total, *flags, *over))
    return np.array(rows, np.float32)


class Trees(NamedTuple):
    """Boosted trees of one depth, as complete binary trees in arrays; base: log-odds without them; tokens: log-odds of attribute tokens."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    base: float
    tokens: np.ndarray


def boosted(rows: np.ndarray, truth: np.ndarray, weight: np.ndarray, tokens: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 24, least: float = 1.0) -> Trees:
    """Logistic gradient boosting on binned features, with Newton leaf values; one histogram over all features and nodes of a level."""
    n, many = rows.shape
    cuts = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(many)]
    there = np.array([[i < len(c) for i in range(bins)] for c in cuts])
    place = np.array([[c[i] if i < len(c) else np.inf for i in range(bins)] for c in cuts], np.float32)
    binned = np.stack([np.searchsorted(c, rows[:, f], "left") for f, c in enumerate(cuts)], 1) + np.arange(many) * bins
    share = float(np.clip((weight * truth).sum() / weight.sum(), 1e-3, 1 - 1e-3))
    base = float(np.log(share / (1 - share)))
    score = np.full(n, base)
    inner, leaves, every = 2**depth - 1, 2**depth, np.arange(n)
    feature, cut, value = np.zeros((rounds, inner), np.int64), np.full((rounds, inner), np.inf, np.float32), np.zeros((rounds, leaves), np.float32)
    for r in range(rounds):
        p = 1 / (1 + np.exp(-score))
        slope, bend = weight * (truth - p), weight * p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            nodes = 2**level
            code = (binned + (at * many * bins)[:, None]).ravel()
            g, h = (np.bincount(code, np.repeat(x, many), nodes * many * bins).reshape(nodes, many, bins).cumsum(2) for x in (slope, bend))
            g_all, h_all = g[..., -1:], h[..., -1:]
            gain = g**2 / (h + least) + (g_all - g) ** 2 / (h_all - h + least) - g_all**2 / (h_all + least)
            gain = np.where(there[None], gain, -1.0).reshape(nodes, -1)
            best = gain.argmax(1)
            good = gain[np.arange(nodes), best] > 1e-6
            f = np.where(good, best // bins, 0)
            c = np.where(good, place.ravel()[best], np.inf).astype(np.float32)
            first = nodes - 1
            feature[r, first : first + nodes], cut[r, first : first + nodes] = f, c
            at = 2 * at + (rows[every, f[at]] > c[at])
        value[r] = rate * np.bincount(at, slope, leaves) / (np.bincount(at, bend, leaves) + least)
        score += value[r, at]
    return Trees(feature, cut, value, base, tokens)


def log_odds(trees: Trees, rows: np.ndarray) -> np.ndarray:
    inner, every = trees.feature.shape[1], np.arange(len(rows))
    out = np.full(len(rows), trees.base)
    for feature, cut, value in zip(trees.feature, trees.cut, trees.value, strict=True):
        at = np.zeros(len(rows), np.int64)
        while len(at) and at[0] < inner:
            at = 2 * at + 1 + (rows[every, feature[at]] > cut[at])
        out += value[at - inner]
    return out


def decoded(nodes: list[Node], odds: np.ndarray, price: float = 2.0) -> np.ndarray:
    """Which elements' own text is kept: the best sum of log-odds, where deciding child by child costs ``price``."""
    n = len(nodes)
    gain = np.clip(odds, -8, 8) * np.array([np.log1p(x.own) + 0.1 * np.log1p(x.size) for x in nodes])
    keep, best, choice = gain.copy(), np.zeros(n), np.zeros(n, np.int8)
    below = np.zeros(n)
    for i in range(n - 1, -1, -1):
        own = gain[i]
        mixed = max(own, 0.0) + below[i] - price
        best[i], choice[i] = max((0.0, 0), (keep[i], 1), (mixed, 2))
        if nodes[i].parent:
            keep[nodes[i].parent.index] += keep[i]
            below[nodes[i].parent.index] += best[i]
    kept = np.zeros(n, bool)
    state = np.zeros(n, np.int8)
    for i, node in enumerate(nodes):
        over = state[node.parent.index] if node.parent else 2
        state[i] = choice[i] if over == 2 else over
        kept[i] = state[i] == 1 or state[i] == 2 and gain[i] > 0
    return kept


def text_of_kept(nodes: list[Node], kept: np.ndarray) -> str:
    """Kept text in page order, blocks joined by one space, white space inside them as one space."""
    parts: list[str] = []
    todo: list[Node | str] = [nodes[0]]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            parts.append(item)
        elif not item.hidden:
            own = kept[item.index]
            inner = [c for c in item.children if not isinstance(c, str) or own or c == "\n"]
            edge = ["\n"] if item.tag in BLOCKS or not own else []
            todo += [*edge, *reversed(inner), *edge]
    return " ".join("".join(parts).split())


def extracted(pages: list[str], trees: Trees) -> list[str]:
    trees_of = [ordered(parsed(p)) for p in pages]
    rows = [features(nodes, trees.tokens) for nodes in trees_of]
    odds = log_odds(trees, np.concatenate(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for nodes in trees_of:
        own = odds[at : at + len(nodes)]
        at += len(nodes)
        out.append(text_of_kept(nodes, np.ones(1, bool) if len(nodes) == 1 else decoded(nodes, own)))
    return out


@cache
def _words(many: int = 4000, seed: int = 5) -> list[str]:
    """Invented words."""
    rng, letters = np.random.default_rng(seed), list("aeiounrstlmdhé")
    return ["".join(rng.choice(letters, n)) for n in rng.integers(1, 10, many)]


def invented(rng: np.random.Generator) -> str:
    """A page of an invented layout, main text marked."""
    word = lambda: _words()[rng.integers(len(_words()))]
    sentence = lambda a=3, b=16: " ".join(word() for _ in range(rng.integers(a, b))).capitalize() + "."
    pick = lambda *x: x[rng.integers(len(x))]
    heading = lambda: sentence(2, 18)[: rng.integers(12, 90)].rstrip(pick(".", " "))
    prose = lambda a=1, b=9: " ".join(sentence() for _ in range(rng.integers(a, b)))
    maybe = lambda share, text: text if rng.random() < share else ""
    link = lambda: f'<a href="/{word()}">{word()}</a>'
    links = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.integers(2, 9))) + "</ul>"

    def named(tags: str, names: str, inner: str) -> str:
        tag = pick(*tags.split())
        attr = f' {pick("class", "id")}="{pick(*names.split())}"' if rng.random() < (0.9 if tag in ("div", "section") else 0.4) else ""
        return f"<{tag}{attr}>{inner}</{tag}>"

    def block() -> str:
        kind = rng.random()
        if kind < 0.7:
            return f"<p>{MARK}{prose()}" + maybe(0.9, "</p>")
        if kind < 0.78:
            return f"<h{pick(2, 3)}>{MARK}{heading()}</h{pick(2, 3)}>"
        if kind < 0.86:
            return f"<p><b>{MARK}{sentence()}<br>"
        if kind < 0.92:
            return "<ul>" + "".join(f"<li>{MARK}{sentence(2, 9)}</li>" for _ in range(rng.integers(2, 6))) + "</ul>"
        return f"<blockquote><p>{MARK}{prose(1, 3)}</p></blockquote>"

    body = f"<h1>{MARK}{heading()}</h1>" + "".join(block() for _ in range(rng.integers(1, 14)))
    advert = lambda: named("div div aside section", "ad ads advert promo sponsored banner", pick(prose(1, 4), f"<p>{prose(1, 3)}</p>"))
    inside = body + maybe(0.15, advert()) + maybe(0.15, named("div section aside", "share social related newsletter", links()))
    shell = rng.random()
    main = f"<article>{inside}</article>" if shell < 0.6 else named("main", "content main", inside) if shell < 0.7 else named("div section", "article content post entry story main-content article-body", inside)
    if rng.random() < 0.2:
        main = f'<div class="{pick("wrap", "page", "container", "row")}">{main}</div>'
    notice = named("div section aside", "cookie-notice consent alert notice popup", pick(f"<p>{prose(1, 3)}</p>", prose(1, 3)) + maybe(0.5, "<button>" + word() + "</button>"))
    comments = named("section div", "comments comment-list discussion reader-comments", "".join(f'<div class="{pick("comment", "reply")}"><p>{prose(1, 4)}</p></div>' for _ in range(rng.integers(1, 6))))
    side = named("aside div", "sidebar related widget", maybe(0.6, f"<h3>{sentence(1, 4)}</h3>") + pick(links(), f"<p>{prose(1, 5)}</p>"))
    form = f'<form class="{pick("search", "subscribe", "login")}"><label>{sentence(1, 6)}</label><input><p>{prose(1, 2)}</p></form>'
    parts = [maybe(0.5, named("header div", "header site-header masthead", pick(sentence(1, 6), f"<h2>{sentence(1, 5)}</h2>"))), maybe(0.85, named("nav nav div", "nav menu navbar", links())), maybe(0.3, notice), maybe(0.5, advert()), maybe(0.15, side), main, maybe(0.35, side), maybe(0.25, advert()), maybe(0.3, comments), maybe(0.25, form), maybe(0.1, notice), maybe(0.85, named("footer footer div", "footer site-footer", pick(f"&copy; {word()}.example &middot; {sentence()}", f"<p>{prose(1, 4)}</p>", links())))]
    return "<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body>" + "".join(parts) + maybe(0.9, "</body></html>")


@cache
def trained(pages: int = 700, seed: int = 17) -> Trees:
    """Trees for elements of invented pages; an element is main text if most of its text is."""
    rng = np.random.default_rng(seed)
    made = [ordered(parsed(invented(rng))) for _ in range(pages)]
    tokens = token_odds(made[: pages // 2])  # the trees see these odds on pages that they weren't learned from, too
    rows, truth, weight = [], [], []
    for nodes in made:
        full = [i for i, n in enumerate(nodes) if n.size]
        rows.append(features(nodes, tokens)[full])
        truth += [nodes[i].main > 0.5 * nodes[i].size for i in full]
        weight += [1.0 if nodes[i].own else 0.3 for i in full]
    return boosted(np.concatenate(rows), np.array(truth, float), np.array(weight), tokens)


def main_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text and n_chars."""
    trees = trained()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            texts = extracted([h or "" for h in batch.column(2).to_pylist()], trees)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    cast = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return cast.mapInArrow(rows, "page_id long, url string, text string, n_chars long")
