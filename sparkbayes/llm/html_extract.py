"""Main text of web pages by a maximum-scoring subsequence (operator 3).

A page is read once as a sequence of tags and texts. A word scores by the elements it stands in: the weights of their
tokens, which are tag names, roles and the parts of class names and ids; what speaks for it is capped, what speaks
against it isn't. A tag scores below zero. One linear scan finds the contiguous region of highest total.

The weights are learned: pages that mark their own article are the labelled ones, words the mark encloses are content
and the others are not. A logistic regression on the tokens around the words, each page counting alike, is drawn
towards prior weights (what names of menus, notices and the like usually mean; empty ones do, too), and a tag's
penalty comes from how much more often it stands outside. The marks themselves, being the labels, have a fixed weight.

An element whose tokens bring the words in it below zero is one piece to the scan, scored as a single tag, and its words
are left out. Tokens that speak against an element don't count where it encloses an article that is marked
or more than half of the page's words (inside a marked article: of that one's); such an element's words then score less, and its two
tags cost more. Reader comments and sidebars are often longer than the article, so their size excuses them only where
hardly any words lie outside of all such elements. So do tags by which a marked article is entered or left. Names like has-sidebar say what an
element has and count for nothing. Such an element that is never closed ends before the next article or main element,
else at its own next block; a raw element (select, svg, ...; not script) that is never closed ends at the next block.

Texts of the region are decoded and their white space (a line break tag counts as such) becomes single blanks;
blocks are joined by one line end.

Defined cases: null html is empty; a page without content has an empty text; a page of any length is read whole, in
time that grows with its length; a tag that is never closed ends before the next one or with the page, and so does an
open quote in it; equal pages get equal texts, ties between regions go to the first; an empty table gives an empty
table; without a labelled page prior weights are used; a column named like the result is replaced, other columns pass through.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import at_end, held, ready, slices

NAME = re.compile(r"[A-Za-z][^\s/><]*")
STOP = re.compile(r"[>\"']|<(?=[A-Za-z/!])")
OPENING = re.compile(r"<(?=[A-Za-z/!])")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "template", "svg", "math", "object", "canvas", "select", "head", "audio", "video"}
BLOCKS = {
    "address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hgroup", "hr", "html", "legend", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul",
}
NEXT_BLOCK = re.compile(rf"</?(?:{'|'.join(sorted(BLOCKS))})\b", re.I)
ARTICLE = re.compile(r"<(?:article|main)\b", re.I)
BLOCK = re.compile(r"<(?:div|p|section|h[1-6])\b", re.I)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var"}
ENDED = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}  # end where the next of their kind begins
PLAIN = {"html", "body"}
ROLES = ["navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"]
#: Parts of class names and ids that name something beside the article, and ones that do where no other part names the article.
HARD = [
    "ad", "ads", "adsense", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "notice", "notices", "gdpr", "popup",
    "modal", "overlay", "newsletter", "subscribe", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "widget", "related", "share", "sharing", "social", "comment",
    "comments", "commentlist", "disqus", "respond", "login", "pagination", "pager",
]
SOFT = ["header", "footer", "banner", "masthead", "topbar"]
OWN = ["article", "post", "entry", "content", "story", "main", "body", "text"]
#: What reader comments as a whole are called, or asides are, and names that what encloses an article may have, too; a
#: hundredth or an eighth of an element's words outside of all that tokens speak against is then enough for an article.
ASIDE = {**dict.fromkeys([".comments", ".commentlist", ".disqus", ".respond", "aside", "@complementary"], 100), **dict.fromkeys([".comment", ".sidebar"], 8)}
#: First parts of names that say what an element has or lacks, not what it is.
HAVING = {"has", "have", "having", "with", "without", "no", "not", "hide", "show"}
#: Weights before any page is seen: tags as they are, roles behind @, parts of names behind a point, hidden elements.
PRIOR_TOKENS = {
    **dict.fromkeys(["nav", "#hidden"], -8.0), **dict.fromkeys(["footer", "aside", "form", "button", "dialog", "menu", "fieldset"], -6.0), "header": -3.0, "a": -1.2,
    **{f"@{x}": -6.0 for x in ROLES}, **{f".{x}": -6.0 for x in HARD}, **{f".{x}": -3.0 for x in SOFT}, **{f".{x}": 2.5 for x in OWN},
}
MARKED = 4.0  # in an element that marks the article
MOST = 5.0  # that can speak for a word
LOW = 0.25  # of a word's score, in an element that something speaks against
SPOKEN = 2.5  # against an element, that its words aren't taken for an article's
ENTERED = -8.0  # a tag by which a marked article is entered or left
NAMED = 5.0  # by how much more a tag costs for what speaks against its element
PRIOR = {"word": 1.0, "link": -0.2, "tag": -0.05}


def attributes(text: str) -> dict[str, str]:
    return {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(text)} if text.strip() else {}


def parts(value: str) -> set[str]:
    return {x.lower() for x in re.split(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])", value) if x}


def marks(name: str, given: dict[str, str]) -> bool:
    """Whether an element says that it is the article."""
    return name in ("article", "main") or given.get("role") in ("main", "article") or "articlebody" in given.get("itemprop", "").lower()


def tokens(name: str, given: dict[str, str]) -> tuple[str, ...]:
    """An element's tokens, the tag's name first."""
    out = {}
    if given:
        if "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "").lower():
            out["#hidden"] = None
        if given.get("role"):
            out[f"@{given['role']}"] = None
        if name not in PLAIN:
            for whole in f"{given.get('class', '')} {given.get('id', '')}".split():
                now = parts(whole)
                first = re.match(r"[A-Za-z][a-z]*", whole)
                if not (first and len(now) > 1 and first[0].lower() in HAVING):
                    out |= {f".{x}": None for x in sorted(now)}
    return (name, *out)


@dataclass
class Event:
    """A text (name is empty) or a tag, and where it ends; of one that opens an element also its tokens and whether it marks the article."""

    name: str
    close: bool
    text: str
    end: int
    said: tuple[str, ...] = ()
    mark: bool = False


class Raws:
    """Where the raw elements of a page end."""

    def __init__(self, page: str):
        self.page, self.found = page, {}

    def end(self, name: str, at: int) -> int | None:
        """The end of one that opened before ``at``; None for a head that is never closed, as what follows is read."""
        if name not in self.found:
            tags = [(m.start(), bool(m[1])) for m in re.finditer(rf"<(/?){name}(?=[\s/>]|$)", self.page, re.I)]
            self.found[name] = [x for x, closes in tags if closes], [x for x, closes in tags if not closes]
        ends, opened = self.found[name]
        i = bisect_left(ends, at)
        start, closed = (ends[i], True) if i < len(ends) else (len(self.page), False)
        end = self.page.find(">", start) + 1 or len(self.page)
        if name == "script":
            return end
        block = NEXT_BLOCK.search(self.page, at, start)
        # An end with another opening before it, behind a block, is that one's.
        if closed and (block is None or bisect_left(opened, block.start()) == bisect_left(opened, start)):
            return end
        return None if name == "head" else block.start() if block else len(self.page)


def events(page: str) -> list[Event]:
    """A page's texts and tags in one pass that never looks back; what raw elements hold is left out."""
    out: list[Event] = []
    size, raws, at, said = len(page), Raws(page), 0, 0
    ahead = {'"': 0, "'": 0, "<": 0}  # the next one of each, kept while it lies ahead

    def following(what: str, start: int) -> int:
        if ahead[what] < start:
            m = OPENING.search(page, start) if what == "<" else None
            found = (m.start() if m else -1) if what == "<" else page.find(what, start)
            ahead[what] = found if found >= 0 else size
        return ahead[what]

    def tag_end(start: int) -> tuple[int, int]:
        """(where the attributes end, where the tag ends)."""
        p = start
        while (n := STOP.search(page, p)) is not None:
            if n[0] == ">":
                return n.start(), n.end()
            if n[0] == "<":
                return n.start(), n.start()
            p = n.end()
            if page[start : n.start()].rstrip()[-1:] == "=" if n.start() - start < 200 else page[n.start() - 100 : n.start()].rstrip()[-1:] == "=":
                q = following(n[0], p)
                # A quote that another tag begins in is one only if something fit to follow a value follows it.
                if q < size and (q < following("<", p) or page[q + 1 : q + 2] in (" ", ">", "/", "\n", "\t", "\r")):
                    p = q + 1
        return size, size

    while (i := page.find("<", at)) >= 0:
        c = page[i + 1 : i + 2]
        m = NAME.match(page, i + 2 if c == "/" else i + 1)
        if m is None and c not in ("!", "?", "/"):
            at = i + 1
            continue
        if i > said:
            out.append(Event("", False, page[said:i], i))
        if m is None:
            end = page.find("-->", i + 2) if page.startswith("<!--", i) else page.find(">", i)
            at = said = size if end < 0 else end + (3 if page.startswith("<!--", i) else 1)
            continue
        name, close = m[0].lower(), c == "/"
        stop, at = tag_end(m.end())
        given = page[m.end() : stop]
        empty = given.endswith("/")
        if not close and name in RAW and not empty and (end := raws.end(name, at)) is not None:
            at = end
        if close or empty or name in RAW or name in VOID:
            out.append(Event(name, close, given, at))
        else:
            own = attributes(given)
            out.append(Event(name, close, given, at, tokens(name, own), marks(name, own)))
        said = at
    if said < size:
        out.append(Event("", False, page[said:], size))
    return out


@dataclass
class Outline:
    """What elements hold, by the place of their opening tags among the events; words are those outside raw elements."""

    ends: dict[int, int] = field(default_factory=dict)  # the place of the closing tag
    words: dict[int, int] = field(default_factory=dict)
    marks: dict[int, int] = field(default_factory=dict)
    total: int = 0
    clean: int = 0  # words outside of all elements that tokens speak against


def outline(seen: list[Event], weights: Weights) -> Outline:
    opened: dict[str, list[tuple[int, int, int, bool]]] = defaultdict(list)
    out, marked, against = Outline(), 0, 0
    for i, e in enumerate(seen):
        if not e.name:
            n = len(e.text.split())
            out.total += n
            out.clean += 0 if against else n
        elif e.close:
            if opened[e.name]:
                start, words, before, low = opened[e.name].pop()
                against -= low
                out.ends[start], out.words[start], out.marks[start] = i, out.total - words, marked - before
        elif e.said:
            low = weights.against(e.said[1:] if e.name in INLINE else e.said) >= SPOKEN
            opened[e.name].append((i, out.total, marked, low))
            against += low
            marked += e.mark and not weights.against(e.said[1:])
    return out


@dataclass
class Weights:
    by_kind: dict[str, float] = field(default_factory=lambda: dict(PRIOR))
    tokens: dict[str, float] = field(default_factory=lambda: dict(PRIOR_TOKENS))

    def of(self, p: Piece) -> float:
        if p.text:
            return (self.by_kind.get(p.kind, PRIOR["word"]) if p.score is None else p.score) * len(p.text.split())
        return p.score if p.score is not None else self.by_kind.get(p.kind, -0.5 if p.kind.startswith("beside:") else PRIOR["tag"])

    def against(self, said: tuple[str, ...]) -> float:
        """How much tokens speak against an element (at least zero)."""
        return -sum(w for t in said if (w := self.tokens.get(t, 0.0)) < 0)


@dataclass
class Piece:
    kind: str  # word, link, or a tag's name
    text: str = ""
    block: bool = False
    score: float | None = None


@dataclass
class Open:
    """An element around what is read."""

    name: str
    mark: bool = False
    up: float = 0.0  # what speaks for it
    down: float = 0.0  # against it
    inline: float = 0.0  # against its words only
    low: bool = False
    cost: float = 0.0
    words: int = 0
    said: tuple[str, ...] = ()


DEEP = 400  # open elements that a closing tag looks back over


class Stack(list):
    """The open elements, with sums over them."""

    def __init__(self) -> None:
        super().__init__()
        self.up = self.down = self.inline = 0.0
        self.low = self.links = 0
        self.marked: list[Open] = []

    def push(self, x: Open) -> None:
        self.append(x)
        self.count(x, 1)
        if x.mark:
            self.marked.append(x)

    def count(self, x: Open, n: int) -> None:
        self.up += n * x.up
        self.down += n * x.down
        self.inline += n * x.inline
        self.low += n * x.low
        self.links += n * (x.name == "a")

    def cut(self, k: int) -> list[Open]:
        gone = self[k:]
        del self[k:]
        for x in gone:
            self.count(x, -1)
            if x.mark:
                self.marked.pop()
        return gone

    def close(self, name: str) -> list[Open]:
        """What a closing tag ends."""
        for k in range(len(self) - 1, max(-1, len(self) - DEEP), -1):
            if self[k].name == name:
                return self.cut(k)
        return []

    def before(self, name: str) -> None:
        """End what the opening of ``name`` ends without a tag: a paragraph before a block, an item before the next one."""
        if name in BLOCKS or name in ENDED:
            k = len(self) - 1
            while k >= 0 and self[k].name in INLINE and len(self) - k < DEEP:
                k -= 1
            if k >= 0 and (self[k].name == "p" or self[k].name == name and name in ENDED):
                self.cut(k)


def pieces(page: str, weights: Weights) -> list[Piece]:
    """A page's tags and texts with their scores; an element that its tokens bring below zero is one piece."""
    seen = events(page)
    held_ = outline(seen, weights)
    out: list[Piece] = []
    stack = Stack()
    base, weight = weights.by_kind["word"], weights.tokens.get
    ahead = {ARTICLE: -1, BLOCK: -1}  # the next one of each, kept while it lies ahead

    def following(what: re.Pattern, at: int) -> int:
        if ahead[what] < at:
            m = what.search(page, at)
            ahead[what] = m.start() if m else len(page)
        return ahead[what]

    i = 0
    while i < len(seen):
        e, here = seen[i], i
        i += 1
        if not e.name:
            score = min(MOST, base + stack.up) - stack.down - stack.inline
            if stack.low and score > 0:
                score *= LOW
            out.append(Piece("link" if stack.links else "word", e.text, score=max(-4.0, min(MOST, score))))
            continue
        if e.close:
            cost = min([x.cost for x in stack.close(e.name) if x.cost], default=None)
            out.append(Piece(e.name, block=e.name in BLOCKS, score=cost))
            continue
        if not e.said:
            out.append(Piece(e.name, block=e.name in BLOCKS))
            continue
        stack.before(e.name)
        around = stack.marked[-1] if stack.marked else None
        up = (MARKED if e.mark else 0.0) + sum(w for t in e.said if (w := weight(t, 0.0)) > 0)
        inline = weights.against(e.said[:1]) if e.name in INLINE else 0.0
        down = weights.against(e.said) - inline
        low, cost = False, 0.0
        if down and min(MOST, base + up + stack.up) - down - stack.down < -1e-9:
            words = held_.words.get(here, 0)
            most = 2 * words > (held_.total if around is None else around.words)
            apart = max((ASIDE.get(t, 0) for t in e.said), default=0)
            aside = apart * held_.clean > words
            bare = not aside and 2 * words > held_.total and (weights.against(e.said[1:]) or e.name in ("form", "fieldset"))
            if bare or not (aside and apart == 100) and (held_.marks.get(here) or e.mark and e.said[1:]) and (around is None or most):
                low, cost, down = not e.mark and e.name not in ("form", "fieldset"), -NAMED * down, 0.0
            elif (end := held_.ends.get(here)) is not None:
                i = end + 1
            else:  # never closed
                stop = following(ARTICLE, e.end)
                if stop == len(page) and e.name != "footer":
                    stop = following(BLOCK, e.end)
                while i < len(seen) and seen[i].end <= stop:
                    i += 1
            if down:
                out.append(Piece(f"beside:{e.name}", block=True))
                continue
        if e.mark and around is None:
            cost += ENTERED
        stack.push(Open(e.name, e.mark, up, down, inline, low, cost, held_.words.get(here, 0)))
        out.append(Piece(e.name, block=e.name in BLOCKS, score=cost or None))
    return out


def region(found: list[Piece], weights: Weights) -> tuple[int, int]:
    """The slice of highest total score; empty if nothing scores above zero."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, p in enumerate(found):
        if total <= 0:
            total, start = 0.0, i
        total += weights.of(p)
        if total > best:
            best, span = total, (start, i + 1)
    return span


def text_of(found: list[Piece]) -> str:
    blocks, now = [], []
    for p in found:
        if p.text:
            now.append(html.unescape(p.text))
        elif p.block or p.kind in ("br", "td", "th"):
            now.append(" " if not p.block else "\n")
            if p.block:
                blocks.append("".join(now))
                now = []
    blocks.append("".join(now))
    return "\n".join(x for b in blocks if (x := " ".join(b.split())))


def extract(page: str | None, weights: Weights) -> str:
    found = pieces(page or "", weights)
    lo, hi = region(found, weights)
    return text_of(found[lo:hi])


def counted(page: str) -> tuple[dict[tuple[str, ...], list[int]], dict[str, list[int]]] | None:
    """Words outside and inside of what a page marks as its article, by the tokens around them, and its tags likewise; None if it marks none."""
    words: dict[tuple[str, ...], list[int]] = defaultdict(lambda: [0, 0])
    tags: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    stack, any_mark = Stack(), False
    for e in events(page):
        inside = bool(stack.marked)
        if not e.name:
            around = tuple(sorted({t for x in stack[-DEEP:] for t in x.said}))
            words[around][inside] += len(e.text.split())
            continue
        tags[e.name][inside] += 1
        if e.close:
            stack.close(e.name)
        elif e.said:
            stack.before(e.name)
            any_mark = any_mark or e.mark
            # The marks are the labels, so neither they nor what they are called tell anything.
            stack.push(Open(e.name, e.mark, said=() if e.mark or e.name in PLAIN else e.said))
    return (words, tags) if any_mark else None


def fit(examples: list[tuple[tuple[str, ...], float, float]], prior: dict[str, float], *, ridge: float = 0.5, turns: int = 400) -> tuple[float, dict[str, float]]:
    """(constant, weights) of (tokens, weight outside, weight inside) examples: logistic regression drawn towards ``prior``."""
    names = sorted({t for e in examples for t in e[0]})
    number = {t: i for i, t in enumerate(names)}
    which = np.array([k for k, e in enumerate(examples) for _ in e[0]], dtype=np.int64)
    what = np.array([number[t] for e in examples for t in e[0]], dtype=np.int64)
    outside, inside = np.array([e[1] for e in examples]), np.array([e[2] for e in examples])
    start = np.array([prior.get(t, 0.0) for t in names] + [PRIOR["word"]])
    # Containers that say nothing by themselves are held closer.
    pull = np.array([10 * ridge if t in ("div", "section", "span") else ridge for t in names] + [ridge])
    w = start.copy()
    n = outside + inside
    curve = pull + 0.25 * np.append(np.bincount(what, n[which] * np.bincount(which, minlength=len(n))[which], minlength=len(names)), (n * (1 + np.bincount(which, minlength=len(n)))).sum())
    for _ in range(turns):
        z = w[-1] + np.bincount(which, w[what], minlength=len(n))
        slope = n / (1 + np.exp(-np.clip(z, -30, 30))) - inside
        w -= (np.append(np.bincount(what, slope[which], minlength=len(names)), slope.sum()) + pull * (w - start)) / curve
    return float(w[-1]), dict(zip(names, w[:-1].tolist(), strict=True))


def train(pages: DataFrame, column: str = "html", *, sample: int = 300, smooth: float = 1.0, prior: dict[str, float] | None = None) -> Weights:
    """Weights from the first ``sample`` different pages by hash. Each is counted where it lies, and only its counts by tokens are gathered; a token that only one page has counts for nothing."""
    ready(pages.sparkSession)
    prior = PRIOR_TOKENS if prior is None else prior
    some = pages.where(F.col(column).isNotNull()).select(F.xxhash64(column).alias("_h")).distinct().orderBy("_h").limit(sample).agg(F.max("_h")).head()[0]
    if some is None:
        return Weights(tokens=dict(prior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("html", lambda: None)
        kinds = [pa.string(), pa.list_(pa.string()), pa.int64(), pa.int64()]
        for batch in batches:
            for page in batch.column(0).to_pylist():
                if got := counted(page):
                    rows = [("words", [*k], *n) for k, n in sorted(got[0].items()) if sum(n)] + [("tags", [k], *n) for k, n in sorted(got[1].items())]
                    yield pa.RecordBatch.from_arrays([pa.array([[r[k] for r in rows]], pa.list_(t)) for k, t in enumerate(kinds)], names=["what", "tokens", "outside", "inside"])

    chosen = pages.where(F.col(column).isNotNull() & (F.xxhash64(column) <= some)).groupBy(F.xxhash64(column)).agg(F.first(column).alias(column)).select(column)
    got = chosen.mapInArrow(at_end(run), "what array<string>, tokens array<array<string>>, outside array<long>, inside array<long>").collect()
    if not got:
        return Weights(tokens=dict(prior))
    on_pages = Counter(t for r in got for t in {t for k, ts in zip(r.what, r.tokens, strict=True) if k == "words" for t in ts})
    examples: dict[tuple[str, ...], list[float]] = defaultdict(lambda: [0.0, 0.0])
    tags: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for r in sorted(got, key=lambda r: (r.tokens, r.outside, r.inside)):
        total = max(1, sum(o + i for k, o, i in zip(r.what, r.outside, r.inside, strict=True) if k == "words"))
        for kind, ts, o, i in zip(r.what, r.tokens, r.outside, r.inside, strict=True):
            if kind == "tags":
                tags[ts[0]][0] += o
                tags[ts[0]][1] += i
            else:
                to = examples[tuple(t for t in ts if on_pages[t] > 1)]
                to[0] += o / total
                to[1] += i / total
    base, learned = fit([(k, *v) for k, v in sorted(examples.items())], prior)
    a, b, kinds = sum(x[1] for x in tags.values()), sum(x[0] for x in tags.values()), len(tags)
    by = dict(PRIOR)
    for tag, (o, i) in tags.items():
        odds = math.log((i + smooth) / (a + smooth * kinds)) - math.log((o + smooth) / (b + smooth * kinds))
        by[tag] = min(-0.01, max(-0.5, PRIOR["tag"] + odds / 10))
    found = Weights(by, {**prior, **learned})
    by["word"] = min(MOST, max(0.5, base))
    by["link"] = min(-0.1, by["word"] + learned.get("a", prior.get("a", 0.0)) - MOST / 2)
    return found


def main_text(pages: DataFrame, weights: Weights, column: str = "html", to: str = "text") -> DataFrame:
    """``pages`` without ``column``, with the main text."""
    ready(pages.sparkSession)
    pass_on = [c for c in pages.columns if c not in (column, to)]
    plain = pages.select(*pass_on, column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("html", lambda: None)
        for batch in batches:
            for part in slices(batch, column):
                got = [extract(x, weights) for x in part.column(column).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in pass_on], pa.array(got, pa.string())], names=[*pass_on, to])

    fields = [f for f in plain.schema if f.name != column]
    return plain.mapInArrow(at_end(run), T.StructType([*fields, T.StructField(to, T.StringType())]))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return main_text(pages, train(pages)).withColumn("n_chars", F.length("text").cast("long"))
