"""Main text of HTML pages by a maximum-scoring subsequence (operator 2).

A page becomes a sequence of tags and text pieces.  Words score by where they
stand, tags cost a little, and one linear scan finds the contiguous region with
the highest total; the text is what scores positive in it.  The weights are
log-odds from labelled pages: pages that mark their own article (``article``,
``main``, ``itemprop=articleBody``) label each word as inside or outside, and
each word votes for its features, the names and class words of the elements
around it, ``MAX_LABELLED`` pages at most.  Names that say what an element is
(menus, adverts, notices, comments and so on; whole class words only, so
``no-sidebar`` is none) start with a prior of ``NAMED_PRIOR`` that learnt weights
of the element's own features add to, and an article inside such an element, or
inside a form, is read nevertheless.

Two rules of the scores keep a region whole.  Inside a marked article, and
between blocks of one container (the nearest ``div``, ``section`` or cell), tags
cost nothing, and words that score negative (an advert among the paragraphs)
cost nothing either, so a short last paragraph is not lost; they are left out of
the text all the same.  Elsewhere one block of such words costs ``MAX_BREAK`` at
most.

Defined results: null or empty html, and pages without positive words, give an
empty text.  Of regions with equal totals the first counts.  Broken markup is
read to its end: unclosed elements end with their parents, a tag or comment cut
off by the end of the page is dropped.  Repeated rows are read alike, null ids
and urls stay null; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LABELLED = 5_000
LEAST_WORDS = 5
SMOOTH = 20.0
TAG_COST = 0.3
MAX_BREAK = 8.0
NAMED_PRIOR = -4.0

# Element names of HTML by role.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mrow mi mo mn ms mtext mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mpadded mspace semantics annotation".split())
CONTAINER = frozenset("article main section div td".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head script style template noscript iframe object svg canvas audio video select textarea button form nav footer aside dialog menu".split())
RAW = frozenset("script style template noscript iframe textarea title".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: elements that say nothing of what they hold
PLAIN = INLINE - {"a"} | frozenset("div section table tbody thead tr td th center".split())
#: words of class, id and role that say what an element holds, and is not the article
NAMED = re.compile(
    r"^(ad|ads|adv|advert|adverts|advertisement|advertising|adsense|sponsor|sponsored|promo|promotion|banner|nav|navbar|navigation|menu|menubar|breadcrumb|breadcrumbs|sidebar|side|aside|widget|related|"
    r"footer|masthead|topbar|cookie|cookies|consent|gdpr|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|comment|comments|commentlist|discussion|disqus|respond|reply|replies|"
    r"share|sharing|social|pagination|pager|toolbar|search|complementary|contentinfo|hidden)$"
)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?until)|\bstyle\s*=\s*[\"'][^\"']*display\s*:\s*none", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_QUOTED = re.compile(r"(\bstyle\s*=\s*)?(?:\"[^\"]*\"|'[^']*')", re.I)


def _is_name(token: str) -> bool:
    """Whether all words of a class word are names; a word more (``no-``, ``has-``, ``-free``) makes it another."""
    words = [w for w in _SPLIT.split(token) if w]
    return bool(words) and all(NAMED.match(w) for w in words)


class Element:
    __slots__ = ("article", "cut", "depth", "dropped", "features", "fresh", "home", "inside", "left", "name", "named", "parent", "vote", "weight", "words")

    def __init__(self, name: str, parent: Element | None, attributes: str = "", around: set[str] | frozenset[str] = frozenset()) -> None:
        """``around`` has the features of the elements that it stands in."""
        self.name, self.parent, self.depth = name, parent, parent.depth + 1 if parent is not None else 0
        words: list[str] = []
        tokens: list[str] = []
        article = name in ("article", "main")
        for kind, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
            value = next((v for v in values if v), "").lower()
            article |= kind.lower() == "itemprop" and "articlebody" in value
            tokens += value.split()
            words += [w for w in _SPLIT.split(value) if w]
        held = parent is not None
        self.inside = article or (held and parent.inside)
        self.article = article
        self.named = any(_is_name(t) for t in tokens) and name not in ("html", "body", "article", "main")
        soft = self.named or name == "form" or (name == "header" and not self.inside)
        # "hidden" inside a quoted value, other than a style, is no attribute
        bare = _QUOTED.sub(lambda m: m[0] if m[1] else "\"\"", attributes) if attributes else ""
        self.dropped = (held and parent.dropped) or (name in DROPPED and name != "form") or bool(bare and _HIDDEN.search(bare) and name != "body")
        self.cut = self.dropped or soft or (held and parent.cut and not article)
        self.features = (*(() if name in PLAIN else (f"<{name}",)), *(f".{w}" for w in dict.fromkeys(words)))
        # those that no element around it has
        self.fresh = [f for f in self.features if f not in around] if name not in ("html", "body") else []
        # the container that it stands in, outside of what is cut
        self.home: Element | None = (self if name in CONTAINER and not self.cut else parent.home) if held else None
        self.weight: float | None = None
        self.vote: tuple[float, int] | None = None
        self.left: bool | None = None
        self.words = [0, 0]  # inside and outside of an article


class Page:
    """Blocks of a page: lists of (element, text, number of tags before); and all its elements, outer ones first.

    Open elements are kept by name as well, so that each tag takes constant time
    however many are open.
    """

    def __init__(self, source: str) -> None:
        self.blocks: list[tuple[Element, str, int]] = []
        self.elements: list[Element] = []
        self.tags = 0
        self._path: list[Element] = []
        self._open: dict[str, list[Element]] = {}
        self._closed_by_none: list[Element] = []  # open ones that no inline end tag closes
        self._around: set[str] = set()
        self._enter("html", "")
        pieces: list[str] = []
        owner = self._path[-1]

        def end_block() -> None:
            nonlocal pieces, owner
            if pieces:
                text = " ".join(html.unescape("".join(pieces)).split())
                if text:
                    self.blocks.append((owner, text, self.tags))
                    self.tags = 0
                pieces = []

        at, size = 0, len(source)
        while at < size:
            found = _TOKEN.search(source, at)
            upto = found.start() if found else size
            if upto > at:
                if not pieces:
                    owner = self._path[-1]
                pieces.append(source[at:upto])
            if not found:
                break
            at = found.end()
            close, name = found[1], found[2]
            if name is not None:
                name = name.lower()
                if found.group().endswith(">"):
                    self.tags += 1
                    if name == "br":
                        pieces.append("\n")
                    elif name not in VOID:
                        if name not in INLINE:
                            end_block()
                            self._end_implied(name)
                        parent = self._path[-1]
                        if not found[3].rstrip().endswith("/") or name not in ("svg", "path"):
                            here = self._enter(name, found[3])
                            if name in INLINE and here.cut and not parent.cut:
                                end_block()
                        if name in RAW:
                            shut = re.compile(rf"</{name}\s*>", re.I).search(source, at)
                            at = shut.end() if shut else size
                            self._back_to(parent)
                    elif name == "hr":
                        end_block()
            elif close is not None:
                close = close.lower()
                self.tags += 1
                target = self._nearest(close)
                if close not in INLINE:
                    end_block()
                elif target is not None and target.cut and target.parent is not None and not target.parent.cut:
                    end_block()
                if target is not None and target.parent is not None and self._may_close(target):
                    self._back_to(target.parent)
        end_block()

    def _enter(self, name: str, attributes: str) -> Element:
        here = Element(name, self._path[-1] if self._path else None, attributes, self._around)
        self.elements.append(here)
        self._path.append(here)
        self._open.setdefault(name, []).append(here)
        if name not in INLINE:
            self._closed_by_none.append(here)
        self._around.update(here.fresh)
        return here

    def _back_to(self, element: Element) -> None:
        while self._path[-1] is not element:
            gone = self._path.pop()
            self._open[gone.name].pop()
            if gone.name not in INLINE:
                self._closed_by_none.pop()
            self._around.difference_update(gone.fresh)

    def _nearest(self, *names: str) -> Element | None:
        """The innermost open element of these names."""
        found = [self._open[n][-1] for n in names if self._open.get(n)]
        return max(found, key=lambda e: e.depth, default=None)

    def _may_close(self, target: Element) -> bool:
        """An inline end tag doesn't close a block that was opened inside it."""
        return target.name not in INLINE or self._closed_by_none[-1].depth < target.depth

    def _end_implied(self, name: str) -> None:
        """Where a new block element hangs: an open paragraph, item or cell of its kind ends."""
        ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}.get(name, ())
        if name in ENDS_P:
            ends += ("p",)
        stop = {"li": ("ul", "ol"), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}.get(name, ()) + ("div", "article", "main", "section", "body", "html")
        last = self._nearest(*ends) if ends else None
        if last is not None and last.depth > self._nearest(*stop).depth:
            self._back_to(last.parent)

    def votes(self) -> tuple[Counter, Counter]:
        """Words inside and outside of a marked article by the features of the elements around them, and ``*`` for all."""
        inside, outside = Counter(), Counter()
        for element, text, _ in self.blocks:
            element.words[not element.inside] += text.count(" ") + 1
        for element in reversed(self.elements):  # inner ones first: an element holds the words of those in it
            a, b = element.words
            if element.parent is None:
                inside["*"], outside["*"] = a, b
            else:
                element.parent.words[0] += a
                element.parent.words[1] += b
            for f in element.fresh:
                inside[f] += a
                outside[f] += b
        return inside, outside


def learn(pages: DataFrame) -> dict[str, float]:
    """Log-odds of features from at most about MAX_LABELLED pages that mark their article."""
    labelled = pages.where(F.col("html").rlike(r"(?i)<article\b|<main\b|articlebody")).select("html")
    rows = labelled.count()
    if rows > MAX_LABELLED:
        labelled = labelled.where(F.pmod(F.xxhash64("html"), F.lit(1 << 62)) < (MAX_LABELLED << 62) // rows)

    def run(batches):
        for batch in batches:
            inside, outside = Counter(), Counter()
            for source in batch["html"]:
                a, b = Page(source or "").votes()
                inside.update(a)
                outside.update(b)
            names = [n for n in inside.keys() | outside.keys() if inside[n] or outside[n]]
            yield pd.DataFrame({"feature": names, "inside": [inside[n] for n in names], "outside": [outside[n] for n in names]})

    counts = labelled.mapInPandas(run, "feature string, inside long, outside long").groupBy("feature").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    # features of the bounded sample; those of a few words would weigh next to nothing
    kept = counts.where((F.col("inside") + F.col("outside") >= LEAST_WORDS) | (F.col("feature") == "*")).collect()
    table = {r.feature: (r.inside, r.outside) for r in kept}
    if "*" not in table:
        return {}
    total_in, total_out = table.pop("*")
    scale = (total_out + 1) / (total_in + 1)
    # both kinds of words get the same say, and few words little
    return {f: math.log((a * scale + SMOOTH) / (b + SMOOTH)) for f, (a, b) in table.items()}


class Scorer:
    """Weights of words by the element they stand in, remembered there."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights

    def word(self, element: Element) -> float:
        """Positive for words of content."""
        if element.weight is None:
            element.weight = self._word(element)
        return element.weight

    def _word(self, element: Element) -> float:
        if element.dropped or (element.cut and self._left_out(element)):
            return -1.0
        total, n = self._vote(element)
        # text outside all that is known scores a little: pages without any structure are content
        return max(-2.0, min(2.0, 0.5 + total / n)) if n else 0.5

    def _vote(self, element: Element) -> tuple[float, int]:
        """Sum and number of the known weights of features around; each element's is made once, from the one around it."""
        chain = []
        while element is not None and element.vote is None:
            chain.append(element)
            element = element.parent
        total, n = element.vote if element is not None else (0.0, 0)
        for inner in reversed(chain):
            for f in inner.fresh:
                if f in self.weights:
                    total, n = total + self.weights[f], n + 1
            inner.vote = total, n
        return total, n

    def _left_out(self, element: Element) -> bool:
        """Whether a form, header or named element is around, with no article between; made once for each element."""
        chain = []
        while element is not None and element.cut and element.left is None:
            chain.append(element)
            element = element.parent
        left = element.left if element is not None and element.cut else False
        for inner in reversed(chain):
            if inner.named:
                drops = NAMED_PRIOR + sum(self.weights.get(f, 0.0) for f in inner.features) < 0
            else:
                drops = inner.name == "form" or (inner.name == "header" and not inner.inside)
            left = inner.left = drops or (left and not inner.article)
        return left

    def line(self, blocks: list[tuple[Element, str, int]]) -> list[tuple[float, float]]:
        """Of each block: what the tags before it cost, and what its words score."""
        home = [element.home for element, _, _ in blocks]
        # containers that hold content of their own
        holding = {id(h) for h, (element, _, _) in zip(home, blocks, strict=True) if h is not None and self.word(element) > 0}
        out = []
        before = None
        for h, (element, text, tags) in zip(home, blocks, strict=True):
            score = self.word(element) * (text.count(" ") + 1)
            if element.inside:
                out.append((0.0, max(score, 0.0)))
            else:
                out.append((0.0 if h is not None and h is before else TAG_COST * min(tags, 4), max(score, 0.0 if id(h) in holding else -MAX_BREAK)))
            before = h
        return out


def best_region(line: list[tuple[float, float]]) -> tuple[int, int] | None:
    """First and last block of the contiguous region with the highest total; the tags before its first block do not count."""
    best, region = 0.0, None
    total, start = 0.0, 0
    for i, (tags, words) in enumerate(line):
        total -= tags
        if total <= 0:
            total, start = 0.0, i
        total += words
        if total > best:
            best, region = total, (start, i)
    return region


def main_blocks(source: str | None, scorer: Scorer) -> list[str]:
    if not source:
        return []
    blocks = Page(source).blocks
    region = best_region(scorer.line(blocks))
    if region is None:
        return []
    return [text for element, text, _ in blocks[region[0] : region[1] + 1] if scorer.word(element) > 0]


def extract(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    if weights is None:
        weights = learn(pages)

    def run(batches):
        scorer = Scorer(weights)
        for batch in batches:
            text = ["\n".join(main_blocks(source, scorer)) for source in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
