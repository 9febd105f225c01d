"""Main text of web pages by consensus host paths.

1. Every page is parsed once and its containers are scored: the text of their blocks, less where it is links, more where
   tag or class says article. A block counts fully for the article or main element that it is in (or else for the
   container around it), and half as much for each container further in or out.
2. A container's path is its chain of structural tags with classes, digits generalised, of whatever depth and known by
   its hash. Spark adds up the scores of each (host, path); the paths that reach HOST_SHARE of a host's strongest win.
3. Every page is parsed again and its text taken from the host's strongest path that holds a fair share of
   this page's text (FAIR_SHARE), or else from the page's own best container.

Tags end as in the html standard: quotes count only around a value; if a quote is never closed, the tag ends at the next
">". Parsing takes time in proportion to the page, whatever is nested or left open in it.

Defined results: null or empty html, or a page without text, gives an empty text and 0 characters; a page without a
host votes for nobody and uses its own best container; ties go to the path that comes first in the page, and among a
host's to the lower hash; unclosed elements end with the page; repeated rows give repeated rows; an empty table gives
an empty result; further input columns are ignored. The html is read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewright.llm.common import broadcast_if_few, materialise

#: The share of a host's strongest path that its other winners have, and the share of a page's best score that a winner must have there.
HOST_SHARE, FAIR_SHARE = 0.1, 0.3

#: The share of links beyond which text beside a container isn't the article's.
LINKED = 0.5

#: What follows a tag's name: names, and values that are quoted or run to white space.
_REST = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>script|style|textarea|title|noscript|template|iframe|svg|xmp|noembed|noframes)(?=[\s/>]|\Z){_REST}(?:(?<=/)>|>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    rf"|<[!?][^>]*+(?:>|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>{_REST})(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"([^\s/>=\"']++)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never part of the text.
DROPPED = frozenset("head nav footer aside form button select option dialog menu audio video canvas".split())
#: Containers that a path is made of.
STRUCTURE = frozenset("html body main article section div table tbody tr td center".split())
#: Elements that begin and end a block.
BLOCKS = STRUCTURE | frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption address hr header hgroup details summary th thead tfoot caption fieldset legend br".split()
)
CLOSES_P = BLOCKS - {"br"}
#: What an inner end tag doesn't close.
BARRIERS = frozenset("article main body td table".split())
#: Words of class, id or role that mark what isn't the article: a name of such words and neutral ones does.
ASIDE = frozenset(
    "nav navbar navigation menu sidebar footer masthead banner ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent notice notices gdpr newsletter"
    " subscribe subscription share sharing social comment comments disqus respond reply replies related recommended recommendations breadcrumb breadcrumbs popup modal login signup search widget widgets pagination"
    " pager toolbar toc skip complementary contentinfo alert adsbygoogle".split()
)
#: Those of them that mark an inline element which isn't the article's either.
ADVERTS = frozenset(
    "ad ads adsbygoogle advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent notice notices gdpr newsletter".split()
)
NEUTRAL = frozenset(
    "site page main top bottom left right side global primary secondary section block area box wrap wrapper container content inner outer list item items link links button buttons bar panel row col"
    " slot unit form posts post articles article header group thread count title text icon icons overlay sticky fixed small large inline dropdown mobile desktop the and of us".split()
)
HEADER = frozenset("header sitehead topbar".split())
ARTICLE = re.compile(r"article|content|post|entry|story|main|text|body", re.IGNORECASE)
DIGITS = re.compile(r"\d+")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^\W\d_]+")


class Element:
    """An open element: its path's hash, whether its text is dropped, the article or main element around it, and whether
    it lies in the container that is asked for."""

    __slots__ = ("article", "drop", "inside", "key", "label", "parent", "tag")

    def __init__(self, tag: str, parent: Element | None, key: int, label: str, drop: bool, inside: bool):
        self.tag, self.parent, self.key, self.label, self.drop, self.inside = tag, parent, key, label, drop, inside
        self.article = self if tag in ("article", "main") else parent.article if parent else None

    def path(self) -> str:
        labels, at = [], self
        while at is not None:
            if at.label:
                labels.append(at.label)
            at = at.parent
        return "/" + "/".join(reversed(labels))


def _attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(rest)}


def _named(name: str, words: frozenset[str]) -> bool:
    """Whether a class, id or role is one of these words, alone or among neutral ones."""
    parts = [x.lower() for x in WORDS.findall(name)]
    return "".join(parts) in words or any(x in words for x in parts) and all(x in words or x in ASIDE or x in NEUTRAL for x in parts)


def _dropped(tag: str, marks: dict[str, str], inside: bool) -> bool:
    """inside: within an article or main element, where a header is the article's own."""
    if tag in DROPPED or (tag == "header" and not inside):
        return True
    if not marks or tag in ("body", "html", "main"):
        return False
    if tag not in BLOCKS:
        names = marks.get("class", "").split()
        return bool(names) and all(_named(x, ADVERTS) for x in names)
    names = [x for kind in ("class", "id", "role") for x in marks.get(kind, "").split()]
    return any(_named(x, ASIDE) for x in names) or (not inside and any(_named(x, HEADER) for x in names))


class Stack:
    """The open elements. Of each tag, of blocks, of structural elements and of barriers it knows the places, so that no
    step looks through what is open."""

    def __init__(self):
        self.open: list[Element] = [Element("", None, 0, "", False, False)]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.structure: list[int] = []
        self.barriers: list[int] = []

    def push(self, element: Element) -> None:
        at = len(self.open)
        self.open.append(element)
        for places in self._of(element.tag):
            places.append(at)

    def _of(self, tag: str) -> Iterator[list[int]]:
        yield self.places.setdefault(tag, [])
        for places, tags in ((self.blocks, BLOCKS), (self.structure, STRUCTURE), (self.barriers, BARRIERS)):
            if tag in tags:
                yield places

    def cut(self, at: int) -> None:
        while len(self.open) > at:
            for places in self._of(self.open.pop().tag):
                places.pop()

    def close(self, tag: str) -> None:
        at = self.places.get(tag)
        if at and (tag in STRUCTURE or not self.barriers or at[-1] > self.barriers[-1]):
            self.cut(at[-1])

    def close_before(self, tag: str) -> None:
        """What an opening block tag closes by itself: an open p with what is in it, and an open li, dt or dd of the same list."""
        if self.blocks:
            name = self.open[self.blocks[-1]].tag
            if name == "p" or (name == tag and tag in ("li", "tr", "td")) or (name in ("dt", "dd") and tag in ("dt", "dd")):
                self.cut(self.blocks[-1])

    def containers(self) -> list[Element]:
        """The innermost structural elements, innermost first."""
        return [self.open[at] for at in self.structure[-3:]][::-1]


def walk(html: str, target: int | None = None) -> Iterator[tuple[Stack, str, bool]]:
    """(open elements, text, whether a block ended) for each token of the page."""
    stack = Stack()
    position = 0
    for m in TOKEN.finditer(html):
        if m.start() > position:
            yield stack, unescape(html[position : m.start()]), False
        position = m.end()
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if m["close"] or tag in VOID:
            if m["close"]:
                stack.close(tag)
            if tag in BLOCKS:
                yield stack, "", True
            continue
        if tag in CLOSES_P:
            stack.close_before(tag)
        parent = stack.open[-1]
        marks = _attributes(m["rest"]) if m["rest"].strip() else {}
        key, label = parent.key, ""
        if tag in STRUCTURE:
            label = ".".join([tag, *sorted(set(DIGITS.sub("#", marks.get("class", "")).split()))])
            key = xxhash.xxh3_64_intdigest(f"{key}/{label}".encode("utf-8", "replace")) >> 1
        drop = parent.drop or _dropped(tag, marks, parent.article is not None)
        stack.push(Element(tag, parent, key, label, drop, parent.inside or (bool(label) and key == target)))
        if tag in BLOCKS:
            yield stack, "", True
    if position < len(html):
        yield stack, unescape(html[position:]), False


def _shares(inner: list[Element]) -> Iterator[tuple[Element, float]]:
    """The containers that a block counts for, and how much; inner are the structural elements around it, innermost first."""
    article = inner[0].article
    if article is None:
        yield from zip(inner, (1.0, 0.5, 0.25))
        return
    yield article, 1.0
    for element in inner:
        if element is article:
            break
        yield element, 0.5
    outer, share = article.parent, 0.5
    while outer is not None and share >= 0.25:
        if outer.label:
            yield outer, share
            share /= 2
        outer = outer.parent


def containers(html: str) -> dict[int, tuple[float, Element]]:
    """Path hash to the score and the first element of the page's containers, in page order."""
    return survey(html)[0]


def survey(html: str) -> tuple[dict[int, tuple[float, Element]], dict[int, list]]:
    """The containers, and path hash to [characters, those of links, first element] of the blocks that lie right in an element."""
    scores: dict[int, tuple[float, Element]] = {}
    direct: dict[int, list] = {}
    length = links = 0
    holder: list[Element] = []

    def flush() -> None:
        nonlocal length, links
        if length and holder:
            worth = (length - links) * (1 - links / length)
            for element, share in _shares(holder):
                lift = (1.5 if element.tag in ("article", "main") else 1.0) * (1.25 if ARTICLE.search(element.label) else 1.0)
                before, first = scores.get(element.key, (0.0, element))
                scores[element.key] = before + worth * lift * share, first
            own = direct.setdefault(holder[0].key, [0, 0, holder[0]])
            own[0] += length
            own[1] += links
        length = links = 0

    for stack, text, block in walk(html):
        if block:
            flush()
        elif text and not stack.open[-1].drop and (size := len(" ".join(text.split()))):
            if not length:
                holder = stack.containers()
            length += size
            if stack.places.get("a"):
                links += size
    flush()
    return scores, direct


def climb(key: int, element: Element, direct: dict[int, list]) -> int:
    """The outermost path, from that of a container without article elements up to below body, that has blocks of its own beside it, or is
    named like an article and has more containers: headings and leads stand there. What is mostly links ends the climb."""
    parents: dict[int, Element | None] = {}
    below: list[Element] = []
    for *_, at in direct.values():
        chain = []
        while at is not None and not (at.label and at.key in parents):
            if at.label:
                chain.append(at)
            at = at.parent
        for inner, outer in zip(chain, [*chain[1:], at], strict=True):
            parents[inner.key] = outer
        below += chain[::-1]
    totals = {e.key: direct.get(e.key, (0, 0))[:2] for e in below}
    for e in reversed(below):  # what is inside comes after what is around it
        outer = parents[e.key]
        if outer is not None:
            totals[outer.key] = [a + b for a, b in zip(totals[outer.key], totals[e.key], strict=True)]
    best, at = key, parents.get(key)
    while at is not None and at.tag not in ("html", "body"):
        own = direct.get(at.key, (0, 0))
        others, links = (totals[at.key][k] - totals[key][k] - own[k] for k in (0, 1))
        if links > LINKED * others or own[1] > LINKED * own[0] or (others and not own[0] and not ARTICLE.search(at.label)):
            break
        if own[0] or others:
            best = at.key
        key, at = at.key, parents[at.key]
    return best


def text_at(html: str, key: int | None) -> str:
    """The text of all elements of that path, in page order, white space as single spaces; None: outside what is dropped."""
    out: list[str] = []
    for stack, text, block in walk(html, key):
        if block:
            out.append(" ")
        elif text and not stack.open[-1].drop and (key is None or stack.open[-1].inside):
            out.append(text)
    return " ".join("".join(out).split())


def extract(html: str, host_paths: list[int] | None) -> tuple[str, str]:
    """(text, path) by the host's paths or else the page's own."""
    scores, direct = survey(html)
    if not scores:
        return text_at(html, None), ""
    own = max(scores, key=lambda key: scores[key][0])
    key = next((k for k in host_paths or [] if k in scores and scores[k][0] >= FAIR_SHARE * scores[own][0]), own)
    winner = scores[key][1]
    if winner.article is None:
        key = climb(key, winner, direct)
    return text_at(html, key), winner.path()


def host_of(url: str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def host_votes(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """(host, paths): the winning paths of each host, strongest first. Scores are added up before and after the
    shuffle, so a host that holds a third of all pages sends a row a path from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            votes: dict[tuple[str, int], int] = {}
            for host, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for path, (score, _) in containers(page).items():
                    votes[host, path] = votes.get((host, path), 0) + round(score * 100)
            arrays = [pa.array([h for h, _ in votes], pa.string()), pa.array([p for _, p in votes], pa.int64()), pa.array(list(votes.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["host", "path", "score"])

    named = pages.select(host_of(url).alias("host"), F.col(html).alias("html")).where("host <> '' AND html IS NOT NULL")
    totals = named.mapInArrow(run, "host string, path long, score long").groupBy("host", "path").agg(F.sum("score").alias("score"))
    best = totals.withColumn("most", F.max("score").over(Window.partitionBy("host"))).where(F.col("score") >= HOST_SHARE * F.col("most"))
    ranked = best.groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("order"), "path"))).alias("x"))
    return ranked.select("host", F.col("x.path").alias("paths"))


def extract_pages(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: key, url, text, n_chars, path (of the container that the text is from)."""
    votes = materialise(host_votes(pages, url=url, html=html), "host-paths")
    picked = pages.select(F.col(key), F.col(url), F.col(html), host_of(url).alias("_host_"))
    joined = picked.join(broadcast_if_few(votes, size=F.octet_length("host") + 8 * F.size("paths")), F.col("_host_") == votes.host, "left").select(key, url, html, "paths")
    key_type = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            found = [extract(x or "", p) for x, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            texts = [t for t, _ in found]
            arrays = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([p for _, p in found], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [key, url, "text", "n_chars", "path"])

    return joined.mapInArrow(run, f"`{key}` {key_type}, `{url}` string, text string, n_chars long, path string")
