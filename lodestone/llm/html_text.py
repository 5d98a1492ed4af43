"""Main text of web pages by tag-path ratios.

Text is gathered in blocks; a block's tag path is the chain of block elements
from the root to it, with their classes.  For each path of a page the length of
its text, its punctuation and the text of its links are added up:

* text ratio: characters that are no link text, for each block of the path;
* punctuation ratio: punctuation marks for each block of the path.

Both are smoothed over the blocks in page order, fused with the same ratios of
the enclosing element, so that headings and short blocks share in the article
around them, and weighed by what the elements on the path mean (menus, forms,
adverts and comments weigh nothing, unless they hold most of the text).  Articles
and main elements stand against what lies outside them: the side with more text in
sentences counts, the other weighs nothing.  Paths above a share of the page's best path choose the content: the
articles they lie in, or without one the elements around their blocks.  All blocks
of those are kept that weigh something, whatever their own ratios.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, table

#: Elements of HTML by their part in a page.
BLOCKS = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDES_REST = frozenset("script style textarea title noscript template iframe xmp noframes".split())
RAW = frozenset("script style textarea title noscript template iframe svg object select button noframes xmp head".split())
CLOSES_P = BLOCKS - {"html", "body"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
BOILERPLATE = frozenset("nav aside footer menu dialog".split())
#: Words of class, id and role that tell of no article.
HINTS = frozenset("ad ads advert adverts advertisement advertising banner promo promos promotion promoted sponsor sponsors sponsored sidebar sidebars menu menus navbar nav navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices alert newsletter subscribe subscription comment comments commentlist disqus feedback reactions respond replies share sharing social related recommend recommended recommendations popup modal overlay widget widgets login signin signup toolbar pagination pager copyright skip hidden search tags taboola outbrain".split())
PAGE_HEADER = frozenset("header masthead topbar logo".split())
#: Words that may stand beside those in an id; ids made from headings hold others.
BESIDE = frozenset("area bar block box column container content form group inner left link links list main outer page panel right row section site top wrap wrapper".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: First words of classes that tell of something else (no-sidebar, tag-politics).
UNMEANT = frozenset("no not has is with without tag category post page single type status format layout".split())
#: Elements that hold the article whatever their classes say.
NEVER_HINTED = frozenset("html body main article".split())
PUNCTUATION = re.compile(r"[.,;:!?¡¿…。，；：！？、]")

_TAG = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|[!?/])")
_COMMENT_END = re.compile(r"--!?>")
_WORD = re.compile(r"[a-z]+")
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_VALUE = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s/]|$)", re.I)
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Element:
    """An element that holds blocks; path is a number that elements of the same tag path share.

    outermost: the outermost article or main element around it, itself included.
    hinted: whether it is a form, or its words alone set it aside.
    """

    __slots__ = ("above", "dropped", "hinted", "name", "outermost", "parent", "path", "place")

    def __init__(self, name: str, path: int, above: int, place: int, parent: Element | None, dropped: bool = False):
        self.name, self.path, self.above, self.place, self.parent, self.dropped = name, path, above, place, parent, dropped
        self.outermost: Element | None = parent.outermost if parent else None
        self.hinted = False


class Block:
    __slots__ = ("element", "links", "text")

    def __init__(self, element: Element, text: str, links: int):
        self.element, self.text, self.links = element, text, links


def _hints(marks: str, words: frozenset[str]) -> bool:
    for token in marks.lower().split():
        parts = _WORD.findall(token)
        if parts and parts[0] not in UNMEANT and not words.isdisjoint(parts) and "with" not in parts and "no" not in parts:
            return True
    return False


def _named(id_: str, words: frozenset[str]) -> bool:
    """An id of such words, and of those that stand beside them, alone."""
    parts = _WORD.findall(id_.lower())
    return not words.isdisjoint(parts) and all(p in words or p in BESIDE for p in parts)


class _Tags:
    """Tags of a page in one pass: every search for an end that is not there is made once."""

    def __init__(self, html: str):
        self.html, self.last, self.missing = html, html.rfind(">"), set()
        self.quotes = {q: html.rfind(q) for q in "\"'"}

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """Start, end, lower-case name (empty for comments and the like), whether it closes, and attributes of the next tag."""
        html = self.html
        m = _TAG.search(html, at)
        if not m:
            return None
        if m[1]:
            stop = None if "--" in self.missing else _COMMENT_END.search(html, m.end())
            if stop is None:
                self.missing.add("--")
            return m.start(), stop.end() if stop else len(html), "", False, ""
        end = html.find(">", m.end()) if self.last >= m.end() else -1
        if not m[3]:
            return m.start(), end + 1 if end >= 0 else len(html), "", False, ""
        if end < 0:  # an unfinished tag is the rest of the page
            return m.start(), len(html), "", False, ""
        end = self._past_quotes(m.end(), end)
        return m.start(), end + 1, m[3].lower(), bool(m[2]), html[m.end() : end]

    def _past_quotes(self, at: int, end: int) -> int:
        """The > that ends a tag, not in quotes; the first one where quotes stay open."""
        html, first = self.html, end
        while True:
            k = min((i for i in (html.find('"', at, end), html.find("'", at, end)) if i >= 0), default=-1)
            if k < 0:
                return end
            quote = html[k]
            close = html.find(quote, k + 1) if self.quotes[quote] > k else -1
            if close < 0:
                return first
            at = close + 1
            if close > end:
                end = html.find(">", at) if self.last >= at else -1
                if end < 0:
                    return first

    def after(self, name: str, at: int) -> int | None:
        """Past the closing tag of a raw element, or None if there is none."""
        if name in self.missing:
            return None
        stop = re.compile(rf"</{name}[\s/>]", re.I).search(self.html, at)
        if not stop:
            self.missing.add(name)
            return None
        return self.html.find(">", stop.start()) + 1 or len(self.html)


class _Tree:
    """The open elements while a page is read."""

    def __init__(self):
        self.paths: dict[tuple[int, str], int] = {}
        self.elements = [Element("", 0, 0, 0, None)]
        self.stack = [self.elements[0]]
        self.open: dict[str, int] = defaultdict(int)

    def push(self, name: str, attrs: str) -> None:
        parent = self.stack[-1]
        given = {a.lower(): b or c or d for a, b, c, d in _ATTR.findall(attrs)} if "=" in attrs else {}
        kind = " ".join(sorted(given.get("class", "").split()))
        path = self.paths.setdefault((parent.path, f"{name} {kind}"), len(self.paths) + 1)
        e = Element(name, path, parent.path, len(self.elements), parent, parent.dropped)
        if e.outermost is None and (name in ("article", "main") or given.get("role") == "main" or given.get("itemprop") == "articleBody"):
            e.outermost = e
        hidden = "hidden" in attrs.lower() and _HIDDEN.search(_VALUE.sub(" ", attrs))
        if name in BOILERPLATE or given.get("aria-hidden") == "true" or hidden or _HIDES.search(given.get("style", "")) or (name == "header" and not e.outermost):
            e.dropped = True
        if name == "form":
            e.hinted = True
        elif name not in NEVER_HINTED and name not in HEADINGS:
            marks, own = f"{kind} {given.get('role', '')}", given.get("id", "")
            e.hinted = _hints(marks, HINTS) or (not e.outermost and _hints(marks, PAGE_HEADER)) or _named(own, HINTS) or (not e.outermost and _named(own, PAGE_HEADER))
        self.elements.append(e)
        self.stack.append(e)
        self.open[name] += 1

    def close(self, names: set[str] | frozenset[str], scope: set[str] = frozenset()) -> None:
        if not any(self.open[n] for n in names):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].name in names:
                for e in self.stack[k:]:
                    self.open[e.name] -= 1
                del self.stack[k:]
                return
            if self.stack[k].name in scope:
                return


def blocks_of(html: str) -> tuple[list[Block], list[Element]]:
    """The blocks of a page in order, and its elements, parents first."""
    out: list[Block] = []
    tree, tags = _Tree(), _Tags(html)
    parts: list[str] = []
    links = link_depth = 0

    def flush() -> None:
        nonlocal links
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(tree.stack[-1], text, min(links, len(text))))
        parts.clear()
        links = 0

    at = 0
    while at <= len(html):
        tag = tags.next(at)
        text = html[at : tag[0]] if tag else html[at:]
        if text:
            text = unescape(text) if "&" in text else text
            parts.append(text)
            if link_depth:
                links += len(text.strip())
        if not tag:
            break
        _, at, name, end, attrs = tag
        if not name:
            continue
        if name in RAW and not end:
            if name != "head" and not attrs.endswith("/"):
                after = tags.after(name, at)
                # An unclosed script hides the rest of a page, an unclosed picture or button does not.
                at = after if after is not None else len(html) if name in HIDES_REST else at
            parts.append(" ")
        elif name == "a":
            link_depth = 0 if end else 1
        elif name == "br":
            parts.append(" ")
        elif name in BLOCKS:
            flush()
            link_depth = 0
            if end:
                tree.close({name})
            else:
                if name in CLOSES_P:
                    tree.close({"p"}, {"div", "article", "section", "td", "li", "body", "blockquote"})
                if name in SAME:
                    tree.close(SAME[name], SCOPES.get(name, set()))
                if name not in VOID:
                    tree.push(name, attrs)
    flush()
    return out, tree.elements


def _set_aside(blocks: list[Block], elements: list[Element], length: np.ndarray) -> list[bool]:
    """Whether a block is boilerplate by its elements.

    The ratios overrule words and forms: such an element is kept if it holds over
    half of the page's text outside links, and a main heading, an article or a
    paragraph of some length.
    """
    text, headed = [0.0] * len(elements), [False] * len(elements)
    for b, n in zip(blocks, length.tolist(), strict=True):
        e = b.element
        if not e.dropped:
            text[e.place] += n
            headed[e.place] = headed[e.place] or e.name == "h1" or e.outermost is not None or (e.name == "p" and n >= 80)
    for e in reversed(elements[1:]):
        text[e.parent.place] += text[e.place]
        headed[e.parent.place] = headed[e.parent.place] or headed[e.place]
    aside = [False] * len(elements)
    for e in elements[1:]:  # parents come first
        kept = 2 * text[e.place] > text[0] and headed[e.place]
        aside[e.place] = e.dropped or aside[e.parent.place] or (e.hinted and not kept)
    return [aside[b.element.place] for b in blocks]


def _outside(blocks: list[Block], dropped: list[bool], weight: np.ndarray) -> tuple[bool, set[Element]]:
    """Whether the text lies outside all articles, and the articles that are none: small ones after a larger one.

    An article or main element is one candidate among others; what has more text in
    sentences is the content.
    """
    held: dict[Element, float] = defaultdict(float)
    beside = 0.0
    for b, d, w in zip(blocks, dropped, weight.tolist(), strict=True):
        if not d:
            if b.element.outermost:
                held[b.element.outermost] += w
            else:
                beside += w
    largest = max(held, key=lambda e: held[e], default=None)
    teasers = {e for e, w in held.items() if e.name == "article" and e.place > largest.place and 5 * w < held[largest]} if largest else set()
    return beside > sum(held.values()), teasers


def content_blocks(html: str, share: float = 0.08, width: float = 1.0) -> list[str]:
    """Texts of the blocks on content paths."""
    blocks, elements = blocks_of(html)
    if not blocks:
        return []
    length = np.array([len(b.text) - b.links for b in blocks], float)
    marks = np.array([len(PUNCTUATION.findall(b.text)) for b in blocks], float)
    dropped = _set_aside(blocks, elements, length)
    outside, teasers = _outside(blocks, dropped, length * np.minimum(marks, 1))
    inside = not outside and any(b.element.outermost and not d for b, d in zip(blocks, dropped, strict=True))
    prior = np.array([float(not d and (bool(b.element.outermost) == inside or not (inside or outside)) and b.element.outermost not in teasers) for b, d in zip(blocks, dropped, strict=True)])

    def ratios(keys: list[int]) -> np.ndarray:
        _, key = np.unique(keys, return_inverse=True)
        count = np.bincount(key)
        return ((np.bincount(key, length) / count) * (1 + np.bincount(key, marks) / count))[key]

    paths = [b.element.path for b in blocks]
    own, around = ratios(paths), ratios([b.element.above for b in blocks])
    reach = np.arange(-2, 3)
    kernel = np.exp(-(reach**2) / (2 * width**2))
    smooth = np.convolve(own * prior, kernel / kernel.sum())[2:-2]
    fused = np.sqrt(np.maximum(smooth, own * prior) * prior * np.maximum(around, own))
    best = fused.max()
    if best <= 0:
        # No text outside links: links of an article are its text all the same.
        return [b.text for b, p in zip(blocks, prior, strict=True) if p and inside]
    # A path is chosen whole, by the mean of its blocks.
    _, key = np.unique(paths, return_inverse=True)
    chosen = (np.bincount(key, fused) / np.bincount(key) >= share * best)[key] & (prior > 0)
    core = np.flatnonzero(chosen)
    containers = np.zeros(len(elements), bool)
    bare = False  # content right in the body
    for k in core.tolist():
        e = blocks[k].element
        if inside:
            containers[e.outermost.place] = True
        else:
            near = [x for x in (e, e.parent) if x is not None and x.name not in ("", "html", "body")]
            containers[[x.place for x in near]] = True
            bare = bare or len(near) < 2
    for e in elements:  # parents come first
        containers[e.place] |= e.parent is not None and containers[e.parent.place]
    out = []
    for k, b in enumerate(blocks):
        between = bare and not inside and core[0] < k < core[-1] and b.links < len(b.text)
        if prior[k] and (chosen[k] or containers[b.element.place] or between):
            out.append(b.text)
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of pages(page_id, url, html).

    Null or empty html, and pages without content, give an empty text.  Whole
    pages are read, markup may be broken anywhere.  Repeated rows are rows of
    their own; other columns are ignored.
    """

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 500):
            found = ["\n".join(content_blocks(h or "")) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    asked = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return asked.mapInArrow(texts, "page_id long, url string, text string, n_chars long")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of all pages."""
    return extract(table(spark, sf_dir, "pages"))
