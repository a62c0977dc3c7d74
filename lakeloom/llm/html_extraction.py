"""Main-text extraction from raw HTML by text-to-tag ratios.

Parser events (standard library, streaming) give blocks, the "lines" of a page: text between
block-level tags, with the number of tags seen in and before it. Blocks inside menus, headers,
footers, sidebars, notices, adverts, widgets, scripts, styles and comments are set aside by element
and by class, id or role words. Structure decides which words count, never a share of the page:
inside a marked article a name must consist of layout words alone, and one that does not speak of
comments must not hold most blocks of the article; outside, words do not count on what holds all
marked articles, or on a page without any, its first-level heading; nor do they after "with", "no"
and the like. A form is a widget unless it holds an article, a first-level heading, or headings and
more paragraphs than fields. Of the others, each block's ratio of characters to tags is smoothed
over the page by a Gaussian and split by a two-means threshold into content and rest.

The content region is the article or main element around all blocks over the threshold, with the
other articles beside it; without one, the innermost element that holds them, and those around it
as long as what they add is headings and running text. All its blocks that are not set aside are
the text, so short paragraphs of the article stay.

Elements are numbered as they open and know the one around them, so all of this takes time in
proportion to the page, however deep its elements nest.

Defined cases: null or empty html gives an empty text; markup that is cut off or not closed is
read as far as it goes; a page without block tags is one block; pages of any length and depth are
read whole; rows that repeat and null ids stay; an empty table returns no rows. Other columns are
ignored.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SIGMA = 2.0
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ASIDE = frozenset("aside button dialog footer head iframe menu nav noscript object script select style svg template textarea title".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted promotion related replies reply respond responses share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
#: Of these, the words that speak of what readers write.
READERS = frozenset("comment comments disqus replies reply respond responses".split())
#: Words that may stand beside a layout word without giving its name another meaning.
NEUTRAL = frozenset("a area bar block bottom box column container content count desktop entry fixed float header holder inner item items left links list main mobile module outer page panel post posts primary right section secondary site sticky thread title top unit user wrap wrapper".split())
ROLES = frozenset("banner navigation complementary contentinfo search form dialog alert menu menubar".split())
#: Words that turn the next one into a remark on layout.
REMARKS = frozenset("with without no non not has have hide".split())
FIELDS = frozenset("button input select textarea".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
RUNNING = frozenset("blockquote figcaption p pre".split())
LOOSE, STRICT, READER = 1, 2, 3
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
_SPLIT = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")


#: Elements that another of their kind, or a block, closes.
ITEMS = frozenset("li dt dd tr td th option".split())
CLOSING = ITEMS | frozenset("p div ul ol table h1 h2 h3 h4 h5 h6".split())


class _Blocks(HTMLParser):
    """Collects (text, tags, innermost element, innermost one that is not inline, characters in
    links) for each block in page order, and the elements: the one around (a smaller number; 0 is
    the page), the name, whether the element sets aside, and how far its words would.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int, int, int, int]] = []
        self.around, self.names, self.aside, self.worded = [0], [""], [False], [0]
        self.fields: list[tuple[int, int]] = []  # fields of forms, by the element around
        self.open: list[tuple[int, int, int]] = []  # element, place of the nearest one that is not inline, articles around and at it
        self.held: dict[str, int] = {}  # open elements of a name
        self.head = -1  # place of an open head
        self.tags = 0
        self.parts: list[str] = []
        self.linked = 0

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            inner, near, _ = self.open[-1] if self.open else (0, -1, 0)
            self.blocks.append((text, self.tags, inner, self.open[near][0] if near >= 0 else 0, self.linked))
            self.tags = 0
        self.linked = 0

    def _cut(self, place: int) -> None:
        """Closes the open elements from a place on."""
        while len(self.open) > place:
            self.held[self.names[self.open.pop()[0]]] -= 1
        if self.head >= place:
            self.head = -1

    def _sets_aside(self, tag: str, attrs, articles: int) -> bool:
        if tag in ASIDE:
            return True
        if tag == "header":
            return not articles
        if tag in ("html", "body", "article", "main"):
            return False
        return any(key == "hidden" or (key == "aria-hidden" and value == "true") for key, value in attrs)

    def _words(self, tag: str, attrs) -> int:
        """How far an element's names go: 0 not at all, LOOSE, STRICT, or READER, strict and of what readers write."""
        found = 0
        if tag in ("html", "body", "article", "main", "header"):
            return found
        for key, value in attrs:
            if value and key == "role" and value.lower() in ROLES:
                found = max(found, STRICT)
            if value and key in ("class", "id"):
                for name in value.split():
                    words = [w.lower() for w in _SPLIT.split(name) if w]
                    layout = {w for before, w, after in zip(["", *words], words, [*words[1:], ""], strict=False) if w in WORDS and before not in REMARKS and (w, after) != ("related", "work")}
                    if layout:
                        strict = all(w in layout or w in NEUTRAL for w in words)
                        found = max(found, (READER if layout & READERS else STRICT) if strict else LOOSE)
        return found

    def handle_starttag(self, tag, attrs):
        if self.head >= 0 and (tag == "body" or (self.head == len(self.open) - 1 and tag not in HEAD)):
            self._flush()  # the body, or what cannot stand in a head, ends it
            self._cut(self.head)
        if tag not in INLINE:
            self._flush()
            near = self.open[-1][1] if self.open else -1
            if tag in CLOSING and near >= 0:
                name = self.names[self.open[near][0]]
                if name == "p" or (name == tag and tag in ITEMS):
                    self._cut(near)
        elif tag == "br":
            self.parts.append(" ")
        self.tags += 1
        if tag in FIELDS:
            self.fields.append((self.open[-1][0] if self.open else 0, 1))
        if tag in VOID:
            return
        up, near, articles = self.open[-1] if self.open else (0, -1, 0)
        self.around.append(up)
        self.names.append(tag)
        self.aside.append(self._sets_aside(tag, attrs, articles))
        self.worded.append(self._words(tag, attrs))
        self.held[tag] = self.held.get(tag, 0) + 1
        if tag == "head":
            self.head = len(self.open)
        self.open.append((len(self.names) - 1, near if tag in INLINE else len(self.open), articles + (tag in ("article", "main"))))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self._flush()
        self.tags += 1
        if self.held.get(tag):
            place = len(self.open) - 1
            while self.names[self.open[place][0]] != tag:
                place -= 1
            self._cut(place)

    def handle_data(self, data):
        self.parts.append(data)
        if self.held.get("a"):
            self.linked += len(data)

    def finish(self) -> None:
        self.close()
        self._flush()

    def sums(self, weights: list[tuple[int, int]]) -> list[int]:
        """Of each element, the sum of the weights (element, weight) in it."""
        total = [0] * len(self.names)
        for e, w in weights:
            total[e] += w
        for e in range(len(total) - 1, 0, -1):
            total[self.around[e]] += total[e]
        return total

    def within(self, chosen) -> list[bool]:
        """Whether each element is, or is inside, a chosen one."""
        inside = [False] * len(self.names)
        for e in range(1, len(inside)):
            inside[e] = inside[self.around[e]] or chosen(e)
        return inside


def smooth(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; at the page's ends the kernel is cut and weighted anew."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = slice(reach, reach + len(x))
    return np.convolve(x, kernel)[full] / np.convolve(np.ones_like(x), kernel)[full]


def threshold(x: np.ndarray) -> float:
    """Midpoint of the two means that split the values; their minimum if they are all alike."""
    low, high = float(x.min()), float(x.max())
    if high - low < 1e-9:
        return low
    while True:
        cut = (low + high) / 2
        new = float(x[x < cut].mean()) if (x < cut).any() else low, float(x[x >= cut].mean())
        if abs(new[0] - low) + abs(new[1] - high) < 1e-6:
            return cut
        low, high = new


def main_text(html: str | None) -> str:
    """The page's main text; blocks are joined by line feeds."""
    if not html:
        return ""
    cut = html.rfind("<")
    if cut >= 0 and ">" not in html[cut:] and re.match(r"<[A-Za-z/!?]", html[cut : cut + 2]):
        html = html[:cut]  # a tag that the page's end cuts off
    page = _Blocks()
    page.feed(html)
    page.finish()
    forms = _widgets(page)
    out = page.within(lambda e: page.aside[e] or e in forms)
    whole = [b for b in page.blocks if not out[b[2]]]
    blocks = _without(whole, page, LOOSE) or _without(whole, page, READER)
    if not blocks:
        return ""
    ratio = smooth(np.array([len(t) / max(1, tags) for t, tags, *_ in blocks]))
    chosen = [(b[2], 1) for b, c in zip(blocks, (ratio >= threshold(ratio)).tolist(), strict=True) if c]
    held = page.sums(chosen)
    around = [e for e in range(1, len(held)) if held[e] == len(chosen)]  # each inside the one before
    if article := max((e for e in around if page.names[e] in ("article", "main")), default=0):
        return _joined(blocks, page, _articles(article, page))
    return _joined(blocks, page, {_climbed(around, blocks, page)})


def _joined(blocks, page: _Blocks, regions: set[int]) -> str:
    inside = page.within(lambda e: e in regions)
    return "\n".join(b[0] for b in blocks if 0 in regions or inside[b[2]])


def _widgets(page: _Blocks) -> set[int]:
    """The forms that are no wrappers of the page's text."""
    if "form" not in page.names:
        return set()
    named = lambda names: page.sums([(e, 1) for e, n in enumerate(page.names) if n in names])
    whole, heads, text, fields = named(("h1", "article", "main")), named(HEADINGS), named(("p",)), page.sums(page.fields)
    return {e for e, n in enumerate(page.names) if n == "form" and not whole[e] and not (heads[e] and text[e] > fields[e])}


def _without(blocks, page: _Blocks, least: int) -> list:
    """The blocks that are not in what words of a level or more set aside."""
    marked = page.within(lambda e: page.names[e] in ("article", "main"))
    held, total = page.sums([(b[2], 1) for b in blocks if marked[b[2]]]), sum(marked[b[2]] for b in blocks)
    top = page.sums([(b[2], 1) for b in blocks if page.names[b[3]] == "h1"])

    def counts(e: int) -> bool:
        level = page.worded[e]
        if level < least or (total and held[e] == total):
            return False
        if marked[e]:
            return level == READER or (level == STRICT and 2 * held[e] <= total)
        return bool(total) or not top[e]

    aside = page.within(counts)
    return [b for b in blocks if not aside[b[2]]]


def _articles(article: int, page: _Blocks) -> set[int]:
    """An article and those beside it: of the main element around them, else of the same parent."""
    if page.names[article] == "main":
        return {article}
    home = page.around[article]
    while home and page.names[home] != "main":
        home = page.around[home]
    if home:
        inside = page.within(lambda e: e == home)
        others = {e for e, n in enumerate(page.names) if n == "article" and inside[e]}
        return {home} if len(others) > 1 and any(not _holds(page, o, article) and not _holds(page, article, o) for o in others) else {article}
    return {e for e, n in enumerate(page.names) if n == "article" and page.around[e] == page.around[article]}


def _holds(page: _Blocks, outer: int, inner: int) -> bool:
    while inner > outer:
        inner = page.around[inner]
    return inner == outer


def _climbed(around: list[int], blocks, page: _Blocks) -> int:
    """The innermost of the elements around the content with more than one block, or one outside of it: up to where other than headings and running text is added."""
    every = page.sums([(b[2], 1) for b in blocks])
    other = page.sums([(b[2], 1) for b in blocks if page.names[b[3]] not in HEADINGS and (page.names[b[3]] not in RUNNING or 2 * b[4] >= len(b[0]))])
    region = max((e for e in around if every[e] > 1 or len(blocks) == 1), default=0)
    while region and other[page.around[region]] == other[region]:
        region = page.around[region]
    return region


def extract(pages: DataFrame) -> DataFrame:
    """One row for each input row: page_id, url, text, n_chars."""

    def run(batches):
        for batch in batches:
            for r0 in range(0, batch.num_rows, 500):
                part = batch.slice(r0, 500)
                texts = [main_text(h.as_py()) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.selectExpr("cast(page_id as long) as page_id", "cast(url as string) as url", "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
