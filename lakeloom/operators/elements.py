"""The element tree of HTML pages as a table of intervals, and lookups along it.

Each element has its number in document order (`pre`) and the number after its last descendant
(`stop`), so `a` holds `b` exactly if a.pre < b.pre < a.stop. Lookups use equality of keys, or one
pass over the interval ends of a page in order; elements are never compared in pairs. A page is
one document and its elements meet in one task; pages are spread.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import slices

#: Elements without content, and those whose start ends an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Elements whose start ends an open one of these, unless one of the last set stands between.
SIBLINGS = {"li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")), "option": (("option",), ("select",))}

_ATTRS = pa.map_(pa.string(), pa.string())
_ELEMENT = pa.struct([("pre", pa.int32()), ("stop", pa.int32()), ("depth", pa.int32()), ("parent", pa.int32()), ("tag", pa.string()), ("attrs", _ATTRS)])


class _Tree(HTMLParser):
    """Numbers the elements of a page; an end tag closes its innermost open element and all inside, or nothing."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[dict] = []
        self.open: list[int] = []
        self.count: dict[str, int] = {}

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS and self.count.get("p"):
            self._close(("p",), ("button", "table", "td", "th"))
        if tag in SIBLINGS:
            self._close(*SIBLINGS[tag])
        at = len(self.found)
        self.found.append({"pre": at, "stop": at + 1, "depth": len(self.open), "parent": self.open[-1] if self.open else None, "tag": tag, "attrs": [(k, v or "") for k, v in {k: v for k, v in reversed(attrs)}.items()]})
        if tag not in VOID:
            self.open.append(at)
            self.count[tag] = self.count.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.count.get(tag):
            self._close((tag,), ())

    def _close(self, tags: tuple[str, ...], limits: tuple[str, ...]) -> None:
        if not any(self.count.get(t) for t in tags):
            return
        for i in range(len(self.open) - 1, -1, -1):
            name = self.found[self.open[i]]["tag"]
            if name in tags:
                return self._end(i)
            if name in limits:
                return None

    def _end(self, first: int) -> None:
        for at in self.open[first:]:
            self.found[at]["stop"] = len(self.found)
            self.count[self.found[at]["tag"]] -= 1
        del self.open[first:]


def tree(html: str | None) -> list[dict]:
    parser = _Tree()
    parser.feed(html or "")
    parser.close()
    parser._end(0)
    return parser.found


def elements(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pre, stop, depth, parent, tag, attrs): every element of each page.

    parent is the pre of the enclosing element, null for a root. Names are in lower case; of
    repeated attributes the first counts. Paragraphs, list items, terms, rows, cells and options end
    where the next one starts; end tags without a start, and text outside of tags, are left out. A
    null or empty page has no elements.
    """

    def run(batches):
        for batch in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(tree, batch.column(1).to_pylist()), pa.list_(_ELEMENT))], names=[key, "found"])

    kind = dict(pages.dtypes)[key]
    parsed = pages.select(key, html).mapInArrow(run, f"`{key}` {kind}, found array<struct<pre: int, stop: int, depth: int, parent: int, tag: string, attrs: map<string, string>>>")
    return parsed.select(key, F.explode("found").alias("e")).select(key, "e.*")


def has_class(name: str) -> Column:
    return F.array_contains(F.split(F.coalesce(F.element_at("attrs", F.lit("class")), F.lit("")), r"\s+"), name)


def attribute(name: str) -> Column:
    """Value of an attribute, null where there is none."""
    return F.element_at("attrs", F.lit(name))


def children(found: DataFrame, key: str, of: Column, selector: Column) -> DataFrame:
    """(key, parent, pre): the children that match `selector`, of the elements that match `of`."""
    parents = found.filter(of).select(key, F.col("pre").alias("parent"))
    return found.filter(selector).select(key, "parent", "pre").join(parents, [key, "parent"])


def siblings(found: DataFrame, key: str, selector: Column) -> DataFrame:
    """The elements with `prev` and `next`: the nearest matching sibling before and after."""
    w = Window.partitionBy(key, "parent").orderBy("pre")
    hit = F.when(selector, F.col("pre"))
    return found.withColumns({
        "prev": F.last(hit, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        "next": F.first(hit, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)),
    })


def _levels(found: DataFrame, key: str, selector: Column) -> DataFrame:
    """(key, pre, match, level): how many matching elements are open around each element.

    Ends come before starts at the same place, so an element's own match does not count.
    """
    starts = found.select(key, F.col("pre").alias("place"), F.lit(1).alias("side"), F.coalesce(selector, F.lit(False)).alias("match"), "stop")
    ends = starts.filter("match").select(key, F.col("stop").alias("place"), F.lit(0).alias("side"), F.lit(True).alias("match"), "stop")
    step = F.when(F.col("match"), F.when(F.col("side") == 1, 1).otherwise(-1)).otherwise(0)
    w = Window.partitionBy(key).orderBy("place", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return starts.unionAll(ends).withColumn("level", F.sum(step).over(w) - step).filter("side = 1").select(key, F.col("place").alias("pre"), "match", "level")


def _open_at(levels: DataFrame, key: str, asked: DataFrame) -> DataFrame:
    """asked (key, pre, level) with `ancestor`: the matching element of that level that is open there.

    It is the last one of the level that has been opened before.
    """
    opened = levels.filter("match").select(key, "pre", (F.col("level") + 1).alias("level"), F.col("pre").alias("who"))
    rows = asked.select(key, "pre", "level", F.lit(None).cast("int").alias("who")).unionAll(opened)
    w = Window.partitionBy(key, "level").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("ancestor", F.last("who", ignorenulls=True).over(w)).filter("who is null").drop("who")


def closest(found: DataFrame, key: str, selector: Column) -> DataFrame:
    """(key, pre, closest): the element itself if it matches, else its nearest matching ancestor, if any."""
    levels = _levels(found, key, selector)
    itself = levels.filter("match").select(key, "pre", F.col("pre").alias("closest"))
    above = _open_at(levels, key, levels.filter("not match and level > 0")).select(key, "pre", F.col("ancestor").alias("closest"))
    return itself.unionAll(above)


def parents(found: DataFrame, key: str, selector: Column) -> DataFrame:
    """(key, pre, ancestor, nth): every matching ancestor of each element, the nearest as the first."""
    levels = _levels(found, key, selector)
    asked = levels.filter("level > 0").select(key, "pre", F.col("level").alias("most"), F.explode(F.sequence(F.lit(1), "level")).alias("level"))
    most = asked.select(key, "pre", "most", "level")
    return _open_at(levels, key, asked).join(most, [key, "pre", "level"]).select(key, "pre", "ancestor", (F.col("most") - F.col("level") + 1).alias("nth"))


def delegated(events: DataFrame, found: DataFrame, key: str, target: str, selector: Column) -> DataFrame:
    """Events (key, target element, ...) whose target matches or stands inside a match, with `handler`, that element."""
    near = closest(found, key, selector).select(key, F.col("pre").alias(target), F.col("closest").alias("handler"))
    return events.join(near, [key, target])
