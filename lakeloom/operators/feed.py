"""A feed from raw pages: extraction with fallbacks, order with ties broken, rendering, staleness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text
from .positional import global_ordinal


def posts(pages: DataFrame, key: str, html: str, url: Column, modified: Column) -> DataFrame:
    """Title, description, link, image and date of each page that has a title."""
    h = F.col(html)
    meta = lambda k, v: text.html_attribute(h, "meta", k, v, "content")
    return pages.select(
        key,
        text.unescape(F.coalesce(meta("property", "og:title"), text.first_match(h, "<title>(.*?)</title>"))).alias("title"),
        text.unescape(F.coalesce(meta("property", "og:description"), meta("name", "description"), F.lit(""))).alias("description"),
        F.coalesce(text.html_attribute(h, "link", "rel", "canonical", "href"), meta("property", "og:url"), url).alias("link"),
        meta("property", "og:image").alias("image"),
        F.coalesce(dates.parse_post_date(F.regexp_extract(h, r"(?is)Created in ([^<]*)", 1)).cast("timestamp"), modified).alias("pub_date"),
    ).filter("title is not null")


#: Line ends as references, which readers do not change.
_LINE_ENDS = (("\r", "&#13;"), ("\n", "&#10;"))


def items(found: DataFrame, whole: bool = False) -> DataFrame:
    """Posts as ranked items, latest first, ties by link, then by the other columns as they stand; rank starts at 1.

    The xml of a post without link or date is null, and texts are escaped only. whole: each post
    has an item, of one line, that reads back as the post: a missing link or date leaves its
    element out, line ends are written as references, and a control character, which XML cannot
    hold, becomes U+FFFD.
    """
    order = found.withColumn("_late", -F.unix_micros("pub_date"))
    ties = [F.col("link"), *(F.col(c) for c in found.columns if c not in ("link", "pub_date"))]
    ranked = global_ordinal(order, "_late", *ties, name="rank").withColumn("rank", F.col("rank") + 1).drop("_late")

    def written(c: Column) -> Column:
        if not whole:
            return text.escape(c)
        return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), _LINE_ENDS, F.regexp_replace(text.escape(c), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "\ufffd"))

    line = lambda tag, c: F.concat(F.lit(f"<{tag}>"), written(c), F.lit(f"</{tag}>"))
    enclosure = F.when(F.col("image").isNotNull(), F.concat(F.lit('<enclosure url="'), written(F.col("image")), F.lit('"/>'))).otherwise("")
    joined = (lambda *c: F.concat_ws("", *c)) if whole else F.concat  # the former passes nulls over
    xml = joined(F.lit("<item>"), line("title", F.col("title")), line("link", F.col("link")), line("pubDate", dates.rfc822(F.col("pub_date"))), line("description", F.col("description")), enclosure, F.lit("</item>"))
    return ranked.withColumn("xml", xml)


def last_build(found: DataFrame, default: str) -> DataFrame:
    """The latest date, formatted; the default for an empty table."""
    latest = F.coalesce(F.max("pub_date"), F.to_timestamp(F.lit(default)))
    return found.agg(dates.rfc822(latest).alias("last_build"))


def render(ranked: DataFrame, title: str, path: str) -> None:
    """Writes the feed: a head line, the items in rank order over many files, a closing line."""
    head = ranked.sparkSession.createDataFrame([(0, f"<rss version='2.0'><channel><title>{title}</title>"), (2**62, "</channel></rss>")], "rank long, xml string")
    ranked.select("rank", "xml").unionByName(head).orderBy("rank").select("xml").write.mode("overwrite").text(path)


def stale(current: DataFrame, golden: DataFrame, key: str, body: str) -> DataFrame:
    """Rows that are missing, new or changed against the golden copy, compared by digest."""
    a = current.select(key, F.md5(F.trim(body)).alias("now"))
    b = golden.select(key, F.md5(F.trim(body)).alias("was"))
    state = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "missing").when(F.col("was") != F.col("now"), "changed")
    return a.join(b, key, "full_outer").select(key, state.alias("state")).filter("state is not null")
