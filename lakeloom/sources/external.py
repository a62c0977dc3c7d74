"""Posts of configured sources, read by the kind of each source."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables


@dataclass(frozen=True)
class Source:
    """A named source: the path of a feed, or posts that a table lists under its name.

    trim: white space around the values of the feed is layout.
    """

    name: str
    feed: str | None = None
    listed: bool = False
    trim: bool = True


def posts(sources: Sequence[Source], listed: DataFrame) -> DataFrame:
    """(source, title, link, published) of all sources; listed: (source, title, link, published), text dates.

    A feed goes before listed posts; a source with neither has none. Listed posts without a title are
    named by their link. Dates stay as the source writes them.
    """
    spark = listed.sparkSession
    cols = ["source", "title", "link", "published"]
    out = []
    for path, trim in dict.fromkeys((s.feed, s.trim) for s in sources if s.feed):
        names = [s.name for s in sources if (s.feed, s.trim) == (path, trim)]
        items = tables.rss_items(spark, path, "title string, link string, pubDate string", trim).withColumnRenamed("pubDate", "published")
        out.append(items.withColumn("source", F.explode(F.array(*map(F.lit, names)))).select(cols))
    names = [s.name for s in sources if s.listed and not s.feed]
    own = listed.filter(F.col("source").isin(*names)) if names else listed.limit(0)
    out.append(own.withColumn("title", F.coalesce("title", "link")).select(cols))
    return reduce(DataFrame.unionByName, out)
