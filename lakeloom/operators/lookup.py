"""Lookups against dimensions, membership flags, interval lookups and set differences.

A side is broadcast only if its rows and bytes, counted first, are within BROADCAST_ROWS and BROADCAST_BYTES.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .positional import value_ranges

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has at most so many rows, and these at most BROADCAST_BYTES of text."""
    cells = [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(1)) for c in df.columns]
    n, size = df.limit(most + 1).agg(F.count("*"), F.sum(sum(cells, F.lit(0)))).first()
    return F.broadcast(df) if n <= most and (size or 0) <= BROADCAST_BYTES else df


def first_match(rows: DataFrame, dimension: DataFrame, on: Column, order: str, row_key: str, keep: list[str]) -> DataFrame:
    """Left join to the first matching dimension row in the dimension's order."""
    best = F.min_by(F.struct(*keep), order)
    hits = rows.select(row_key, *[c for c in rows.columns if c != row_key]).join(small(dimension), on)
    chosen = hits.groupBy(row_key).agg(best.alias("_hit")).select(row_key, *(F.col(f"_hit.{c}").alias(c) for c in keep))
    return rows.join(chosen, row_key, "left")


def mark(rows: DataFrame, members: DataFrame, key: str, flag: str) -> DataFrame:
    """A boolean column: whether the key is among the members."""
    known = members.select(F.col(key)).distinct().withColumn("_in", F.lit(True))
    return rows.join(known, key, "left").withColumn(flag, F.coalesce("_in", F.lit(False))).drop("_in")


def not_equal(c: Column, value) -> Column:
    """Inequality that keeps missing values."""
    return ~c.eqNullSafe(F.lit(value))


def active_section(points: DataFrame, bounds: DataFrame, x: str, bound: str, label: str, ranges: int | None = None) -> DataFrame:
    """The label of the last bound at or below x; none below the first.

    Both sides are sorted together by one union and a running last value, so nothing is
    compared pair by pair. Rows are first dealt into ranges of the value; each range takes the
    last bound before it.
    """
    both = points.select(F.col(x).alias("_v"), F.lit(1).alias("_o"), F.struct(*points.columns).alias("_p"), F.lit(None).cast(bounds.schema[label].dataType).alias("_l")).unionByName(
        bounds.select(F.col(bound).alias("_v"), F.lit(0).alias("_o"), F.lit(None).cast(points.select(F.struct(*points.columns).alias("p")).schema["p"].dataType).alias("_p"), F.col(label).alias("_l"))
    )
    part, n = value_ranges(both.select(F.col("_v").cast("double").alias("_v")), F.col("_v"), ranges)
    both = both.withColumn("_part", part)
    edge = both.filter("_o = 0").groupBy(F.col("_part").alias("_q")).agg(F.max(F.struct(F.col("_v").alias(bound), F.col("_l").alias(label))).alias("_b"))
    carried = F.broadcast(both.sparkSession.range(n).select(F.col("id").cast("int").alias("_part")).join(edge, F.col("_q") < F.col("_part")).groupBy("_part").agg(F.max("_b").alias("_b")))
    run = F.last("_l", ignorenulls=True).over(Window.partitionBy("_part").orderBy("_v", "_o").rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("_run", run).filter("_o = 1").join(carried, "_part", "left")
    return out.select("_p.*", F.coalesce("_run", F.col(f"_b.{label}")).alias(label))


def both_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one side has, with that side's name."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


#: URL schemes that count as safe, and the media types of data URLs that do.
SCHEMES = ("http", "https", "mailto", "ftp", "tel", "file", "sms")
MEDIA = ("image/bmp", "image/gif", "image/jpeg", "image/jpg", "image/png", "image/tiff", "image/webp", "video/mpeg", "video/mp4", "video/ogg", "video/webm", "audio/mp3", "audio/oga", "audio/ogg", "audio/opus")


def safe_url(url: Column) -> Column:
    """Whether a URL is relative, has a safe scheme, or is base64 data of a listed media type."""
    before = F.substring_index(url, ":", 1)
    relative = F.regexp_extract(url, "[#&/:?]", 0).isin("", "#", "/", "?")  # what comes first of these tells
    kind, data = F.substring_index(url, ";base64,", 1), F.substring_index(url, ";base64,", -1)
    is_data = F.contains(url, F.lit(";base64,")) & F.lower(kind).isin(*(f"data:{m}" for m in MEDIA)) & (F.rtrim(F.translate(data, "+/", "00"), F.lit("=")).rlike("^[0-9A-Za-z]+$"))
    return relative | (F.contains(url, F.lit(":")) & F.lower(before).isin(*SCHEMES)) | is_data


def allowed(attributes: DataFrame, allow: DataFrame, safe=safe_url) -> DataFrame:
    """Attributes on the list of their tag (or of tag *); URL attributes only where `safe` says so."""
    rules = allow.select(F.col("tag").alias("_tag"), F.col("pattern").alias("_pattern"))
    each = attributes.withColumn("_tag", F.explode(F.array(F.lit("*"), F.col("tag"))))
    hits = each.join(small(rules), "_tag").filter(F.rlike("attr", F.col("_pattern")))
    listed = hits.select(attributes.columns).distinct()
    return listed.filter(~F.col("attr").isin("href", "src") | safe(F.col("value")))
