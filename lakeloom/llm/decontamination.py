"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Texts are lower-cased, cut into words of letters and digits, and shingled by five words; an item of
one to four words is one shingle of its own length, looked up among all shingles of that length. An
item is in a document if the document holds at least `threshold` of the item's distinct shingles,
anywhere. Items are partitioned by size (powers of two of their shingle count). A partition whose
largest item has u shingles keeps the floor((1 - threshold) * u) + 1 smallest hashes of each
item: a document with enough of the item cannot miss all of these, so no match is lost, however
long the document is. Documents probe these sketches with all their shingle hashes; candidate
documents are then compared shingle by shingle, as text.

Defined cases: null texts and texts without a word hold no shingle, so such an item is found nowhere
and such a document is clean; texts of any length are read whole; rows that repeat a doc_id count as one document;
rows that repeat an item_id with other text each contribute shingles to that item; an empty
table gives no rows; a null doc_id or item_id is not reported. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._stage import Stage

WORDS = 5
THRESHOLD = 0.8
#: Sketches are broadcast up to this many rows (16 bytes each); beyond, the join is left to the planner.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    """Words of letters and digits, lower-cased; empty for a text without any."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def _each(n: int | Column, form) -> Column:
    """form(slice of n words) at each start; empty where there are fewer words."""
    last = F.size("words") - (F.lit(n) if isinstance(n, int) else n) + 1
    starts = F.when((last >= 1) & (F.size("words") > 0), F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: form(F.slice("words", i, n)))


def _text(slice_: Column) -> Column:
    return F.array_join(slice_, " ")


def item_shingles(items: DataFrame, n: int = WORDS) -> DataFrame:
    """Distinct (item_id, shingle, len): shingles of n words, of a shorter item its whole text, and their words."""
    worded = items.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("words")).withColumn("len", F.least(F.size("words"), F.lit(n)))
    return worded.select("item_id", F.explode(F.array_distinct(_each(F.col("len"), _text))).alias("shingle"), "len").filter("item_id is not null").distinct()


def shingles(worded: DataFrame, lengths: list[int], form) -> DataFrame:
    """(doc_id, shingle): all shingles of the lengths in (doc_id, words)."""
    return worded.select("doc_id", F.explode(F.concat(*(_each(k, form) for k in lengths))).alias("shingle"))


def sketches(items: DataFrame, threshold: float) -> DataFrame:
    """(item_id, h): each item's smallest shingle hashes, as many as its size partition asks for."""
    sizes = items.groupBy("item_id").agg(F.collect_set(F.xxhash64(F.split("shingle", " "))).alias("hashes"), F.count_distinct("shingle").alias("n"))
    sizes = sizes.withColumn("part", F.ceil(F.log2("n")))
    bounds = sizes.groupBy("part").agg(F.max("n").alias("u"))
    spare = F.floor(F.lit(round(1 - threshold, 9)) * F.col("u") + F.lit(1e-9)).cast("int") + 1
    return sizes.join(bounds, "part").select("item_id", F.explode(F.slice(F.array_sort("hashes"), F.lit(1), spare)).alias("h"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, n: int = WORDS) -> DataFrame:
    """Pairs (doc_id, item_id, n_item, n_shared, containment) with containment >= threshold."""
    stage = Stage(docs.sparkSession, "decontamination")
    items = stage.keep(item_shingles(benchmark, n))
    lengths = sorted({n, *(r.len for r in items.select("len").distinct().collect())})  # at most n values
    mins = stage.keep(sketches(items, threshold))
    if mins.count() <= BROADCAST_ROWS:
        mins = F.broadcast(mins)
    held = docs.filter("doc_id is not null")
    worded = held.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("words"))
    probes = shingles(worded, lengths, F.xxhash64).withColumnRenamed("shingle", "h")
    candidates = stage.keep(probes.join(mins, "h").select("doc_id", "item_id").distinct())
    found = worded.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")
    shared = shingles(found, lengths, _text).distinct().join(items.drop("len"), "shingle").groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"))
    sizes = items.groupBy("item_id").agg(F.count_distinct("shingle").alias("n_item"))
    pairs = shared.join(candidates, ["doc_id", "item_id"], "left_semi").join(sizes, "item_id")
    enough = pairs.withColumn("containment", F.col("n_shared") / F.col("n_item")).filter(F.col("containment") >= threshold)
    return enough.select("doc_id", "item_id", "n_item", "n_shared", "containment")
