"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A text is cut after content marks (see CUT), so equal texts have equal chunks. Each distinct
chunk gets an identifier that is verified: within one identifier all chunk contents are compared
(their least and greatest must agree). A document is then the ordered list of its chunks'
identifiers, and only these short lists are grouped and joined; the texts themselves move at
most once, as chunks that are already distinct within a map task.

Defined cases: null text counts as empty; texts are equal when identical after lower-casing A-Z
only; of equal texts the largest doc_id stays (rows that repeat that doc_id stay with it; null
is smaller than any); an empty table returns no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._stage import Stage

#: A chunk ends at the first line end, or word that ends in e or s, after 512 characters; at 4096 at the latest.
CUT = r"(?s).{512,4096}?(?:\n|[es] )|.{1,4096}"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; null is empty. Texts of ASCII alone take the short way."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def sha256_id(chunk: Column) -> Column:
    return F.unhex(F.sha2(chunk, 256))


def chunked(docs: DataFrame) -> DataFrame:
    norm = docs.select(F.col("doc_id").cast("long").alias("doc_id"), ascii_lower(F.col("text")).alias("norm"))
    return norm.select("doc_id", "norm", F.regexp_extract_all("norm", F.lit(CUT), F.lit(0)).alias("chunks"))


def verified(docs: DataFrame, chunk_id: Callable[[Column], Column] = sha256_id) -> bool:
    """Whether every chunk identifier stands for one content over the whole table."""
    chunks = chunked(docs).select(F.explode("chunks").alias("chunk"))
    ids = chunks.groupBy(chunk_id(F.col("chunk")).alias("id")).agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi"))
    return ids.filter("lo <> hi").limit(1).count() == 0


def exact_dedup(docs: DataFrame, chunk_id: Callable[[Column], Column] = sha256_id) -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256.

    If identifiers clash, the chunks' contents serve as identifiers instead.
    """
    if not verified(docs, chunk_id):
        chunk_id = lambda chunk: chunk.cast("binary")
    stage = Stage(docs.sparkSession, "exact-dedup")
    recipes = stage.keep(chunked(docs).select("doc_id", F.sha2("norm", 256).alias("text_sha256"), F.transform("chunks", chunk_id).alias("recipe")))
    # written first: a join of two plain tables lets Spark split a recipe that a third of all rows share
    groups = stage.keep(recipes.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1"))
    joined = recipes.join(groups, "recipe", "left")
    alone = F.col("group_size").isNull()
    keep_id = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select("doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), "text_sha256")
