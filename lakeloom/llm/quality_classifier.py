"""Quality classification of documents by supervised subword embeddings (see `_subword`).

The model learns from a bounded sample of labelled documents (`sample` ids, by a hash of the
id) whose crc32(doc_id) mod 4 is not 2, and only from their text; scores use the whole text. Texts
of more than `LONGEST` characters are scored but not learned from, so the sample's bytes are bounded.

Defined cases: a null or empty text has no feature and gets the prior's score; labels that are
null are not learned; an id that is labelled more than once counts once, with its highest label,
and one that several documents share counts once, with the least of their texts; without any labels every score is
1 (nothing is rejected); a null doc_id is scored and not held out; rows that repeat stay; an
empty table returns no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ._subword import SubwordModel

SAMPLE = 3000
#: Characters of a text that is learned from, at most; with the sample it bounds what the driver gets.
LONGEST = 50_000
THRESHOLD = 0.7


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """Whether the crc32 of the id, as text, leaves this remainder."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % mod == rest, F.lit(False))


def texts_of(docs: DataFrame, chosen: DataFrame, label: str) -> list[Row]:
    """(doc_id, label, text) of chosen ids (distinct, a bounded number): of each the least text of at most LONGEST characters."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).filter(F.length("text") <= LONGEST)
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", label).agg(F.min("text").alias("text")).collect()


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> SubwordModel | None:
    """A model of `quality` from at most `sample` labelled ids that are not held out."""
    usable = labels.filter("quality is not null and doc_id is not null").filter(~held_out(F.col("doc_id"), 4, 2))
    chosen = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = texts_of(docs, chosen, "quality")
    rows.sort(key=lambda r: (r.doc_id * 2654435761 % 2**32, r.doc_id))
    if len({r.quality for r in rows}) < 2:
        return None
    return SubwordModel.fit([r.text for r in rows], [r.quality for r in rows])


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each input row: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))  # a model has a fixed size

    def run(batches):
        model = shared.value
        for batch in batches:
            if model is None:
                score = np.ones(batch.num_rows)
            else:
                score = model.probabilities(batch.column(2))[:, model.labels.index(1) if 1 in model.labels else -1]
            predicted = (score >= threshold).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array(predicted)], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), 4, 2).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with their columns, that the classifier does not reject."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))
    at = docs.columns.index("text")

    def run(batches):
        model = shared.value
        for batch in batches:
            if model is not None:
                score = model.probabilities(batch.column(at))[:, model.labels.index(1) if 1 in model.labels else -1]
                batch = batch.filter(pa.array(score >= threshold))
            yield batch

    return docs.mapInArrow(run, docs.schema)
