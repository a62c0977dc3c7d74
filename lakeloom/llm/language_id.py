"""Language identification by averaged hashed subword embeddings (see `_subword`).

The model learns from at most `sample` ids of each language (by a hash of the id) whose
crc32(doc_id) mod 3 is not 1, and only from their text and lang; texts of more than LONGEST
characters are not learned from, so the sample's bytes are bounded. A prediction below the rejection
level, the score under which held-back training texts were right less often than `precision`, is
marked by accepted = false; its lang_pred stays the likeliest language.

Defined cases: a null text, or one without a letter, is `und` with score 0, not accepted; rows
with a null lang are not learned from; an id that several rows share counts once, with the least
of their languages and texts; with one language only, that is predicted; with none, all
are `und`; a null doc_id is predicted and not held out; repeated rows stay; an empty table
returns no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._subword import SubwordModel, unseen
from .quality_classifier import LONGEST, held_out, texts_of

SAMPLE = 800
PRECISION = 0.98


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple[SubwordModel | None, float]:
    """A model from at most `sample` ids of each language that are not held out, and its rejection level."""
    usable = docs.filter("lang is not null and text is not null and doc_id is not null").filter(~held_out(F.col("doc_id"), 3, 1)).filter(F.length("text") <= LONGEST)
    ids = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("lang").cast("string")).alias("lang"))
    # about 2 * sample + 200 ids of each language go on, those of the smallest hashes, so that the ranking task of a language stays small; a language of fewer ids keeps all
    sizes = ids.groupBy("lang").count().withColumn("part", F.least(F.lit(1.0), (2 * sample + 200) / F.col("count")))  # one row for each language
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    few = ids.join(F.broadcast(sizes), "lang").filter(place <= F.col("part")).select("doc_id", "lang", place.alias("place"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id"))
    chosen = few.withColumn("rank", rank).filter(F.col("rank") <= sample).select("doc_id", "lang")
    rows = texts_of(docs.filter("text is not null"), chosen, "lang")  # `sample` ids for each language
    rows.sort(key=lambda r: (r.doc_id * 2654435761 % 2**32, r.doc_id))
    if not rows:
        return None, 1.0
    model = SubwordModel.fit([r.text for r in rows], [r.lang for r in rows], epochs=4)
    back = [r for r, u in zip(rows, unseen(len(rows)), strict=True) if u]
    return model, rejection_level(model, [r.text for r in back], [r.lang for r in back])


def rejection_level(model: SubwordModel, texts: list[str], langs: list[str], precision: float = PRECISION) -> float:
    """The least score from which on at least `precision` of the texts are predicted right."""
    if not texts:
        return 0.0
    p = model.probabilities(pa.array(texts, pa.string()))
    right = np.array([model.labels[i] for i in p.argmax(axis=1)]) == np.array(langs)
    order = np.argsort(-p.max(axis=1), kind="stable")
    share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(share >= precision)
    return float(p.max(axis=1)[order][good[-1]]) if len(good) else 1.0


def language(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row for each input row: doc_id, held_out, lang_pred, score, accepted."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, sample))  # of fixed size for each language

    def run(batches):
        model, level = shared.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            lettered = np.array([any(map(str.isalpha, t or "")) for t in texts], dtype=bool)
            if model is None:
                lettered[:] = False
                best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            else:
                p = model.probabilities(batch.column(2))
                best, score = p.argmax(axis=1), p.max(axis=1)
            names = [model.labels[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
            score = np.where(lettered, score, 0.0)
            cols = [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score), pa.array((score >= level) & lettered)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "lang_pred", "score", "accepted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), 3, 1).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")
