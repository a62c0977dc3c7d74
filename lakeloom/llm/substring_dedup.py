"""Substring deduplication over word windows, with a log-structured fingerprint index.

The index is a list of immutable runs, each a table in buckets of the fingerprint and sorted by it
inside each bucket. A run row stands for one stretch of windows (see `_windows`): its anchor
fingerprint `fp`, the 128-bit digest of its words (`sup`, `proof`), where it starts first, and how
often it occurs. A batch of new documents is dealt into the same buckets once and makes one sorted
run; the run is merge-joined with the older ones bucket by bucket, with no exchange and no sort of
these; stretches that share `fp` but not their words are verified window by window, from the words
themselves by 128-bit BLAKE2b digests; then, when there are `fanout` runs, they are compacted into
one before the next batch. The texts that the index has seen lie in buckets of the document id, so
that a text is shuffled once, on arrival; later batches read it where fingerprints need verifying.

Batches come in the order of doc_id, so all that is in the index starts earlier.

Defined cases: a null or empty text has no words and loses none; fewer than `window` words make
no window; of equal windows in one document the earlier start stays; words and texts of any length
are read whole; rows that repeat a doc_id with its text count as one document and all return its
result; a null doc_id sorts first; an empty table returns no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _kernel as K
from . import _windows as W
from ._stage import Stage

WINDOW = 20
GRAM = 6
_NULL = np.iinfo(np.int64).min
_SORT = ("sup", "proof")


class FingerprintIndex:
    """Sorted runs of window fingerprints; `add` merges a batch and returns the spans it repeats."""

    def __init__(self, spark: SparkSession, window: int = WINDOW, gram: int = GRAM, fanout: int = 2):
        self.spark, self.window, self.gram, self.fanout = spark, window, gram, fanout
        self.stage = Stage(spark, "substring-dedup")
        self.runs: list[DataFrame] = []
        self.texts: list[DataFrame] = []

    def close(self) -> None:
        """Frees the runs; the texts and the spans found stay."""
        self.stage.drop(*self.runs)
        self.runs = []

    def add(self, batch: DataFrame) -> DataFrame:
        """Merges documents (doc_id, text) that are all later than those added before.

        Returns (doc_id, spans) of the batch's words that an earlier window covers.
        """
        if len(self.runs) >= self.fanout:
            self._compact()
        keep = self.stage.keep
        texts = keep(batch.select(F.coalesce("doc_id", F.lit(_NULL)).alias("key"), "doc_id", "text"), by="key")
        rows = keep(W.anchor_rows(batch, "word", self.window, self.gram), by="fp", order=_SORT)
        firsts = rows.filter("copies > 0")
        run = keep(W.heads(firsts), by="fp", order=_SORT, dealt=True)
        # merge-join: the earliest start of each stretch of the batch that is not new
        known = run.select(*W.SAME, F.struct("doc_id", "pos").alias("head"), "copies")
        for old in self.runs:
            past = old.select(*W.SAME, F.struct("doc_id", "pos").alias("past"))
            known = known.join(past.hint("merge"), W.SAME, "left").select(*W.SAME, F.least("head", "past").alias("head"), F.when(F.col("past").isNotNull(), 2).otherwise(F.col("copies")).alias("copies"))
        repeated = keep(known.filter("copies > 1").select(*W.SAME, "head"), by="fp", order=_SORT, dealt=True)
        later = firsts.join(repeated.hint("merge"), W.SAME).filter((F.col("doc_id") != F.col("head.doc_id")) | (F.col("pos") != F.col("head.pos")))
        settled = keep(W.by_document(W.spans(rows.filter("copies = 0"), self.window), W.spans(later, self.window)))
        self.stage.drop(rows, repeated)
        self.texts.append(texts)
        passing, late = self._verify(run)
        found = keep(W.joined_lists(settled, W.by_document(late)))
        self.stage.drop(settled, *passing)
        self.runs.append(run)
        return found

    def _mixed(self, run: DataFrame) -> DataFrame:
        """The fps of the run whose stretches, old ones included, are not all the same."""
        ends = lambda r, lo, hi: r.groupBy("fp").agg(F.min(F.struct(*_SORT)).alias(lo), F.max(F.struct(*_SORT)).alias(hi))
        shared = ends(run, "lo", "hi")
        for old in self.runs:
            shared = shared.join(ends(old, "a", "b").hint("merge"), "fp", "left").select("fp", F.least("lo", "a").alias("lo"), F.greatest("hi", "b").alias("hi"))
        return shared.filter("lo <> hi").select("fp")

    def _verify(self, run: DataFrame) -> tuple[list[DataFrame], DataFrame]:
        """(tables to drop, spans): windows in stretches whose anchor is shared but whose words are not, one by one."""
        window, keep = self.window, self.stage.keep
        shared = keep(self._mixed(run), by="fp", dealt=True)
        at = F.struct("fp", "first", "last", "new").alias("at")
        found = [r.withColumn("new", F.lit(r is run)).join(shared.hint("merge"), "fp").select("doc_id", at) for r in (run, *self.runs)]
        stretches = keep(reduce(DataFrame.unionByName, found).groupBy(F.col("doc_id").alias("key")).agg(F.collect_list("at").alias("at")), by="key")
        schema = "w1 long, w2 long, doc_id long, start int, new boolean"

        def windows(batches):
            for batch in batches:
                ids = np.asarray(batch.column(0))
                for r0, r1, buf, offsets in K.pieces(batch.column(1), K.PIECE):
                    starts, stops, bounds = K.word_bounds(buf, offsets)
                    data, starts, stops = K.single_spaced(buf, starts, stops)
                    lists = batch.column(2).slice(r0, r1 - r0)
                    flat = lists.flatten()
                    _, first, last, new = (np.asarray(flat.field(i).to_numpy(zero_copy_only=False)) for i in range(4))
                    row = np.repeat(np.arange(r1 - r0), np.asarray(lists.value_lengths()))
                    n = (last - first + 1).astype(np.int64)
                    which = np.repeat(np.arange(len(first)), n)
                    start = first[which] + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
                    at = bounds[row[which]] + start
                    w1, w2 = K.digests(data, starts[at], stops[at + window - 1])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(w1), pa.array(w2), pa.array(ids[r0 + row[which]]), pa.array(start.astype(np.int32)), pa.array(new[which].astype(bool))],
                        names=["w1", "w2", "doc_id", "start", "new"],
                    )

        held = [t.join(stretches.hint("merge"), "key").select("key", "text", "at") for t in self.texts]
        each = keep(reduce(DataFrame.unionByName, [h.mapInArrow(windows, schema) for h in held]), by="w1", order=("w2",))
        least = each.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "start")).alias("head"), F.count("*").alias("n")).filter("n > 1").drop("n")
        late = each.filter("new").join(least.hint("merge"), ["w1", "w2"]).filter((F.col("doc_id") != F.col("head.doc_id")) | (F.col("start") != F.col("head.start")))
        return [shared, stretches, each], W.spans(late, window, "start", "start")

    def _compact(self) -> None:
        """All runs become one: of equal stretches the earliest stays, with the copies of all."""
        merged = self.runs[0]
        for other in self.runs[1:]:
            a, b = (r.select(*W.SAME, F.struct("doc_id", "pos", "first", "last").alias(n), F.col("copies").alias(f"of_{n}")) for r, n in ((merged, "a"), (other, "b")))
            both = a.join(b.hint("merge"), W.SAME, "full_outer").withColumn("head", F.least("a", "b"))
            merged = both.select(*W.SAME, "head.*", (F.coalesce("of_a", F.lit(0)) + F.coalesce("of_b", F.lit(0))).alias("copies"))
        merged = self.stage.keep(merged, by="fp", order=_SORT, dealt=True)
        self.stage.drop(*self.runs)
        self.runs = [merged]


def kept_words(texts: DataFrame, spans: DataFrame, window: int = WINDOW) -> DataFrame:
    """Of (key, doc_id, text) and (doc_id, spans), where the key is that doc_id: per document the counts, the kept words joined by one space, and their SHA-256."""
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"

    def run(batches):
        for batch in batches:
            out = []
            at, pairs = W.list_rows(batch.column(2))
            for i, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                words = (text.as_py() or "").encode().split()
                if at[i + 1] > at[i]:
                    gone = W.covered(len(words), pairs[at[i] : at[i + 1]])
                    kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                    n = int(gone.sum())
                else:
                    kept, n = b" ".join(words), 0
                out.append((doc, len(words), n, hashlib.sha256(kept).hexdigest(), kept.decode()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.string()] * 2, strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return texts.join(spans.withColumnRenamed("doc_id", "of"), F.col("key") == F.col("of"), "left").select("doc_id", "text", "spans").mapInArrow(run, schema)


def substring_dedup(docs: DataFrame, window: int = WINDOW, batches: int = 3, gram: int = GRAM, fanout: int = 2) -> DataFrame:
    """Removes every word that an earlier-starting equal window covers, over the whole table.

    The documents go into the index in `batches` ranges of doc_id. Returns doc_id, n_words,
    n_removed, kept_sha256, kept_text.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    index = FingerprintIndex(docs.sparkSession, window, min(gram, window), fanout)
    cuts = []
    if batches > 1:
        share = [i / batches for i in range(1, batches)]
        cuts = docs.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, share))).alias("cuts")).first().cuts or []
    found, lower = [], None
    for upper in [*sorted(set(cuts)), None]:
        batch = docs
        if lower is not None:
            batch = batch.filter(F.col("doc_id") > lower)
        if upper is not None:
            batch = batch.filter(F.col("doc_id").isNull() | (F.col("doc_id") <= upper) if lower is None else F.col("doc_id") <= upper)
        found.append(index.add(batch))
        lower = upper
    index.close()
    return reduce(DataFrame.unionByName, [kept_words(t, f, window) for t, f in zip(index.texts, found, strict=True)])
