"""Repeated fixed-length windows over a corpus, by winnowed anchors.

A window is `window` consecutive units (words or bytes) of one document. `anchor_rows` maps
each document to its stretches (see `_kernel.window_anchors`): two equal windows lie in
stretches with equal `fp`, at equal offsets from the anchor; stretches are the same if their
words (bytes) are, by 128-bit digests of these, `sup` and `proof`. So only stretches, about one
for each eighth (words) or each 185th (bytes) unit, are shuffled; within a map batch only the
first stretch of equal content is sent, so a passage that a third of all documents share
sends one row for each map batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernel as K

SAME = ["fp", "sup", "proof"]
ANCHOR_SCHEMA = "fp long, sup long, proof long, doc_id long, pos int, first int, last int, copies int"
SPAN_SCHEMA = "doc_id long, spans array<int>"
_ARROW = pa.schema([("fp", pa.int64()), ("sup", pa.int64()), ("proof", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("copies", pa.int32())])


def _stretches(kind: str, buf: np.ndarray, offsets: np.ndarray, window: int, gram: int):
    """Of a piece: row, anchor, first and last window start (in units), fp, digest (two parts), and row bounds in units."""
    if kind == "word":
        units, starts, stops, bounds = K.word_units(buf, offsets)
        row, a, first, last, fp = K.window_anchors(units, bounds, window, gram)
        data, starts, stops = K.single_spaced(buf, starts, stops)
        return row, a, first, last, fp, *K.digests(data, starts[first], stops[last + window - 1]), bounds
    row, a, first, last, fp = K.window_anchors(K.byte_units(buf), offsets, window, gram)
    return row, a, first, last, fp, *K.digests(buf.tobytes(), first, last + window), offsets


def anchor_rows(docs: DataFrame, kind: str, window: int, gram: int) -> DataFrame:
    """Stretches of every document.

    copies: for the first stretch of its content in a map batch, the number of such stretches
    there; 0 for the others, whose content the first one stands for (their fp is of their place,
    not of their content, so that a passage of very many documents is not dealt to one bucket).
    """

    def run(batches):
        for batch in batches:
            ids = np.asarray(batch.column(0).cast(pa.int64()).fill_null(np.iinfo(np.int64).min))
            got = []
            for r0, _, buf, offsets in K.pieces(batch.column(1)):
                row, a, first, last, fp, sup, proof, bounds = _stretches(kind, buf, offsets, window, gram)
                base = bounds[row]
                got.append((fp, sup, proof, ids[r0 + row], a - base, first - base, last - base))
            if not got:
                continue
            fp, sup, proof, doc, pos, first, last = (np.concatenate(x) for x in zip(*got, strict=True))
            order = np.lexsort((pos, doc, proof, sup, fp))
            fp, sup, proof, doc, pos, first, last = (x[order] for x in (fp, sup, proof, doc, pos, first, last))
            if not len(fp):
                continue
            new = np.ones(len(fp), dtype=bool)
            new[1:] = (fp[1:] != fp[:-1]) | (sup[1:] != sup[:-1]) | (proof[1:] != proof[:-1])
            head = np.flatnonzero(new)
            copies = np.zeros(len(fp), dtype=np.int32)
            copies[head] = np.diff(np.append(head, len(fp)))
            # a repeated row of the table is the same stretch again, not a later one
            own = np.repeat(head, copies[head])
            again = ~new & (doc == doc[own]) & (pos == pos[own])
            keep = np.ones(len(fp), dtype=bool) if kind == "byte" else ~again
            again = copies == 0
            fp = np.where(again, K.mix64(doc.view(K.U64) + (pos.astype(K.U64) << K.U64(40))), fp)
            back = np.lexsort((pos, doc))  # in document order the ids compress
            back = back[keep[back]]
            cols = [fp.view(np.int64), sup, proof, doc, *(x.astype(np.int32) for x in (pos, first, last)), copies]
            yield pa.RecordBatch.from_arrays([pa.array(c[back]) for c in cols], schema=_ARROW)

    return docs.select("doc_id", "text").mapInArrow(run, ANCHOR_SCHEMA)


def heads(rows: DataFrame) -> DataFrame:
    """One row for each stretch content: where it is first, and how often it is."""
    return (
        rows.groupBy(*SAME)
        .agg(F.min(F.struct("doc_id", "pos", "first", "last")).alias("head"), F.sum(F.col("copies").cast("long")).alias("copies"))
        .select(*SAME, F.col("head.doc_id").alias("doc_id"), F.col("head.pos").alias("pos"), F.col("head.first").alias("first"), F.col("head.last").alias("last"), "copies")
    )


def spans(rows: DataFrame, window: int, start: str = "first", last: str = "last") -> DataFrame:
    """(doc_id, span) with span = start and stop of the units that windows start..last cover."""
    return rows.select("doc_id", F.struct(F.col(start).alias("a"), (F.col(last) + F.lit(window)).alias("b")).alias("span"))


def by_document(*parts: DataFrame) -> DataFrame:
    """Spans of each document as one list; the list is at most as long as the document."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("doc_id").agg(F.collect_list("span").alias("spans"))


def joined_lists(*lists: DataFrame) -> DataFrame:
    """(doc_id, spans) tables as one, a row for each document."""
    every = lists[0]
    for p in lists[1:]:
        every = every.unionByName(p)
    return every.groupBy("doc_id").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def covered(n: int, spans: np.ndarray) -> np.ndarray:
    """Mask of n units; spans is (k, 2)."""
    step = np.zeros(n + 1, dtype=np.int32)
    if len(spans):
        np.add.at(step, np.minimum(spans[:, 0], n), 1)
        np.add.at(step, np.minimum(spans[:, 1], n), -1)
    return np.cumsum(step[:-1]) > 0


def list_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow list<struct<a, b>> column as bounds and one (k, 2) array; null lists are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    flat = column.flatten()
    pairs = np.stack([np.asarray(flat.field(0)), np.asarray(flat.field(1))], axis=1) if len(flat) else np.zeros((0, 2), np.int32)
    return np.concatenate([[0], np.cumsum(sizes)]), pairs
