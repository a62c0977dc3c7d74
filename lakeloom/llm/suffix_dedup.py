"""Removal of repeated byte strings, by sorting suffixes at sparse anchors.

All strings of `window` bytes that also start elsewhere are removed. Suffixes are kept at
winnowed anchors only (see `_windows`): equal strings have their anchors at equal offsets, so
two suffixes need comparing only if their anchors' 32-byte grams agree. Stretches that repeat
as a whole are settled by a 128-bit digest of their bytes. For the rest, each shard (a map batch) sends its
anchor suffixes in suffix order, each with the bytes after and before it, the latter being what
a Burrows-Wheeler transform keeps. The suffixes of each group are then radix-sorted by their own
bytes; the shards' order only settles ties, and no transform is merged: the
interleave starts as shard order inside each group of equal grams, and step h refines it by the
h-th symbol, stably, inside the blocks that are still together. The step at which neighbours
part is their common prefix. The same merge over the bytes before the anchors gives the common
suffixes. A string with r bytes before its anchor repeats exactly if another suffix shares an
interval of depth window - r after and depth r before the anchor.

Defined cases: a null or empty text has no bytes; shorter texts lose nothing; matches never
cross documents, and overlapping copies in one document count; doc_id names a document, and a
row that repeats it with the same text is a second copy; a null doc_id is kept as it is; an
empty table returns no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernel as K
from . import _windows as W
from ._stage import Stage

WINDOW = 400
GRAM = 32
#: Groups of more suffixes are split by the content that all strings of a block of offsets share.
HOT = 20_000
BLOCK = 32
_NULL = np.iinfo(np.int64).min
_END = 256
SUFFIX_SCHEMA = "key long, shard long, rank int, back int, doc_id long, pos int, first int, last int, copies long, text binary"
_NAMES = ["key", "shard", "rank", "back", "doc_id", "pos", "first", "last", "copies", "text"]


def shard_suffixes(held: DataFrame, window: int) -> DataFrame:
    """(doc_id, text, at) to one row for each anchor suffix, ranked in its shard's suffix order."""

    def run(batches):
        for batch in batches:
            ids = np.asarray(batch.column(0))
            rows = []
            for i in range(batch.num_rows):
                data = (batch.column(1)[i].as_py() or "").encode()
                for a in batch.column(2)[i].as_py():
                    pos, first, last = a["pos"], a["first"], a["last"]
                    if not a["hot"]:
                        rows.append((a["fp"], int(ids[i]), pos, first, last, a["copies"], data[first : last + window]))
                        continue
                    while first <= last:  # offsets r = pos - start in blocks of equal r // BLOCK
                        q = (pos - first) // BLOCK
                        stop = min(last, pos - q * BLOCK)
                        low = pos - q * BLOCK  # the last start that the block could have
                        core = data[low : low - BLOCK + 1 + window]
                        key = int.from_bytes(hashlib.blake2b(core + q.to_bytes(4, "little"), digest_size=8, key=(a["fp"] & (2**64 - 1)).to_bytes(8, "little")).digest(), "little", signed=True)
                        rows.append((key, int(ids[i]), pos, first, stop, a["copies"], data[first : stop + window]))
                        first = stop + 1
            if not rows:
                continue
            shard = int.from_bytes(hashlib.blake2b(repr(rows[0][:5]).encode(), digest_size=8).digest(), "little", signed=True)
            after = sorted(range(len(rows)), key=lambda j: rows[j][6][rows[j][2] - rows[j][3] :])
            before = sorted(range(len(rows)), key=lambda j: rows[j][6][: rows[j][2] - rows[j][3]][::-1])
            rank, back = np.empty(len(rows), np.int32), np.empty(len(rows), np.int32)
            rank[after], back[before] = np.arange(len(rows)), np.arange(len(rows))
            key, doc, pos, first, last, copies, text = zip(*rows, strict=True)
            cols = [pa.array(key, pa.int64()), pa.array([shard] * len(rows), pa.int64()), pa.array(rank), pa.array(back), pa.array(doc, pa.int64()), *(pa.array(x, pa.int32()) for x in (pos, first, last)), pa.array(copies, pa.int64()), pa.array(text, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=_NAMES)

    return held.mapInArrow(run, SUFFIX_SCHEMA)


def interleave(group: np.ndarray, order: np.ndarray, symbol, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Refines an interleave of sorted shards, symbol by symbol.

    group: of each row; order: rows by (group, shard, rank in the shard); symbol(rows, h): the
    h-th symbols. Returns the merged order and the common prefix of each row with the one before
    it in that order (-1 where the group changes, `depth` where they never part).
    """
    order = order.copy()
    common = np.full(len(order), depth, dtype=np.int32)
    g = group[order]
    start = np.ones(len(order), dtype=bool)
    start[1:] = g[1:] != g[:-1]
    common[start] = -1
    block = np.cumsum(start)
    at = np.arange(len(order))
    for h in range(depth):
        size = np.bincount(block)
        still = size[block] > 1
        at, block = at[still], block[still]
        if not len(at):
            break
        rows = order[at]
        key = block.astype(np.int64) * 512 + symbol(rows, h)
        perm = np.argsort(key, kind="stable")
        order[at] = rows[perm]
        key = key[perm]
        parts = np.ones(len(at), dtype=bool)
        parts[1:] = key[1:] != key[:-1]
        apart = np.zeros(len(at), dtype=bool)
        apart[1:] = parts[1:] & (block[1:] == block[:-1])
        common[at[apart]] = h
        block = np.cumsum(parts)
    return order, common


def _reach(order: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Each row's longest common prefix with any other row of its group."""
    best = np.maximum(common, np.append(common[1:], -1))
    out = np.empty(len(order), dtype=np.int32)
    out[order] = best
    return out


def repeated_offsets(cols: dict, window: int):
    """Of one piece of whole groups: (row, first start, last start) of runs of repeated strings."""
    key, shard = cols["key"], cols["shard"]
    pos, first, last = (cols[c].astype(np.int64) for c in ("pos", "first", "last"))
    flat, begin = cols["flat"], cols["begin"]
    group = np.cumsum(np.append([True], key[1:] != key[:-1]))
    high, low = pos - first, pos - last  # bytes before the anchor
    ahead = window - low
    mid = begin + high
    edge = len(flat) - 1
    right = interleave(group, np.lexsort((cols["rank"], shard, group)), lambda r, h: np.where(h < ahead[r], flat[np.minimum(mid[r] + h, edge)], _END), int(ahead.max()))
    left = interleave(group, np.lexsort((cols["back"], shard, group)), lambda r, h: np.where(h < high[r], flat[np.maximum(mid[r] - 1 - h, 0)], _END), max(1, int(high.max())))
    top = np.minimum(high, _reach(*left))
    bottom = np.maximum(low, window - _reach(*right))
    live = np.flatnonzero((bottom <= top) & (bottom < window))
    if not len(live):
        return [np.zeros(0, np.int64)] * 3
    place = [np.empty(len(key), np.int64), np.empty(len(key), np.int64)]
    for p, (order, _) in zip(place, (right, left), strict=True):
        p[order] = np.arange(len(order))
    hits = []
    for r in range(int(bottom[live].min()), int(top[live].max()) + 1):
        rows = live[(bottom[live] <= r) & (r <= top[live])]
        if len(rows) < 2:
            continue
        a = np.cumsum(right[1] < window - r)[place[0][rows]]
        b = np.cumsum(left[1] < r)[place[1][rows]]
        pair = a * (len(key) + 1) + b
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        same = pair[1:] == pair[:-1]
        twin = np.append(same, False) | np.append([False], same)
        hits.append((rows[order[twin]], np.full(int(twin.sum()), r)))
    if not hits:
        return [np.zeros(0, np.int64)] * 3
    row, r = (np.concatenate(x) for x in zip(*hits, strict=True))
    start = pos[row] - r
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(row)) - 1
    return [row[head], start[head], start[tail]] if len(row) else [np.zeros(0, np.int64)] * 3


def merged_repeats(suffixes: DataFrame, window: int) -> DataFrame:
    """Merges the shards' orders group by group; returns (doc_id, span) of single stretches' repeats."""

    def piece(parts: list[pa.RecordBatch]):
        table = pa.Table.from_batches(parts).combine_chunks()
        if not table.num_rows:
            return
        text = table.column("text").combine_chunks()
        offs = np.frombuffer(text.buffers()[1], dtype=np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        cols = {c: np.asarray(table.column(c)) for c in _NAMES[:-1]}
        cols |= {"flat": np.frombuffer(text.buffers()[2], dtype=np.uint8), "begin": offs[:-1]}
        row, a, b = repeated_offsets(cols, window)
        own = cols["copies"][row] == 1  # stretches with more copies are covered already
        row, a, b = row[own], a[own], b[own]
        if len(row):
            span = pa.StructArray.from_arrays([pa.array(a.astype(np.int32)), pa.array((b + window).astype(np.int32))], names=["a", "b"])
            yield pa.RecordBatch.from_arrays([pa.array(cols["doc_id"][row]), span], names=["doc_id", "span"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.asarray(batch.column(0))
            turns = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            if held and keys[0] != held[-1].column(0)[-1].as_py() and n >= 8192:
                yield from piece(held)
                held, n = [], 0
            if len(turns) and n + len(keys) >= 8192:
                held.append(batch.slice(0, turns[-1]))
                yield from piece(held)
                batch = batch.slice(turns[-1])
                held, n = [], 0
            held.append(batch)
            n += batch.num_rows
        if held:
            yield from piece(held)

    dealt = suffixes.repartition(F.col("key")).sortWithinPartitions("key", "shard", "rank")
    return dealt.mapInArrow(run, "doc_id long, span struct<a: int, b: int>")


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, spans): the byte spans of each document that strings found elsewhere cover; they may overlap."""
    stage = Stage(docs.sparkSession, "suffix-dedup")
    rows = stage.keep(W.anchor_rows(docs, "byte", window, min(gram, window)))
    firsts = rows.filter("copies > 0")
    run = stage.keep(W.heads(firsts))
    twice = run.filter("copies > 1").select(*W.SAME)
    parts = [W.spans(rows.filter("copies <> 1"), window), W.spans(rows.filter("copies = 1").join(twice, W.SAME), window)]
    shared = run.groupBy("fp").agg(F.min(F.struct("sup", "proof")).alias("lo"), F.max(F.struct("sup", "proof")).alias("hi"), F.count("*").alias("n")).filter("lo <> hi").select("fp", (F.col("n") > hot).alias("hot"))
    shared = stage.keep(shared)  # a join of plain tables can split a gram that very many suffixes share
    at = run.join(shared, "fp").groupBy("doc_id").agg(F.collect_list(F.struct("fp", "pos", "first", "last", "copies", "hot")).alias("at"))
    held = docs.select(F.coalesce("doc_id", F.lit(_NULL)).alias("doc_id"), "text").join(at, "doc_id")
    parts.append(merged_repeats(shard_suffixes(held, window), window))
    found = stage.keep(W.by_document(*parts))
    stage.drop(rows, run, shared)
    return found


def suffix_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Removes all bytes that repeated strings of `window` bytes cover, over the whole table.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary: a cut may fall inside
    a character).
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = repeated_spans(docs, window, gram, hot)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"

    def run(batches):
        for batch in batches:
            at, pairs = W.list_rows(batch.column(2))
            out = []
            for i, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                data = (text.as_py() or "").encode()
                gone, n_spans, kept = 0, 0, data
                if at[i + 1] > at[i]:
                    mask = W.covered(len(data), pairs[at[i] : at[i + 1]])
                    gone = int(mask.sum())
                    n_spans = int(mask[:1].sum()) + int((mask[1:] & ~mask[:-1]).sum())
                    kept = np.frombuffer(data, dtype=np.uint8)[~mask].tobytes()
                out.append((doc, len(data), gone, n_spans, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    held = docs.withColumn("key", F.coalesce("doc_id", F.lit(_NULL)))
    return held.join(found.withColumnRenamed("doc_id", "key"), "key", "left").select("doc_id", "text", "spans").mapInArrow(run, schema)
