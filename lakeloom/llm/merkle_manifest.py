"""Merkle manifest of a dataset: a tree over the rows of each source, and one over the sources.

Trees have a fan-out of 16. They are laid out after van Emde Boas: a tree is split at half its
height into a top tree and aligned bottom trees, each of these is split again, and every part is
stored in one piece, the top first. Splitting stops at parts of at most `EDGES` levels of hashing:
these are the blocks, one row each, and hold their nodes in the same order (`address`). So the
siblings of a node are found by arithmetic on its place alone, in one block for each `EDGES` levels,
whatever the size of pages or caches below.

Rows are hashed where they are read; texts are never shuffled. Digests are dealt by ranges of
(source, doc_id), written, and numbered by the sizes of the ranges before, so that one source with
most of the rows is spread like the others. Blocks are built from the groups of their leaves, a
bounded number; the roots of blocks are the leaves of the next tier, until each source has one
block left. Then paths go down again: a block's siblings above it, its subroot and the root are
joined to it by its own number, so no key is hot there either. A proof is checked and folded where
the block is.

Defined cases: a null column counts as `-`. Within a source, rows follow by doc_id, null first, and
rows that share a doc_id by their digest. A null source is a source of its own, before all others.
A null doc_id is never tampered with. Of the input, only doc_id, source, lang, n_chars and text are
read. An empty table gives an empty result. A tree of one leaf has no siblings: the proof is the
digest of an empty text.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._stage import Stage

#: Levels of hashing (of fan-out 16) in a block, at most: a block has 16 ** EDGES leaves.
EDGES = 2
FAN = 16
_DIGEST = 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Trees are no higher than this: 16 ** 15 leaves.
_HIGHEST = 15
_PATH = "array<struct<left: string, right: string>>"


def tiers(edges: int, most: int = EDGES) -> list[int]:
    """The heights of a tree's blocks from the leaves up: halves of halves, until a part has `most` edges."""
    if edges <= most:
        return [edges]
    top = edges // 2
    return tiers(edges - top, most) + tiers(top, most)


def size(levels: int) -> int:
    """Nodes of a full tree of so many levels."""
    return (FAN**levels - 1) // (FAN - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of nodes (depth from the root, number in their level) in the layout of a tree of `levels` levels."""
    if levels == 1:
        return np.zeros_like(index)
    top = levels // 2
    if depth < top:
        return address(top, depth, index)
    below, depth = levels - top, depth - top
    tree, inside = np.divmod(index, FAN**depth)
    return size(top) + tree * size(below) + address(below, depth, inside)


@lru_cache(maxsize=64)
def places(levels: int, depth: int) -> np.ndarray:
    return address(levels, depth, np.arange(FAN**depth))


def joined(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


class Block:
    """The nodes of one aligned part of a tree, as one string of digests in the order of `address`.

    Only the last block of a tree has fewer than all leaves; places without a node hold zeros.
    """

    def __init__(self, edges: int, n_leaves: int, nodes: bytes):
        self.edges, self.n = edges, n_leaves
        self.nodes = nodes

    @classmethod
    def build(cls, edges: int, leaves: list[str]) -> Block:
        held = np.zeros((size(edges + 1), _DIGEST), dtype=np.uint8)
        level = leaves
        for depth in range(edges, -1, -1):
            held[places(edges + 1, depth)[: len(level)]] = np.frombuffer(bytes.fromhex("".join(level)), dtype=np.uint8).reshape(-1, _DIGEST)
            if depth:
                level = [joined(level[i : i + FAN]) for i in range(0, len(level), FAN)]
        return cls(edges, len(leaves), held.tobytes())

    def node(self, depth: int, index: int) -> str:
        at = int(places(self.edges + 1, depth)[index]) * _DIGEST
        return self.nodes[at : at + _DIGEST].hex()

    def root(self) -> str:
        return self.node(0, 0)

    def run(self, depth: int, first: int) -> list[str]:
        """The nodes of the run that begins at `first`."""
        n = -(-self.n // FAN ** (self.edges - depth))
        return [self.node(depth, i) for i in range(first, min(first + FAN, n))]

    def paths(self) -> list[list[tuple[str, str]]]:
        """For each leaf the siblings left and right of its way, level by level, within the block."""
        above: list[list[tuple[str, str]]] = [[]]
        for depth in range(1, self.edges + 1):
            n, here = -(-self.n // FAN ** (self.edges - depth)), []
            for first in range(0, n, FAN):
                run, parent = self.run(depth, first), above[first // FAN]
                here += [[("".join(run[:i]), "".join(run[i + 1 :])), *parent] for i in range(len(run))]
            above = here
        return above


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        leaf = joined([left, leaf, right])
    return leaf


def encoded(c: Column) -> Column:
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """(doc_id, source, leaf, changed): changed is the leaf after tampering, where there is some."""
    head = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    digest = lambda text: F.sha2(F.concat(*map(encoded, head), encoded(text)), 256)
    changed = F.when(tampered, digest(F.translate("text", _UPPER, _LOWER)))
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), digest(F.col("text")).alias("leaf"), changed.alias("changed"))


def _edges(n: Column) -> Column:
    """Levels of hashing over n leaves."""
    return F.when(n > 1, F.length(F.hex(n - 1))).otherwise(0)


def _height(n: Column, tier: int, most: int) -> Column:
    """The edges of a tree's blocks in a tier; null above its last one."""
    table = F.array(*(F.array(*map(F.lit, tiers(e, most))) for e in range(_HIGHEST + 1)))
    return F.get(F.get(table, _edges(n)), F.lit(tier))


def numbered(stage: Stage, nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes with their place `at` in their tree, from 0, and the tree's number of leaves `n`.

    The ranges are cut by sampling, so they are written before they are counted; equal rows are
    spread by a random number.
    """
    keys = ["tree", *order, "_salt"]
    ways = [F.col(c).asc_nulls_first() for c in keys]
    ranged = nodes.withColumn("_salt", F.rand(11)).repartitionByRange(stage.buckets, *ways).sortWithinPartitions(*ways).drop("_salt")
    number = F.monotonically_increasing_id()
    held = stage.keep(ranged.withColumns({"_part": F.shiftright(number, 33), "_seq": number.bitwiseAND((1 << 33) - 1)}))
    runs = held.groupBy("_part", "tree").agg(F.min("_seq").alias("_first"), F.count("*").alias("_n"))
    along = Window.partitionBy("tree").orderBy("_part")
    runs = runs.select(F.col("_part").alias("_p"), F.col("tree").alias("_t"), (F.sum("_n").over(along) - F.col("_n") - F.col("_first")).alias("_shift"), F.sum("_n").over(Window.partitionBy("tree")).alias("n"))
    return held.join(runs, (F.col("_part") == F.col("_p")) & F.col("tree").eqNullSafe(F.col("_t"))).withColumn("at", F.col("_seq") + F.col("_shift")).drop("_part", "_seq", "_p", "_t", "_shift")


def _built(stage: Stage, nodes: DataFrame, tier: int, most: int, carried: list[str]) -> DataFrame:
    """(tree, n, edges, block, items, nodes, root) from nodes (tree, n, at, digest, carried columns)."""
    edges = _height(F.col("n"), tier, most)
    rows = nodes.withColumn("edges", edges).filter("edges is not null")
    block = F.shiftright("at", 0)
    for e in range(1, most + 1):
        block = F.when(F.col("edges") == e, F.shiftright("at", 4 * e)).otherwise(block)
    grouped = rows.groupBy("tree", block.alias("block")).agg(F.first("n").alias("n"), F.first("edges").alias("edges"), F.array_sort(F.collect_list(F.struct("at", "digest", *carried))).alias("items"))

    def run(batches):
        for batch in batches:
            at = {name: i for i, name in enumerate(batch.schema.names)}
            items, nodes, roots = batch.column(at["items"]), [], []
            digests, ends = items.flatten().field(1).to_pylist(), items.value_lengths().to_numpy().cumsum()
            for i, e in enumerate(batch.column(at["edges"]).to_pylist()):
                b = Block.build(e, digests[ends[i - 1] if i else 0 : ends[i]])
                nodes.append(b.nodes)
                roots.append(b.root())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.binary()), pa.array(roots, pa.string())], names=[*batch.schema.names, "nodes", "root"])

    kinds = ", ".join(f"{c} {t}" for c, t in grouped.dtypes)
    return stage.keep(grouped.mapInArrow(run, f"{kinds}, nodes binary, root string"))


def forest(stage: Stage, nodes: DataFrame, most: int, carried: list[str]) -> list[DataFrame]:
    """The tiers of blocks over numbered nodes, leaves first."""
    largest = nodes.agg(F.max("n")).first()[0]
    if largest is None:
        return []
    highest = max(0, len(f"{largest - 1:x}") if largest > 1 else 0)
    out = [_built(stage, nodes, 0, most, carried)]
    for tier in range(1, max(len(tiers(e, most)) for e in range(highest + 1))):
        out.append(_built(stage, out[-1].select("tree", "n", F.col("block").alias("at"), F.col("root").alias("digest")), tier, most, []))
    return out


def roots(blocks: list[DataFrame], most: int) -> DataFrame:
    """(tree, root) of the blocks that have none above them."""
    out = None
    for tier, b in enumerate(blocks):
        last = b.filter(_height(F.col("n"), tier + 1, most).isNull()).select("tree", "root")
        out = last if out is None else out.unionAll(last)
    return out


def _below(b: DataFrame, above: DataFrame) -> DataFrame:
    """Blocks with what is above them, joined by number."""
    held = above.select(F.col("tree").alias("_t"), F.col("at").alias("_at"), "path", "outer")
    return b.join(held, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("block") == F.col("_at"))).drop("_t", "_at")


def _paths(edges, n_items, nodes, path):
    above = [(p["left"], p["right"]) for p in path]
    return [own + above for own in Block(edges, n_items, nodes).paths()]


def descend(stage: Stage, blocks: list[DataFrame], outer: DataFrame, most: int) -> DataFrame:
    """The lowest blocks with `path`, the siblings above each, and `outer`, what is known of its tree.

    outer: (tree, path, outer) with the siblings above each tree's root.
    """
    above = None
    for tier in range(len(blocks) - 1, -1, -1):
        b = blocks[tier]
        ends = b.filter(_height(F.col("n"), tier + 1, most).isNull()).select(F.col("tree").alias("_r"))
        start = outer.join(ends, F.col("tree").eqNullSafe(F.col("_r")), "left_semi").select("tree", F.lit(0).cast("long").alias("at"), "path", "outer")
        here = _below(b, start if above is None else above.unionByName(start))
        if not tier:
            return here

        def run(batches):
            for batch in batches:
                rows = [
                    {"tree": r["tree"], "at": r["block"] * FAN ** r["edges"] + i, "path": [{"left": x, "right": y} for x, y in p], "outer": r["outer"]}
                    for r in batch.to_pylist() for i, p in enumerate(_paths(r["edges"], r["n_items"], r["nodes"], r["path"]))
                ]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("tree", pa.string()), ("at", pa.int64()), ("path", pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))), ("outer", pa.struct([("subroot", pa.string()), ("root", pa.string())]))]))

        cols = here.select("tree", "edges", "block", F.size("items").alias("n_items"), "nodes", "path", "outer")
        above = stage.keep(cols.mapInArrow(run, f"tree string, at long, path {_PATH}, outer struct<subroot: string, root: string>"))
    raise ValueError("no blocks")


def _proofs(batches):
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    for batch in batches:
        cols: dict[str, list] = {n: [] for n in names}
        for r in batch.to_pylist():
            items, outer = r["items"], r["outer"]
            for item, path in zip(items, _paths(r["edges"], len(items), r["nodes"], r["path"]), strict=True):
                folded = fold(item["changed"] or item["digest"], path)
                row = (item["doc_id"], item["digest"], outer["subroot"], outer["root"], joined([x for pair in path for x in pair]), folded, folded == outer["root"])
                for n, v in zip(names, row, strict=True):
                    cols[n].append(v)
        kinds = [batch.schema.field("items").type.value_type.field("doc_id").type, *[pa.string()] * 5, pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[n], k) for n, k in zip(names, kinds, strict=True)], names=list(names))


def manifest(docs: DataFrame, tampered: Column | None = None, most: int = EDGES) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), a row for each row of docs.

    tampered: which rows are folded with the letters A-Z of their text in lower case; by default
    those whose doc_id, in decimal, has a crc32 that 5 divides.
    """
    spark: SparkSession = docs.sparkSession
    stage = Stage(spark, "manifest")
    if tampered is None:
        tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    rows = stage.keep(leaves(docs, F.coalesce(tampered, F.lit(False))))
    nodes = numbered(stage, rows.select(F.col("source").alias("tree"), "doc_id", F.col("leaf").alias("digest"), "changed"), ["doc_id", "digest"])
    blocks = forest(stage, nodes, most, ["doc_id", "changed"])
    kind = dict(rows.dtypes)["doc_id"]
    if not blocks:
        return spark.createDataFrame([], f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    sources = roots(blocks, most).select(F.lit(None).cast("string").alias("tree"), F.col("tree").alias("source"), F.col("root").alias("digest"))
    upper = forest(stage, numbered(stage, sources, ["source"]), most, ["source"])
    nothing = F.array().cast(_PATH)
    whole = roots(upper, most).select("tree", nothing.alias("path"), F.struct(F.lit(None).cast("string").alias("subroot"), F.col("root").alias("root")).alias("outer"))
    outer = _of_sources(stage, descend(stage, upper, whole, most))
    lowest = descend(stage, blocks, outer, most).select("edges", "items", "nodes", "path", "outer")
    return lowest.mapInArrow(_proofs, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def _of_sources(stage: Stage, lowest: DataFrame) -> DataFrame:
    """(tree, path, outer) of each source, from the lowest blocks of the tree over sources."""

    def run(batches):
        for batch in batches:
            rows = [
                {"tree": item["source"], "path": [{"left": x, "right": y} for x, y in p], "outer": {"subroot": item["digest"], "root": r["outer"]["root"]}}
                for r in batch.to_pylist() for item, p in zip(r["items"], _paths(r["edges"], len(r["items"]), r["nodes"], r["path"]), strict=True)
            ]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("tree", pa.string()), ("path", pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))), ("outer", pa.struct([("subroot", pa.string()), ("root", pa.string())]))]))

    cols = lowest.select("edges", "items", "nodes", "path", "outer")
    return stage.keep(cols.mapInArrow(run, f"tree string, path {_PATH}, outer struct<subroot: string, root: string>"))
