"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints at no more than `distance` differing bits are linked. The 64 bits are dealt into m
partitions, correlated bits together. If thresholds t_i (-1 leaves a partition out) satisfy
sum(t_i + 1) = distance + 1, every linked pair differs in at most t_i bits of some partition i.
The thresholds come from dynamic programming over estimated candidate counts, which are taken
from the joint bit statistics of all fingerprints; m is the cheapest of a few. A partition with t_i = 0
is probed by its value, one with t_i = 1 by the values with one bit left out, and so on.

Only distinct fingerprints are probed. A bucket of up to BUCKET fingerprints is verified by exact
distances and gives a spanning forest, not pairs. Fingerprints in larger buckets are linked
exactly through the points half way between them: two of them are within `distance` if and only
if their balls of half that radius meet, and a ball's point belongs to boundedly many.

Defined cases: null and empty texts have fingerprint zero and are linked like any other; texts of
fewer words than a shingle are one shingle; rows that repeat a doc_id stay as rows; a null doc_id
is never a component's id unless all its documents have none; an empty table returns no rows.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import components
from ._stage import Stage

WORDS = 3
DISTANCE = 2
SEED = 42
BUCKET = 256


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The SimHash of a text: a bit is set if it is set in over half the shingles' XXH64."""
    import xxhash

    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(w) + 1 for w in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(parts))
    xxh = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, dtype=np.int64), len(parts) - k + 1
    for s in range(0, n, 8192):
        e = min(n, s + 8192)
        h = np.array([xxh(joined[a:b], SEED) for a, b in zip(starts[s:e].tolist(), ends[s + k - 1 : e + k - 1].tolist(), strict=True)], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * counts > n).tolist())


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp): fp as a signed long."""

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and how often each two bits are set together, over all of them."""

    def run(batches):
        total, n = np.zeros((64, 64)), 0
        for batch in batches:
            x = _bits(np.asarray(batch.column(0))).astype(np.float32)
            for s in range(0, len(x), 65_536):
                total += x[s : s + 65_536].T @ x[s : s + 65_536]
            n += len(x)
        if n:
            i, j = np.divmod(np.arange(4096), 64)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1).astype(np.int32)), pa.array(np.append(j, -1).astype(np.int32)), pa.array(np.append(total.ravel(), n))], names=["i", "j", "n"])

    sums = nodes.select("fp").mapInArrow(run, "i int, j int, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()  # 4097 rows at most
    both = np.zeros((64, 64))
    n = 0
    for r in sums:
        if r.i < 0:
            n = int(r.n)
        else:
            both[r.i, r.j] = r.n
    return n, both


def correlated_partitions(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """Deals the bits into m partitions, each grown by the bit that correlates most with it."""
    p = np.diag(both) / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / n - np.outer(p, p)) / np.outer(spread, spread))
    left = set(range(64))
    out = []
    for i in range(m):
        size = 64 // m + (i < 64 % m)
        part = [max(left, key=lambda b: (corr[b, list(left)].sum(), -b))]
        left.remove(part[0])
        while len(part) < size:
            b = max(left, key=lambda b: (corr[b, part].sum(), -b))
            part.append(b)
            left.remove(b)
        out.append(sorted(part))
    return out


def chain(n: int, both: np.ndarray, part: list[int]) -> tuple[list[int], np.ndarray]:
    """A partition's bits, each after the one it depends on most, and how often two bits of two random fingerprints both differ."""
    p = np.diag(both) / n
    p11 = both / n
    p10, p01 = p[:, None] - p11, p[None, :] - p11
    differ = 2 * (p11 * (1 - p11 - p10 - p01) + p10 * p01)
    alone = np.diag(differ)
    excess = np.abs(differ - np.outer(alone, alone))
    left, order = set(part[1:]), [part[0]]
    while left:
        b = max(left, key=lambda c: (excess[order[-1], c], -c))
        order.append(b)
        left.remove(b)
    return order, differ


def _costs(n: int, both: np.ndarray, part: list[int], most: int) -> list[float]:
    """Estimated cost of thresholds -1..most: signatures of all fingerprints plus candidate pairs.

    The bits of a partition depend on each other, so the number of differing bits of a random
    pair follows a Markov chain over them, whose steps are the joint statistics of two bits.
    """
    order, differ = chain(n, both, part)
    alone = np.diag(differ)
    near = np.zeros((2, most + 2))  # [whether the last bit differs, differing bits so far]
    near[0, 0], near[1, 1] = 1 - alone[order[0]], alone[order[0]]
    for a, b in zip(order, order[1:], strict=False):
        joint = differ[a, b]
        after = np.array([[1 - alone[a] - alone[b] + joint, alone[b] - joint], [alone[a] - joint, joint]]).clip(0)
        after = after / np.maximum(after.sum(axis=1, keepdims=True), 1e-12)
        same, other = (after[:, [k]] * near for k in (0, 1))
        near = np.stack([same.sum(axis=0), np.append(0.0, other.sum(axis=0)[:-1])])
    pairs = n * n / 2 * np.cumsum(near.sum(axis=0))
    out, signatures = [0.0], 1.0
    for t in range(most + 1):
        signatures = signatures * (len(part) - t + 1) / t if t else 1.0
        out.append(n * signatures + pairs[t])
    return out


def allocate(costs: list[list[float]], units: int) -> tuple[float, list[int]]:
    """Thresholds with sum(t + 1) = units at least cost; costs[i][u] is partition i's cost at t = u - 1."""
    best = {0: (0.0, [])}
    for c in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, ts) in best.items():
            for u in range(min(units - used, len(c) - 1) + 1):
                new = (cost + c[u], [*ts, u - 1])
                if used + u not in step or new[0] < step[used + u][0]:
                    step[used + u] = new
        best = step
    return best[units]


def plan(nodes: DataFrame, distance: int, counts: tuple[int, ...] = (2, 3, 4)) -> list[int]:
    """Masks under which linked fingerprints have an equal value at least once."""
    n, both = bit_statistics(nodes)
    if not n:
        return []
    options = []
    for m in sorted({*counts, distance + 1}):
        parts = correlated_partitions(n, both, m)
        cost, ts = allocate([_costs(n, both, part, min(distance, len(part))) for part in parts], distance + 1)
        options.append((cost, m, parts, ts))
    _, _, parts, ts = min(options, key=lambda o: o[:2])
    masks = []
    for part, t in zip(parts, ts, strict=True):
        if t >= 0:
            whole = sum(1 << b for b in part)
            masks += [whole & ~sum(1 << b for b in out) for out in combinations(part, t)]
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(fp: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among a bucket's fingerprints."""
    left = np.ones(len(fp), dtype=bool)
    for root in range(len(fp)):
        if not left[root]:
            continue
        left[root] = False
        turn = [root]
        while turn:
            i = turn.pop()
            near = np.flatnonzero(left & (np.bitwise_count(fp ^ fp[i]) <= distance))
            left[near] = False
            turn += near.tolist()
            yield from ((int(fp[i]), int(fp[j])) for j in near)


def bucket_links(buckets: DataFrame, distance: int) -> DataFrame:
    """Links inside buckets (sig, key, fp) of bounded size."""

    def run(batches):
        tail: list[np.ndarray] = []
        for batch in batches:
            cols = [np.asarray(batch.column(i)) for i in range(3)]
            if tail:
                cols = [np.concatenate(x) for x in zip(tail, cols, strict=True)]
            turns = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1
            cut = int(turns[-1]) if len(turns) else 0
            yield from links([c[:cut] for c in cols])
            tail = [c[cut:] for c in cols]
        if tail:
            yield from links(tail)

    def links(cols):
        sig, key, fp = cols
        if not len(fp):
            return
        fp = fp.view(np.uint64)
        starts = np.append(np.flatnonzero(np.append(True, (sig[1:] != sig[:-1]) | (key[1:] != key[:-1]))), len(fp))
        size = np.diff(starts)
        two = starts[:-1][size == 2]
        near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance]
        a, b = [fp[near]], [fp[near + 1]]
        for s, n in zip(starts[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
            if pairs := list(_forest(fp[s : s + n], distance)):
                x = np.array(pairs, dtype=np.uint64)
                a.append(x[:, 0])
                b.append(x[:, 1])
        a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return buckets.repartition("sig", "key").sortWithinPartitions("sig", "key").select("sig", "key", "fp").mapInArrow(run, "a long, b long")


def ball_links(nodes: DataFrame, distance: int) -> DataFrame:
    """Exact links by half-way points: all fingerprints whose balls of half the distance share a point.

    For an odd distance the points are one step finer than needed, so links are verified; a
    point belongs to boundedly many fingerprints.
    """
    radius = (distance + 1) // 2
    masks = [_signed(sum(1 << b for b in out)) for r in range(radius + 1) for out in combinations(range(64), r)]
    balls = nodes.select("fp", F.explode(F.transform(F.array(*map(F.lit, masks)), lambda m: F.col("fp").bitwiseXOR(m))).alias("z"))
    if distance % 2 == 0:
        least = balls.groupBy("z").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1")
        return balls.join(least, "z").filter("fp <> a").select("a", F.col("fp").alias("b")).distinct()
    other = balls.select(F.col("fp").alias("b"), "z")
    pairs = balls.select(F.col("fp").alias("a"), "z").join(other, "z").filter("a < b").select("a", "b").distinct()
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)


def links(nodes: DataFrame, stage: Stage, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links that connect all that is within the distance, from distinct fingerprints."""
    masks = plan(nodes, distance)
    if not masks:
        return nodes.sparkSession.createDataFrame([], "a long, b long")
    signatures = F.array(*(F.struct(F.lit(i).alias("sig"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)))
    probes = stage.keep(nodes.select("fp", F.explode(signatures).alias("s")).select("s.sig", "s.key", "fp"))
    sizes = stage.keep(probes.groupBy("sig", "key").agg(F.count("*").alias("n")).filter("n > 1"))
    met = stage.keep(probes.join(sizes, ["sig", "key"]))
    stage.drop(probes, sizes)
    small = bucket_links(met.filter(F.col("n") <= bucket), distance)
    crowded = met.filter(F.col("n") > bucket).select("fp").distinct()
    return small.unionByName(ball_links(crowded, distance))


def simhash_dedup(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """One row for each input row: doc_id, fingerprint (16 hex digits), component_id."""
    stage = Stage(docs.sparkSession, "simhash-dedup")
    prints = stage.keep(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), words))
    nodes = stage.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    parts = components(links(nodes.select("fp"), stage, distance), stage)
    joined = stage.keep(nodes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    least = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    named = joined.join(least, "component").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
