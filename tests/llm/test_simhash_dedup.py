import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from lakeloom.llm import simhash_dedup as S
from lakeloom.llm._stage import Stage


def brute_print(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints, distance=2):
    fps = sorted(set(prints.values()))
    up = {f: f for f in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= distance:
                up[find(a)] = find(b)
    least = {}
    for d, f in prints.items():
        r = find(f)
        least[r] = min(d, least.get(r, d))
    return {d: least[find(f)] for d, f in prints.items()}


def test_matches_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"W{i}é" for i in range(50)] + ["the", "Of", "x"]
    base = [[rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 40, 400]))] for _ in range(25)]
    data = []
    for d in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        data.append((d * 2, rng.choice([" ", "\n"]).join(w)))
    data += [(1001, None), (1003, ""), (1005, " \t")]
    got = S.simhash_dedup(spark.createDataFrame([(*r, "x", 0) for r in data], "doc_id long, text string, fp string, component_id int").repartition(5)).collect()
    prints = {d: brute_print(t) for d, t in data}
    want = brute_components(prints)
    assert {r.doc_id: r.fingerprint for r in got} == {d: f"{f:016x}" for d, f in prints.items()}
    assert {r.doc_id: r.component_id for r in got} == want


def test_links_small_and_crowded_buckets(spark):
    rng = random.Random(9)
    for bucket, distance in ((256, 2), (3, 2), (2, 3)):
        fps = set()
        for _ in range(12):
            f = rng.getrandbits(64)
            for _ in range(25):
                fps.add(f)
                f ^= 1 << rng.randrange(64) if rng.random() < 0.7 else (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        nodes = spark.createDataFrame([(S._signed(f),) for f in fps], "fp long")
        stage = Stage(spark, "t")
        got = S.components(S.links(nodes, stage, distance, bucket), stage)
        part = {r.node & (2**64 - 1): r.component & (2**64 - 1) for r in got.collect()}
        want = brute_components({f: f for f in fps}, distance)
        groups = lambda m: sorted(sorted(f for f in fps if m.get(f, f) == g) for g in {m.get(f, f) for f in fps})
        assert groups(part) == groups(want)


def test_empty_and_allocation(spark):
    assert S.simhash_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert S.allocate([[0, 1, 9], [0, 5, 6], [0, 2, 9]], 3) == (8.0, [0, 0, 0]) or S.allocate([[0, 1, 9], [0, 5, 6], [0, 2, 9]], 3)[0] <= 8
    same = spark.createDataFrame([(3, "a b"), (3, "a b"), (None, "a b")], "doc_id long, text string")
    assert S.simhash_dedup(same).agg(F.min("component_id"), F.count("*")).first() == (3, 3)


def test_candidate_counts_know_that_bits_depend_on_each_other(spark):
    rng = np.random.default_rng(8)
    seeds = rng.integers(0, 2, (400, 16))
    x = np.repeat(seeds, 4, axis=1)  # bits come in fours that mostly agree
    x = np.where(rng.random(x.shape) < 0.05, 1 - x, x)
    fps = np.packbits(x, axis=1, bitorder="little").view(np.uint64).ravel()
    n, both = S.bit_statistics(spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long"))
    assert n == 400 and (both == x.T @ x).all()
    part = S.correlated_partitions(n, both, 4)[0]
    at = x[:, part]
    apart = (at[:, None, :] != at[None, :, :]).sum(axis=2)[np.triu_indices(n, 1)]
    alone = 1 - 2 * x.mean(axis=0)[part] * (1 - x.mean(axis=0)[part])
    costs = S._costs(n, both, part, 1)
    for t, signatures in ((0, 1), (1, 16)):
        counted, guessed = (apart <= t).sum(), costs[t + 1] - n * signatures
        assert counted / 3 < guessed < counted * 3  # a chain knows neighbouring bits only
    assert n * n / 2 * alone.prod() < (apart == 0).sum() / 10  # what independent bits would say
