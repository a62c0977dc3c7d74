import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm.centroid_clustering import cluster, distances, reassign, tightened

SCHEMA = "vec_id long, embedding array<float>, v int, cluster string, label int"


def expected(rows, k, rounds, n):
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in e]) for i, e in rows if e is not None and len(e) == n and all(x is not None and math.isfinite(x) for x in e)]
    seeds = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in seeds[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min(range(len(cents)), key=lambda j: (far(v, cents[j]), j))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v), []).append(v)
        cents = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(cents)]
    out = [(i, nearest(v), far(v, cents[nearest(v)])) for i, v in kept]
    own = {}
    for _, j, d in out:
        own[j] = own.get(j, 0) + d
    return sorted((i, j, d, own[j], sum(own.values()), hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for i, j, d in out)


def table(spark, rows):
    return spark.createDataFrame([(i, e, 1, "x", 0) for i, e in rows], SCHEMA).repartition(4)


@pytest.mark.parametrize("n, k, spread", [(64, 16, 0.3), (4, 5, 4.0), (3, 7, 100.0)])
def test_matches_brute_force(spark, n, k, spread):
    rng = random.Random(n)
    heads = [[rng.gauss(0, 1) for _ in range(n)] for _ in range(9)]
    rows = [(i, [x + rng.gauss(0, spread) / 10 for x in rng.choice(heads)]) for i in range(400)]
    rows += [(500 + i, heads[0]) for i in range(200)]  # copies
    rows += [(7, [0.5] * n), (7, [0.25] * n), (901, None), (902, []), (903, [1.0] * (n - 1)), (904, [1.0] * n + [2.0]), (905, [float("nan")] + [0.0] * (n - 1)), (906, [float("inf")] + [0.0] * (n - 1)), (907, [None] + [0.0] * (n - 1)), (908, [-0.01] * n)]
    out = cluster(table(spark, rows), k, 3, n)
    assert sorted(tuple(r)[:6] for r in out.collect()) == expected(rows, k, 3, n)
    if spread < 1:
        assert out.agg(F.avg("scans")).first()[0] < 3.5  # of 4: bounds settle some


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 2), 0.0]) for i in range(40)] + [(100, [0.5, 0.0])]
    assert sorted(tuple(r)[:6] for r in cluster(table(spark, rows), 3, 2, 2).collect()) == expected(rows, 3, 2, 2)


def test_fewer_vectors_than_clusters_and_none(spark):
    rows = [(1, [1.0, 2.0]), (2, [3.0, 4.0])]
    assert sorted(tuple(r)[:6] for r in cluster(table(spark, rows), 16, 3, 2).collect()) == expected(rows, 16, 3, 2)
    assert cluster(table(spark, [(1, None)]), 16, 3, 2).count() == 0
    assert cluster(spark.createDataFrame([], SCHEMA)).count() == 0


def test_null_id_and_huge_components(spark):
    rows = [(None, [1.0, 2.0]), (3, [1e30, 0.0]), (4, [0.0, 0.0])]
    got = cluster(table(spark, rows), 2, 1, 2).collect()
    assert sorted((str(r.vec_id), r.distance) for r in got) == [("4", 0), ("None", 0)]


def test_tightened_drift_holds_for_every_vector_of_the_sphere():
    rng = np.random.default_rng(5)
    tighter = 0
    for _ in range(400):
        n = int(rng.integers(2, 6))
        old, new = rng.normal(0, 5, (4, n)), rng.normal(0, 5, (4, n))
        radius = rng.uniform(0, 6, 4)
        bound, drift = tightened(old, new, radius), np.sqrt(((new - old) ** 2).sum(1))
        assert (bound <= drift[None, :] + 1e-9).all()
        tighter += int((bound < 0.9 * drift[None, :]).sum())
        way = rng.normal(0, 1, (200, n))
        way /= np.sqrt((way**2).sum(1))[:, None]
        for i in range(4):
            x = old[i] + way * radius[i] * rng.uniform(0, 1, (200, 1)) ** (1 / n)
            for j in range(4):
                shrunk = np.sqrt(((x - old[j]) ** 2).sum(1)) - np.sqrt(((x - new[j]) ** 2).sum(1))
                assert shrunk.max() <= bound[i, j] + 1e-7
    assert tighter > 1000


def test_reassign_scans_what_overlaps_only():
    rng = np.random.default_rng(1)
    cents = rng.integers(-100, 100, (5, 8))
    v = rng.integers(-100, 100, (300, 8))
    a, upper, lower = np.zeros(300, np.int32), np.full(300, np.inf), np.full(300, -np.inf)
    assert len(reassign(v, a, upper, lower, cents)) == 300 and (a == distances(v, cents).argmin(1)).all()
    two = np.sort(distances(v, cents))[:, :2]
    assert len(reassign(v, a, upper, lower, cents)) == int((two[:, 0] == two[:, 1]).sum())  # only ties
    assert (distances(v * 2**20, cents * 2**20) == distances(v, cents) * 2**40).all()
