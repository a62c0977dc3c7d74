"""K-means over integer vectors, exact, with geometric tightening of the centroids' drift.

Each vector carries its cluster, an upper bound on the distance to its own centroid and a lower
bound on the distance to all others. When the centroids move, a lower bound need not shrink by the
whole drift of the farthest mover: all vectors of cluster i lie in a sphere around its old centroid,
whose radius is the largest upper bound of its vectors, and for that sphere the most that the
distance to a moved centroid j can shrink follows from plane geometry (`tightened`). Vectors whose
bounds then overlap are compared with their own centroid, and if that does not settle it, scanned
against all centroids in integer arithmetic. Bounds only save work: assignments are those of a full
scan, ties included.

A round is one pass over a kept table of vectors and bounds, in Arrow batches, and one aggregation
to a row for each cluster (partial sums in every task); no vector is shuffled. To the driver come
the K seeds, and K rows of sums a round. Centroids, radii and bounds (K rows) go along with the
tasks.

Defined cases: vectors that are null, of another length, or with a null or non-finite component are
left out; so are those with a component of 2**21 or more, whose squared distances may not fit a
long. With fewer vectors than K, each is a centroid. Rows that share a vec_id are vectors each on
their own; seeds of one hash are ordered by their components; a null vec_id counts as an empty text
in the seeds' hash. Of the input, only vec_id and embedding are read. An empty table gives an empty
result. A sum of distances beyond a long is null.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._stage import Stage

DIMENSIONS = 64
CLUSTERS = 16
ROUNDS = 3
#: Components become floor(SCALE * x).
SCALE = 64
#: Of a component before scaling; keeps squared distances below 2**62.
MOST = float(2**21)
#: Products of components below this are exact as doubles, summed over DIMENSIONS as well.
_SMALL = 2**22
#: Distances are square roots of integers; bounds within this share of each other count as equal.
_SLACK = 1e-9


def vectors(rows: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, v): the integer vectors of the rows that count."""
    x = F.col("embedding")
    whole = F.forall(x, lambda e: F.coalesce(F.abs(e.cast("double")) < MOST, F.lit(False)))  # NaN is above all numbers
    scaled = F.transform(x, lambda e: F.floor(F.lit(float(SCALE)) * e.cast("double")).cast("int"))
    return rows.select("vec_id", "embedding").filter((F.size(x) == dimensions) & whole).select("vec_id", scaled.alias("v"))


def tightened(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """[i, j]: the most by which a move of centroid j can shorten its distance to a vector of cluster i.

    Of a vector x, seen from the middle of j's move under an angle t to it, the distance shrinks by
    at most drift * cos(t): vectors with one value of shrinkage form a sheet of a hyperboloid
    around the move, and the sheet lies inside the cone of its asymptotes, whose tip is the middle.
    In the plane of the move and the sphere's centre, the sphere is seen between the angles
    centre - a and centre + a with sin(a) = radius / distance, so the least angle bounds them all.
    A sphere that holds the middle of the move gives the whole drift; one behind it gives nothing.
    """
    move, middle = new - old, (new + old) / 2
    drift = np.sqrt((move**2).sum(1))
    way = old[:, None, :] - middle[None, :, :]
    far = np.sqrt((way**2).sum(2))
    safe = np.where((far > radius[:, None]) & (drift[None, :] > 0), far, 1.0)
    centre = np.arccos(np.clip((way * move[None]).sum(2) / safe / np.where(drift > 0, drift, 1.0)[None, :], -1, 1))
    least = np.maximum(0.0, centre - np.arcsin(np.clip(radius[:, None] / safe, 0, 1)))
    bound = drift[None, :] * np.where(far > radius[:, None], np.maximum(0.0, np.cos(least)), 1.0)
    return np.minimum(drift[None, :], bound * (1 + _SLACK) + _SLACK * (drift[None, :] > 0))


def distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs, exact."""
    if max(np.abs(v).max(initial=0), np.abs(centroids).max(initial=0)) < _SMALL:
        a, c = v.astype(np.float64), centroids.astype(np.float64)
        return ((a**2).sum(1)[:, None] - 2 * (a @ c.T) + (c**2).sum(1)).astype(np.int64)
    out = np.empty((len(v), len(centroids)), dtype=np.int64)
    for j, c in enumerate(centroids):
        out[:, j] = ((v - c) ** 2).sum(1)
    return out


def _own(v: np.ndarray, centroids: np.ndarray, a: np.ndarray) -> np.ndarray:
    return ((v - centroids[a]) ** 2).sum(1)


def reassign(v: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Updates the clusters and bounds of vectors in place; gives the places that needed a full scan."""
    apart = lambda at: upper[at] + _SLACK * (1 + upper[at]) < lower[at]
    near = np.flatnonzero(~apart(slice(None)))
    upper[near] = np.sqrt(_own(v[near], centroids, a[near]))
    near = near[~apart(near)]
    if len(near):
        d = distances(v[near], centroids)
        at, best = np.arange(len(near)), d.argmin(1)  # the first of equal ones
        a[near], upper[near] = best, np.sqrt(d[at, best])
        d[at, best] = np.iinfo(np.int64).max
        lower[near] = np.sqrt(d.min(1)) if d.shape[1] > 1 else np.inf
    return near


def _pass(state: DataFrame, centroids: np.ndarray, moved: np.ndarray, loosened: np.ndarray, last: bool) -> DataFrame:
    """One assignment; in the last, the exact distance takes the place of vector and bounds."""
    n = centroids.shape[1]

    def run(batches):
        for batch in batches:
            v = batch.column(1).flatten().to_numpy().reshape(-1, n).astype(np.int64)
            a = batch.column(2).to_numpy().copy()
            upper, lower = batch.column(3).to_numpy() + moved[a], batch.column(4).to_numpy() - loosened[a]
            scans = batch.column(5).to_numpy().copy()
            scans[reassign(v, a, upper, lower, centroids)] += 1
            cols = [pa.array(_own(v, centroids, a))] if last else [batch.column(1), pa.array(upper), pa.array(lower)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a), *cols, pa.array(scans)], names=["vec_id", "cluster", *(["distance"] if last else ["v", "upper", "lower"]), "scans"])

    kind = dict(state.dtypes)["vec_id"]
    held = "distance long" if last else "v array<int>, upper double, lower double"
    return state.select("vec_id", "v", "cluster", "upper", "lower", "scans").mapInArrow(run, f"vec_id {kind}, cluster int, {held}, scans int")


def cluster(rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, scans), a row for each vector that counts.

    scans: in how many of the rounds + 1 assignments the vector was compared with all centroids.
    """
    spark = rows.sparkSession
    stage = Stage(spark, "clusters")
    kept = stage.keep(vectors(rows, dimensions))
    order = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    centroids = np.array([r.v for r in kept.orderBy(order, "v").limit(clusters).select("v").collect()], dtype=np.int64).reshape(-1, dimensions)
    k = len(centroids)
    state = kept.withColumns({"cluster": F.lit(0), "upper": F.lit(float("inf")), "lower": F.lit(float("-inf")), "scans": F.lit(0)})
    moved = loosened = np.zeros(max(k, 1))
    for _ in range(rounds if k else 0):
        before, state = state, stage.keep(_pass(state, centroids, moved, loosened, last=False))
        stage.drop(before if before is not kept else kept)
        totals = state.groupBy("cluster").agg(F.count("*").alias("n"), F.max("upper").alias("radius"), F.array(*(F.sum(F.get("v", F.lit(i)).cast("long")) for i in range(dimensions))).alias("total")).collect()
        new, radius = centroids.copy(), np.zeros(k)
        for r in totals:
            new[r.cluster], radius[r.cluster] = [t // r.n for t in r.total], r.radius
        bounds = tightened(centroids.astype(float), new.astype(float), radius)
        np.fill_diagonal(bounds, 0)
        moved, loosened = np.sqrt(((new - centroids) ** 2).sum(1)), bounds.max(1)
        centroids = new
    done = stage.keep(_pass(state, centroids, moved, loosened, last=True))
    sums = {r.cluster: r.s for r in done.groupBy("cluster").agg(F.try_sum("distance").alias("s")).collect()}
    total = sum(sums.values()) if all(s is not None for s in sums.values()) else None
    digest = lambda c: sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    about = [(j, sums[j], total if total is None or total < 2**63 else None, digest(c)) for j, c in enumerate(centroids) if j in sums]
    listed = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # a row for each cluster
    return done.join(F.broadcast(listed), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scans")
