"""Centroid clustering of vectors by ball k-means, in whole numbers.

A cluster is a ball: a centroid and the largest distance of a member.  A centroid that is at least twice
that far away can take no member, so only nearer ones are neighbours.  Sorted by distance, they split
a ball: members closer than half the way to the nearest neighbour are its stable core and stay;
around it lie annuli, and members of the n-th are compared with the first n neighbours, exactly.

Spark cuts the vectors into blocks of rows; within a block each cluster's ball spans the block's members,
which leaves no more neighbours than the ball of all would.  Only sums of clusters and centroids,
``k`` vectors, reach the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

K, DIMENSION, ROUNDS, SCALE, SEED = 40, 64, 5, 256, "2"
#: Vectors compared at a time.
BLOCK = 1 << 13


def largest_component(dimension: int) -> int:
    """Up to here squared distances, and four times them, are exact in a long."""
    return math.isqrt((1 << 62) // (8 * dimension))


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` and ``y`` (int64)."""
    most = max([1, *(int(np.abs(a).max()) for a in (x, y) if a.size)])
    # As floats, with a fast product, where every intermediate value is a whole number below 2**53.
    kind = np.float64 if 4 * x.shape[1] * most * most < 1 << 53 else np.int64
    a, b = x.astype(kind), y.astype(kind)
    return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)


class Balls:
    """The centroids, each with the others in order of distance."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.apart = squared_distances(centroids, centroids)
        self.others = [np.array([j for j in np.argsort(row, kind="stable").tolist() if j != i], dtype=np.int64) for i, row in enumerate(self.apart)]

    def nearest(self, x: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest of the centroids ``among`` (ascending); ties to the smaller."""
        far = squared_distances(x, self.centroids[among])
        at = far.argmin(1)
        return among[at], far[np.arange(len(x)), at]

    def assign(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Clusters and squared distances of ``x``, whose clusters so far are ``home``; and how many distances that took."""
        cluster, distance, taken = home.copy(), np.zeros(len(x), np.int64), len(x)
        for i in np.unique(home).tolist():
            at = np.flatnonzero(home == i)
            members = x[at]
            own = squared_distances(members, self.centroids[i : i + 1])[:, 0]
            distance[at] = own
            radius = int(own.max())
            near = self.others[i]
            near = near[self.apart[i, near] <= 4 * radius]  # neighbours of the ball; equally far ones can tie
            # How many neighbours can be as near to a member as its own centroid: 0 in the stable core.
            annulus = np.searchsorted(self.apart[i, near], 4 * own, side="right")
            for n in np.unique(annulus).tolist():
                if n:
                    ring = np.flatnonzero(annulus == n)
                    among = np.sort(np.append(near[:n], i))
                    cluster[at[ring]], distance[at[ring]] = self.nearest(members[ring], among)
                    taken += len(ring) * n
        return cluster, distance, taken


def _vectors(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimension)


def _assigned(state: DataFrame, centroids: np.ndarray, first: bool) -> DataFrame:
    dimension = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls, everyone = Balls(centroids), np.arange(len(centroids))
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(start, BLOCK)
                x = _vectors(common.column(batch, "v"), dimension)
                if first:
                    cluster, distance = balls.nearest(x, everyone)
                else:
                    cluster, distance, _ = balls.assign(x, common.column(batch, "cluster").to_numpy().astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [common.column(batch, "vec_id"), common.column(batch, "v"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "v", "cluster", "distance"]
                )

    return state.mapInArrow(run, "vec_id long, v array<int>, cluster int, distance long")


def _moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after an update: whole means, rounded down; those of empty clusters stay."""
    k, dimension = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dimension), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            cluster = common.column(batch, "cluster").to_numpy()
            np.add.at(sums, cluster, _vectors(common.column(batch, "v"), dimension))
            counts += np.bincount(cluster, minlength=k)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = state.select("cluster", "v").mapInArrow(add, "cluster int, n long, sums array<long>")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    totals = parts.select("cluster", "n", F.posexplode("sums").alias("place", "part")).groupBy("cluster", "place").agg(exact("part").alias("total"), exact("n").alias("n"))
    out = centroids.copy()
    for r in totals.collect():  # k times the dimension at most
        out[r.cluster, r.place] = int(r.total) // int(r.n)
    return out


def cluster(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, dimension: int = DIMENSION, rounds: int = ROUNDS, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """Clusters of all vectors of ``dimension`` finite components, as ``floor(scale * component)``.

    Centroids start as the ``k`` vectors with the smallest SHA-256 of ``seed:id``; of fewer vectors, all.
    After ``rounds`` rounds of assigning and moving, vectors are assigned once more.  Ties go to the
    smaller number.  Rows that are null, shorter, longer or not finite are left out.  Repeated rows
    count each; of equal ids the smaller vector starts first, and null ids start last.  An empty table
    gives no rows; other columns are ignored.  Components beyond ``largest_component`` raise, as their
    distances would not be exact.  Tables of the rounds are removed at the end.
    """
    bound = largest_component(dimension)
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("given"))
    # A NaN is larger than any number here, and a null component is not below the bound.
    finite = F.forall("given", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    whole = F.transform("given", lambda x: F.floor(x * scale))
    fitting = F.when(F.exists(whole, lambda x: F.abs(x) > bound), F.raise_error(F.lit(f"a vector has a component beyond {bound}; its distances are not exact"))).otherwise(whole.cast("array<int>"))
    kept = given.filter((F.size("given") == dimension) & finite).select("vec_id", fitting.alias("v"))
    with common.scratch():
        state = common.written(kept.withColumn("cluster", F.lit(0)), "vectors")
        order = [F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), F.col("v").asc()]
        start = [r.v for r in state.select("vec_id", "v").orderBy(*order).limit(k).collect()]
        centroids = np.array(start, np.int64).reshape(-1, dimension)
        for n in range(rounds + 1):
            before = state
            state = common.written(_assigned(before, centroids, n == 0), "assigned", keep=n == rounds)
            common.discard(before)
            if n < rounds:
                centroids = _moved(state, centroids)
    sums = {r.cluster: int(r.s) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows at most
    shown = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    figures = vectors.sparkSession.createDataFrame([(i, s, sum(sums.values()), shown[i]) for i, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(figures), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
