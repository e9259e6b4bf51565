"""Ball k-means against comparing every vector with every centroid."""

import glob
import hashlib
import os

import numpy as np
import pytest
from pyspark.errors import PythonException, SparkRuntimeException

from visitprep.llm import ball_kmeans, common

SCHEMA = "vec_id long, embedding array<double>, label int, cluster int, v string"


def plain(rows, k, rounds):
    """(vec_id, cluster, distance) and the final centroids, by brute force in Python's integers."""
    start = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [list(v) for _, v in start[:k]]
    for n in range(rounds + 1):
        best = [min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids)) for _, v in rows]
        if n < rounds:
            for i in range(len(centroids)):
                own = [v for (_, v), (_, j) in zip(rows, best) if i == j]
                if own:
                    centroids[i] = [sum(x) // len(own) for x in zip(*own)]
    return [(r[0], i, d) for r, (d, i) in zip(rows, best)], centroids


def vectors(n, dimension, spread, seed=1):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 1, (12, dimension))
    return [(i, [float(x) for x in middles[i % 12] + rng.normal(0, spread, dimension)]) for i in range(n)]


@pytest.mark.parametrize("spread, dimension, k", [(0.05, 8, 12), (0.8, 8, 20), (1.5, 3, 30), (0.0, 4, 20)])
def test_same_as_brute_force(spark, monkeypatch, spread, dimension, k):
    monkeypatch.setattr(ball_kmeans, "BLOCK", 64)
    given = vectors(500, dimension, spread)
    frame = spark.createDataFrame([(i, v, 0, 9, "x") for i, v in given], SCHEMA).repartition(5)
    got = ball_kmeans.cluster(frame, k=k, dimension=dimension, rounds=4).collect()
    want, centroids = plain([(i, [int(np.floor(256 * x)) for x in v]) for i, v in given], k, 4)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got) == sorted(want)
    total = sum(d for *_, d in want)
    for r in got:
        assert r.inertia == total and r.cluster_inertia == sum(d for _, i, d in want if i == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()


def test_cores_and_annuli_save_distances():
    x = np.floor(256 * np.array([v for _, v in vectors(600, 8, 0.05)])).astype(np.int64)
    balls = ball_kmeans.Balls(x[:12])
    home, _ = balls.nearest(x, np.arange(12))
    cluster, distance, taken = balls.assign(x, home)
    assert (cluster == home).all() and taken == len(x)  # every ball is a stable core: no neighbour is looked at
    moved, far, taken = balls.assign(x, np.roll(home, 100))
    want = balls.nearest(x, np.arange(12))
    assert (moved == want[0]).all() and (far == want[1]).all() and taken > len(x)


def test_ties_and_large_components():
    points = np.array([[0, 0], [4, 0], [0, 0], [2, 0]], np.int64)
    balls = ball_kmeans.Balls(points[:3])
    for home in ([0, 1, 2, 1], [2, 0, 2, 0], [1, 1, 1, 2]):
        cluster, distance, _ = balls.assign(points, np.array(home))
        assert cluster.tolist() == [0, 1, 0, 0] and distance.tolist() == [0, 0, 0, 4]
    most = ball_kmeans.largest_component(64)
    far = ball_kmeans.squared_distances(np.full((1, 64), most), np.full((1, 64), -most))
    assert int(far[0, 0]) == 64 * (2 * most) ** 2 and 4 * int(far[0, 0]) < 1 << 63


def test_awkward_rows(spark):
    sound = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (2, [-0.001, 3.0]), (None, [9.0, 9.0]), (5, [0.0, 0.0])]
    odd = [(6, None), (7, []), (8, [1.0]), (9, [1.0, None]), (10, [1.0, float("nan")]), (11, [float("-inf"), 1.0]), (12, [1.0, 1.0, 1.0])]
    frame = spark.createDataFrame([(i, v, None, 1, None) for i, v in sound + odd], SCHEMA)
    got = ball_kmeans.cluster(frame, k=3, dimension=2, rounds=2).collect()
    want, _ = plain([(i, [int(np.floor(256 * x)) for x in v]) for i, v in sound], 3, 2)
    assert sorted(map(repr, want)) == sorted(repr((r.vec_id, r.cluster, r.distance)) for r in got)
    few = ball_kmeans.cluster(frame.filter("vec_id = 5"), k=3, dimension=2).collect()
    assert [(r.vec_id, r.cluster, r.distance, r.inertia) for r in few] == [(5, 0, 0, 0)]
    assert ball_kmeans.cluster(frame.limit(0), dimension=2).collect() == []
    assert ball_kmeans.cluster(spark.createDataFrame(odd[:4], "vec_id long, embedding array<double>"), dimension=2).collect() == []
    with pytest.raises((SparkRuntimeException, PythonException, Exception), match="not exact"):
        ball_kmeans.cluster(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>"), dimension=2).collect()


def test_only_the_result_stays(spark):
    frame = spark.createDataFrame(vectors(50, 4, 0.5), "vec_id long, embedding array<double>")
    folder = f"{common.shared_folder(spark).removeprefix('file:')}/tables"
    before = set(glob.glob(f"{folder}/*"))
    out = ball_kmeans.cluster(frame, k=5, dimension=4)
    left = set(glob.glob(f"{folder}/*")) - before
    assert len(left) == 1 and os.path.basename(left.pop()).startswith("assigned-") and out.count() == 50
