"""Centroid clustering against plain integer k-means."""

import hashlib
import math

import numpy as np
import pytest

from rankweave.llm import centroid_tournament as ct


def plain_clusters(rows, dims, k, rounds, scale=1024, salt="3:"):
    """[(id, vector)] -> ([(id, cluster, distance)], centroids)"""
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{salt}{r[0]}".encode()).hexdigest())
    c = [v for _, v in sorted(kept, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        groups = {j: [v for (_, v), a in zip(kept, at) if a == j] for j in range(len(c))}
        c = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if groups[j] else m for j, m in enumerate(c)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept], c


def test_tournament_finds_the_nearest_with_ties_to_smaller_numbers():
    rng = np.random.default_rng(3)
    for _ in range(30):
        c = rng.integers(-3, 4, (rng.integers(1, 9), 4)).tolist()
        x = rng.integers(-5, 6, (300, 4))
        d = ((x[:, None, :] - np.array(c)[None, :, :]) ** 2).sum(axis=2)
        t = ct.Tournament(c)
        assert (t.winners(x) == d.argmin(axis=1)).all() and (t.distances(x, t.winners(x)) == d.min(axis=1)).all()


def test_limits_fit_into_64_bits():
    for dims in (1, 3, 64, 100, 1024):
        m = ct.largest_component(dims)
        x, c = np.full((1, dims), m), [[-m] * dims, [m] * dims]
        t = ct.Tournament(c)
        assert t.winners(x)[0] == 1 and t.distances(x, np.array([0]))[0] == dims * 4 * m * m < 1 << 63


def test_clusters_match_plain_rounds(spark, base):
    table = spark.read.parquet(f"{base}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    for frame in (table, table.repartition(7)):
        out, centroids = ct.cluster_vectors(frame)
        want, c = plain_clusters(rows, 64, 8, 10)
        assert sorted(map(tuple, out.collect())) == sorted(want)
        assert [r["centroid"] for r in centroids.orderBy("cluster").collect()] == c


def test_clusters_of_odd_vectors(spark):
    nan, inf = math.nan, math.inf
    rows = [(1, [0.0, 0.0]), (2, [0.0, -0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [1.0, None]), (6, [nan, 1.0]), (7, [1.0, -inf]), (None, [3.0, -0.0001]),
            (8, [1.0, 2.0, 3.0]), (9, []), (10, [5.0, 5.0]), (11, [-5.0, 0.1]), (12, [0.5, 0.0005])]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, cluster string, id string")
    for k in (1, 3, 8, 50):
        out, centroids = ct.cluster_vectors(frame, dims=2, k=k, rounds=4)
        want, c = plain_clusters([(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 2, k, 4)
        assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
        assert [r["centroid"] for r in centroids.orderBy("cluster").collect()] == c
    out, centroids = ct.cluster_vectors(frame.limit(0))
    assert out.count() == 0 and centroids.count() == 0 and out.columns == ["id", "cluster", "distance"]
    with pytest.raises(Exception, match="smaller scale"):
        ct.cluster_vectors(spark.createDataFrame([(1, [1e9, 0.0])], "vec_id long, embedding array<double>"), dims=2)
