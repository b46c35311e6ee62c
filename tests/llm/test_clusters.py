"""Centroid clustering by the threshold algorithm against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest

from gaugeframe.llm import threshold_clusters as T


def plain(rows, k=16, rounds=3, dimensions=64, scale=64):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "~", np.array(r[1], np.int64).tobytes()))
    centroids = [v for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds if centroids else 0):
        found = assign()
        for c in range(len(centroids)):
            mine = [v for (_, v), (_, i) in zip(kept, found) if i == c]
            if mine:
                centroids[c] = [sum(x) // len(mine) for x in zip(*mine)]
    found = assign() if kept else []
    sums = [sum(d for d, i in found if i == c) for c in range(len(centroids))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(key, c, d, sums[c], sum(sums), names[c]) for (key, _), (d, c) in zip(kept, found)]


def vectors(n, dimensions, seed, groups=5, spread=0.1):
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(groups, dimensions))
    return (heads[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dimensions))).astype(np.float32).astype(float).tolist()


def check(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "x", 3) for i, v in rows], "vec_id long, embedding array<double>, id string, cluster int").repartition(3)
    found = T.cluster(df, **options)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted(plain(rows, **options), key=str)


def test_clusters_equal_plain_python(spark):
    check(spark, list(enumerate(vectors(300, 64, 1))))


def test_unusable_rows_and_repeated_rows(spark):
    rows = list(enumerate(vectors(60, 64, 2)))
    rows += [(100, None), (101, []), (102, [1.0] * 63), (103, [1.0] * 65), (104, [None] + [1.0] * 63), (105, [math.nan] * 64), (106, [math.inf] + [0.0] * 63)]
    rows += [(None, [0.5] * 64), (3, rows[7][1]), (7, rows[7][1]), (108, [0.0] * 64), (109, [-0.0] * 64)]
    check(spark, rows)


def test_ties_and_few_distinct_vectors(spark):
    """Small whole numbers: many centroids at one distance, equal centroids, empty clusters."""
    rng = random.Random(3)
    rows = [(i, [float(rng.randrange(2)) for _ in range(3)]) for i in range(200)]
    check(spark, rows, dimensions=3, scale=1, k=12, rounds=2)


def test_a_vector_that_most_rows_hold(spark):
    rows = [(i, [0.25] * 4) for i in range(300)] + [(300 + i, v) for i, v in enumerate(vectors(40, 4, 5))]
    check(spark, rows, dimensions=4, k=5)


def test_fewer_vectors_than_centroids_and_none(spark):
    check(spark, [(5, [1.0, 2.0]), (6, [3.0, 4.0])], dimensions=2)
    check(spark, [], dimensions=2)
    check(spark, [(1, None)], dimensions=2)


def test_components_too_large_for_exact_distances(spark):
    df = spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="would not fit"):
        T.cluster(df).collect()


def test_the_walk_stops_early():
    """Of well separated centroids, few distances are computed; the answers are those of all distances."""
    rng = np.random.default_rng(6)
    centroids = rng.integers(-10_000, 10_000, (200, 4))
    x = centroids[rng.integers(0, 200, 500)] + rng.integers(-20, 20, (500, 4))
    number, distance, computed = T.Lists(centroids).nearest(x)
    full = ((x[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert (number == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
    assert computed < 0.1 * full.size


def test_random_walks_equal_full_search():
    rng = np.random.default_rng(7)
    for _ in range(60):
        dims, k = int(rng.integers(1, 6)), int(rng.integers(1, 9))
        centroids, x = rng.integers(-3, 4, (k, dims)), rng.integers(-4, 5, (40, dims))
        full = ((x[:, None, :] - centroids[None]) ** 2).sum(axis=2)
        number, distance, _ = T.Lists(centroids).nearest(x)
        assert (number == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
