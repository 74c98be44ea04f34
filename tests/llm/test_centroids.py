import hashlib
import math
import random

import numpy as np
import pytest

from parasift.llm.centroids import DIM, LIMIT, SortedCentroids, cluster

SCHEMA = "vec_id long, embedding array<float>, cluster string, id string, v string"


def by_rule(rows, clusters=8, rounds=10):
    keep = [(i, [max(-LIMIT, min(LIMIT, math.floor(1024 * x))) for x in v]) for i, v in rows
            if v is not None and len(v) == DIM and all(x is not None and math.isfinite(x) for x in v)]
    if not keep:
        return []
    name = lambda i: "" if i is None else str(i)
    order = sorted(keep, key=lambda r: (hashlib.sha256(f"3:{name(r[0])}".encode()).hexdigest(), r[1]))
    cents = [list(v) for _, v in order[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(cents))

    for _ in range(rounds):
        groups = {}
        for _, v in keep:
            groups.setdefault(nearest(v)[1], []).append(v)
        for k, vs in groups.items():
            cents[k] = [sum(col) // len(vs) for col in zip(*vs)]
    at = [(i, *nearest(v)) for i, v in keep]
    total = sum(d for _, d, _ in at)
    return sorted(((i, k, d, sum(e for _, e, j in at if j == k), total,
                    hashlib.sha256(",".join(map(str, cents[k])).encode()).hexdigest()) for i, d, k in at), key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(i, v, "c", "i", "v") for i, v in rows], SCHEMA).repartition(3)
    out = cluster(df)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(map(tuple, out.collect()), key=repr)


def vectors(n, seed=1, centres=12):
    rng = random.Random(seed)
    mid = [[rng.uniform(-1, 1) for _ in range(DIM)] for _ in range(centres)]
    f = lambda x: float(np.float32(x))
    return [(i, [f(m + rng.gauss(0, 0.2)) for m in rng.choice(mid)]) for i in range(n)]


def test_equals_brute_force_with_odd_rows(spark):
    rows = vectors(150)
    rows += [(500, None), (501, []), (502, [0.5] * (DIM - 1)), (503, [0.5] * (DIM - 1) + [None]), (504, [float("nan")] * DIM),
             (505, [float("inf")] * DIM), (506, [0.0] * DIM), (506, [0.0] * DIM), (None, [0.25] * DIM), (7, rows[7][1]),
             (508, [-0.0003] * DIM)]
    assert run(spark, rows) == by_rule(rows)


def test_equal_vectors_leave_clusters_empty(spark):
    rows = [(i, [0.5] * DIM) for i in range(40)] + [(99, [1.0] * DIM)]
    assert run(spark, rows) == by_rule(rows)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_fewer_vectors_than_centroids(spark, n):
    assert run(spark, vectors(n)) == by_rule(vectors(n))


def test_huge_components_are_held_at_the_limit(spark):
    rows = vectors(20) + [(100, [3e38] * DIM), (101, [-3e38] + [2000.5] * (DIM - 1)), (102, [1e30, -1e30] * (DIM // 2))]
    assert run(spark, rows) == by_rule(rows)


def test_search_is_exact_and_skips():
    rng = np.random.default_rng(4)
    centroids = rng.integers(-2000, 2000, (200, DIM)) + rng.integers(-3000, 3000, (200, 1))
    x = centroids[rng.integers(0, 200, 3000)] + rng.integers(-300, 300, (3000, DIM))
    label, dist, done = SortedCentroids(centroids).nearest(x)
    full = ((x[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert (dist == full.min(axis=1)).all() and (label == full.argmin(axis=1)).all()
    assert done < 0.1 * full.size  # the two inequalities reject the rest


def test_ties_go_to_the_smaller_number():
    c = np.zeros((4, DIM), np.int64)
    c[0, 0], c[1, 0], c[2, 0], c[3, 0] = 9, 3, -3, 3
    label, dist, _ = SortedCentroids(c).nearest(np.zeros((1, DIM), np.int64))
    assert (label[0], dist[0]) == (1, 9)
