"""Ball k-means against Lloyd's rounds in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from lumaloom.llm import ball_kmeans as B

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain_kmeans(table, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in table if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    code = lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest()
    centroids = [v for i, v in sorted((r for r in kept if r[0] is not None), key=lambda r: (code(r[0]), r[1]))[:k]]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min((distance(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(members[j]) for x in zip(*members[j])] if j in members else c for j, c in enumerate(centroids)]
    found = [(i, *reversed(nearest(v))) for i, v in kept]
    inertia = {j: sum(d for _, c, d in found if c == j) for _, j, _ in found}
    name = lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), name(c)) for i, c, d in found), key=str)


def queried(spark, tmp_path, table, schema=SCHEMA):
    spark.createDataFrame(table, schema).repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    out = B.op13_ball_kmeans(spark, str(tmp_path))
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def clouds(rng, n, centres=5, spread=0.1):
    middle = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(centres)]
    return [[x + rng.gauss(0, spread) for x in rng.choice(middle)] for _ in range(n)]


@pytest.mark.parametrize("spread", [0.05, 1.5])
def test_clouds(spark, tmp_path, spread):
    table = [(i, v, 0) for i, v in enumerate(clouds(random.Random(1), 400, spread=spread))]
    assert queried(spark, tmp_path, table) == plain_kmeans([r[:2] for r in table])


def test_edges(spark, tmp_path):
    rng = random.Random(2)
    good = clouds(rng, 60, spread=0.4)
    table = [(i // 2, v, None) for i, v in enumerate(good)] + [(7, good[0], 1)] * 20 + [(None, v, 2) for v in good[:5]] + [(500, [0.0] * 64, 1)]
    bad = [(600, None, 1), (601, [], 1), (602, [1.0] * 63, 1), (603, [1.0] * 63 + [None], 1), (604, [float("nan")] + [0.0] * 63, 1), (605, [float("inf")] + [0.0] * 63, 1)]
    assert queried(spark, tmp_path, table + bad) == plain_kmeans([r[:2] for r in table])


def test_equal_vectors_leave_clusters_empty(spark, tmp_path):
    table = [(i, [0.25 * (i % 3)] * 64, 0) for i in range(30)]
    assert queried(spark, tmp_path, table) == plain_kmeans([r[:2] for r in table])


def test_few_large_and_no_vectors(spark, tmp_path):
    rng = random.Random(4)
    table = [(i, [rng.uniform(-9e4, 9e4) for _ in range(64)], 0) for i in range(5)]
    assert queried(spark, tmp_path / "few", table) == plain_kmeans([r[:2] for r in table])
    assert queried(spark, tmp_path / "none", []) == []
    far = queried(spark, tmp_path / "far", [(i, [1e300 * (-1) ** i] * 64, 0) for i in range(20)])
    assert len(far) == 20 and all(0 <= r[2] < 2**63 and 0 <= r[4] < 2**63 for r in far)
    more = queried(spark, tmp_path / "more", [(1, [0.5] * 64, 0, 9, [1], "x")], SCHEMA + ", cluster int, v array<int>, kind string")
    assert [r[:3] for r in more] == [(1, 0, 0)]


def test_balls_leave_out_only_what_cannot_be_nearer():
    """Neighbours by radii and annuli give the same as all distances, with ties, and skip most of them."""
    rng = np.random.default_rng(0)
    centroids = rng.integers(-500, 500, (12, 8))
    x = np.concatenate([centroids.repeat(40, axis=0) + rng.integers(-90, 90, (480, 8)), (centroids[:6] + centroids[6:]) // 2])
    everything = B.all_squared(x, centroids)
    start = everything.argsort(axis=1)[:, rng.integers(0, 2)]  # some members of the wrong ball
    own = everything[np.arange(len(x)), start]
    radii = [int(math.isqrt(int(own[start == i].max()))) + 1 if (start == i).any() else 0 for i in range(12)]
    balls = B.Balls(centroids, radii)
    cluster, distance = balls.assign(x, start)
    assert (cluster == everything.argmin(axis=1)).all() and (distance == everything.min(axis=1)).all()
    tight = B.Balls(centroids, [200] * 12)
    assert sum(len(n) for n in tight.neighbours) < 12 * 11 / 2
