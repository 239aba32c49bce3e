"""Exact clustering against plain Python integers."""

import hashlib
import math
import random

import numpy as np

from parcelgrid.llm import subvector_kmeans as S

TYPE = "vec_id long, embedding array<double>, label int, id string, cluster string, distance string"


def plain(rows, k, rounds, dims, seed=3):
    kept = [(i, [math.floor(v * 1024) if abs(v) < 2 ** 53 else int(v) * 1024 for v in x]) for i, x in rows
            if x is not None and len(x) == dims and all(v is not None and math.isfinite(v) for v in x)]
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)
    centroids = [x for _, x in order[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(nearest(x)[1], []).append(x)
        centroids = [[sum(col) // len(groups[n]) for col in zip(*groups[n])] if n in groups else c
                     for n, c in enumerate(centroids)]
    found = [(i, *nearest(x)[::-1]) for i, x in kept]
    own = {n: sum(d for _, m, d in found if m == n) for n in range(len(centroids))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, n, d, own[n], sum(own.values()), sha[n]) for i, n, d in found]


def check(spark, rows, k=8, rounds=10, dims=64, parts=3, **options):
    table = spark.createDataFrame([(i, x, 1, "x", "y", "z") for i, x in rows], TYPE).repartition(parts)
    got = S.cluster_vectors(table, k, rounds, dims=dims, **options)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(rows, k, rounds, dims), key=key)


def test_against_plain_integers(spark):
    rng = random.Random(5)
    hot = [rng.gauss(0, 1) for _ in range(64)]
    rows = [(n, hot if n % 3 == 0 else [rng.gauss(n % 5, 0.3) for _ in range(64)]) for n in range(240)]
    odd = [(900, None), (901, []), (902, hot[:63]), (903, hot + [0.0]), (904, hot[:63] + [None]), (905, hot[:63] + [math.nan]),
           (906, hot[:63] + [math.inf]), (None, hot), (None, [0.5] * 64), (7, rows[7][1]), (7, hot), (907, [0.0] * 64),
           (908, [-0.0] * 64)]
    check(spark, rows + odd, shard_rows=37)
    check(spark, rows[:30], block_dims=7, shard_rows=1000)


def test_ties_empty_clusters_and_few_rows(spark):
    same = [(n, [1.0, -1.0]) for n in range(20)]
    check(spark, same + [(50, [1.5, -1.0])], k=4, rounds=3, dims=2)  # equal starts: all go to the smallest number
    check(spark, [(1, [0.25, -3.1]), (2, [9.0, 9.0])], dims=2)  # fewer rows than centroids
    check(spark, [(n, [(-1) ** n * 0.0005 * n, -0.001 * n]) for n in range(31)], k=3, dims=2, shard_rows=4)  # floors below zero
    assert S.cluster_vectors(spark.createDataFrame([], TYPE)).count() == 0
    assert S.cluster_vectors(spark.createDataFrame([(None, [1.0] * 64, 1, "", "", "")], TYPE)).count() == 0


def test_large_components_stay_exact(spark):
    rng = random.Random(8)
    rows = [(n, [rng.choice([1e5, 3e4, -7.5e5]) + rng.random() for _ in range(3)]) for n in range(40)]
    check(spark, rows, k=4, dims=3, rounds=4, shard_rows=9)
    huge = spark.createDataFrame([(n, [1e300 * n, 1e-300, 2.0 ** 60], 1, "", "", "") for n in range(6)], TYPE)
    got = S.cluster_vectors(huge, 2, 2, dims=3).collect()
    assert len(got) == 6 and any(r.distance is None for r in got) and all(r.inertia is None for r in got)


def test_dictionaries_lose_nothing():
    rng = np.random.default_rng(2)
    x = rng.integers(-3, 3, (500, 10))
    blocks, codes = S.dictionaries(x, 4)
    assert [b.shape[1] for b in blocks] == [4, 4, 2] and len(blocks[2]) <= 36
    assert (np.hstack([b[codes[:, k]] for k, b in enumerate(blocks)]) == x).all()


def test_limbs_add_up():
    for v in (0, 1, -1, 2 ** 32, -2 ** 95 - 7, 10 ** 40):
        assert sum(part << (32 * place) for place, part in enumerate(S._limbs(v))) == v
        assert all(abs(part) <= 1 << 32 for part in S._limbs(v))
