"""Heap-ordered centroid clustering against plain Lloyd rounds."""

import hashlib
import math

import numpy as np
import pytest

from barloom.llm import centroids

SCHEMA = "vec_id bigint, embedding array<float>, cluster string, _c int, width string"


def plain(rows, k, rounds, dims, scale=256):
    """Lloyd rounds in whole numbers, every vector against every centroid."""
    kept = []
    for vec, x in rows:
        if x is not None and len(x) == dims and all(e is not None and math.isfinite(e) for e in x):
            kept.append((vec, [math.floor(scale * float(np.float32(e))) for e in x]))
    hashed = sorted((hashlib.sha256(f"2:{v}".encode()).hexdigest() if v is not None else "~", x) for v, x in kept)
    centers = [x for _, x in hashed[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c)), i) for i, c in enumerate(centers)) for _, x in kept]

    for _ in range(rounds):
        at = assign()
        for i in range(len(centers)):
            own = [x for (_, x), (_, c) in zip(kept, at) if c == i]
            if own:
                centers[i] = [sum(col) // len(own) for col in zip(*own)]
    at = assign()
    inertia = {i: sum(d for d, c in at if c == i) for i in range(len(centers))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((v if v is not None else -1), c, d, inertia[c], sum(inertia.values()), sha[c]) for (v, _), (d, c) in zip(kept, at))


def made(spark, rows, parts=3):
    return spark.createDataFrame([(v, x, "x", 1, "w") for v, x in rows], SCHEMA).repartition(parts)


def found(df):
    return sorted((r["vec_id"] if r["vec_id"] is not None else -1, *list(r)[1:]) for r in df.collect())


def vectors(n, dims, seed):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 1, (12, dims))
    return [(i, (middles[i % 12] + rng.normal(0, 0.4, dims)).astype(np.float32).tolist()) for i in range(n)]


ODD = [
    (900, None), (901, []), (902, [1.0] * 7), (903, [float("nan")] + [0.0] * 7), (904, [None] + [0.0] * 7), (905, [float("inf")] * 8),
    (906, [0.0] * 8), (907, [0.0] * 8), (907, [0.0] * 8), (None, [0.5] * 8), (908, [-300.0] * 8), (909, [1e-9] * 8), (910, [-1e-9] * 8),
]


@pytest.mark.parametrize("block", [7, 2048])
def test_matches_plain_rounds(spark, monkeypatch, block):
    monkeypatch.setattr(centroids, "BLOCK", block)
    rows = vectors(400, 8, 1) + ODD
    out = centroids.cluster(made(spark, rows), k=15, rounds=5, dims=8)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert found(out) == plain(rows, 15, 5, 8)


def test_ties_copies_and_few_vectors(spark):
    grid = [(i, [float(i % 3), float(i % 2)]) for i in range(60)]  # many equal vectors and equal distances
    assert found(centroids.cluster(made(spark, grid), k=10, rounds=3, dims=2)) == plain(grid, 10, 3, 2)
    few = vectors(5, 4, 2)
    assert found(centroids.cluster(made(spark, few), k=40, rounds=2, dims=4)) == plain(few, 40, 2, 4)
    assert found(centroids.cluster(made(spark, few), k=1, rounds=2, dims=4)) == plain(few, 1, 2, 4)


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**18 + 7 * i), -float(3 * i * i)] * 3) for i in range(30)]
    assert found(centroids.cluster(made(spark, rows), k=4, rounds=3, dims=6)) == plain(rows, 4, 3, 6)
    with pytest.raises(Exception, match="fit a long"):
        centroids.cluster(made(spark, [*rows, (99, [1e30] * 6)]), k=4, rounds=1, dims=6).collect()


def test_only_expired_vectors_are_popped():
    heaps = [[(0.5, 3), (2.0, 1)], [(0.1, 0), (7.0, 2)]]
    assert centroids.expired(heaps, np.array([1.0, 0.0])) == [3] and heaps == [[(2.0, 1)], [(0.1, 0), (7.0, 2)]]


def test_bounds_spare_vectors(spark, monkeypatch):
    """Well separated groups: after the first round nearly all keep their cluster without being compared again."""
    popped = []
    real = centroids.stage

    def seen(df, label):
        out = real(df, label)
        if label == "clusters":
            popped.append(out.selectExpr("sum(popped) AS n").first()["n"])
        return out

    monkeypatch.setattr(centroids, "stage", seen)
    rng = np.random.default_rng(4)
    middles = rng.normal(0, 20, (6, 8))
    rows = [(i, (middles[i % 6] + rng.normal(0, 0.1, 8)).tolist()) for i in range(600)]
    out = centroids.cluster(made(spark, rows), k=20, rounds=5, dims=8)
    assert found(out) == plain(rows, 20, 5, 8)
    assert popped[0] == 600 and sum(popped[2:]) < 600 * len(popped[2:])


def test_empty(spark):
    out = centroids.cluster(made(spark, [(1, None)]), dims=8)
    assert out.collect() == [] and dict(out.dtypes)["cluster"] == "int"
    assert centroids.cluster(made(spark, vectors(2, 8, 1)).limit(0), dims=8).collect() == []
