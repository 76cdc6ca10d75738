import hashlib
import random

import numpy as np

from tessera.llm import centroids
from tessera.session import read_table
from tests.conftest import SF01


def brute(rows, k, rounds, dims, scale=64):
    """{id: (cluster, distance)} and the centroids, from the definition in Python integers."""
    kept = {i: [int(np.floor(scale * x)) for x in v] for i, v in rows.items()
            if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)}
    first = sorted(kept, key=lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest())[:k]
    cs = [kept[i] for i in first]

    def assign():
        return {i: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cs))[::-1] for i, v in kept.items()}
    for _ in range(rounds):
        of = assign()
        for n in range(len(cs)):
            own = [kept[i] for i in kept if of[i][0] == n]
            if own:
                cs[n] = [sum(c) // len(own) for c in zip(*own)]
    return assign(), cs


def agree(frame, rows, k, rounds, dims):
    got = {r.id: r for r in centroids.centroid_clusters(frame, k=k, rounds=rounds, dims=dims).collect()}
    want, cs = brute(rows, k, rounds, dims)
    assert {i: (r.cluster, r.distance) for i, r in got.items()} == want
    total = sum(d for _, d in want.values())
    for r in got.values():
        assert r.centroid == cs[r.cluster] and r.inertia == total
        assert r.cluster_inertia == sum(d for c, d in want.values() if c == r.cluster)


def test_against_brute_force_whole_table(spark):
    emb = read_table(spark, SF01, "embeddings")
    rows = {r.vec_id: list(r.embedding) for r in emb.collect()}
    agree(emb, rows, 16, 3, 64)


def test_odd_vectors(spark):
    r = random.Random(2)
    rows = {i: [r.choice([-1.5, -.1, 0.0, .1, 2.25]) for _ in range(4)] for i in range(60)}
    rows |= {i: [7.0, 7.0, 7.0, 7.0] for i in range(100, 130)}  # repeated vectors
    rows |= {200: None, 201: [], 202: [1.0] * 3, 203: [1.0] * 5, 204: [1.0, None, 1.0, 1.0], 205: [1.0, float("nan"), 1.0, 1.0], 206: [float("inf")] * 4, 207: [-0.0] * 4, -9: [.5] * 4}
    data = [(i, v, "x") for i, v in rows.items()] + [(None, [1.0] * 4, "y"), (0, [99.0] * 4, "z")]  # a null id; an id twice, the larger vector goes
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>, cluster string").repartition(5)
    agree(frame, rows, 7, 3, 4)
    agree(frame.limit(0), {}, 7, 3, 4)
    few = {1: [1.0, 2.0, 3.0, 4.0], 2: [1.0, 2.0, 3.0, 4.0], 3: None}  # fewer vectors than centroids; equal centroids
    agree(spark.createDataFrame(list(few.items()), "vec_id long, embedding array<float>"), few, 7, 3, 4)
    huge = spark.createDataFrame([(1, [1e30] * 4), (2, [1.0] * 4)], "vec_id long, embedding array<double>")
    assert [x.id for x in centroids.centroid_clusters(huge, dims=4).collect()] == [2]


def test_search_rejects_and_is_exact():
    rng = np.random.default_rng(0)
    for spread, dims, k in ((1, 3, 9), (40, 16, 50), (5, 64, 16)):
        c = (rng.normal(size=(k, dims)) * 20 * spread + rng.normal(size=(k, 1)) * 60).astype(np.int64)
        c[1] = c[0]
        x = np.concatenate([c[rng.integers(k, size=400)] + rng.integers(-3, 4, size=(400, dims)), c])
        who, best, compared = centroids.Search(c).nearest(x)
        exact = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        assert (who == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all()
        assert compared < exact.size / 2
