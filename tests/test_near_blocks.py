import numpy as np
from pyspark.sql import functions as F

from tessera.operators import near_blocks, topology


def frame(spark, rows):
    return spark.createDataFrame(rows, "grp bigint, id bigint, vec array<double>")


def brute(rows, eps):
    found = set()
    for g in {r[0] for r in rows}:
        own = [(i, np.array(v)) for grp, i, v in rows if grp == g]
        found |= {(g, min(i, j), max(i, j)) for k, (i, x) in enumerate(own) for j, y in own[k + 1:] if np.linalg.norm(x - y) <= eps}
    return found


def clustered(n, clusters, dims, seed, spread=0.2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims)) * 10
    return [(0, i, (centres[i % clusters] + rng.normal(size=dims) * spread).tolist()) for i in range(n)]


def edges(spark, rows, eps, block_rows):
    got = topology.eps_edges(frame(spark, rows), eps, block_rows=block_rows).collect()
    assert len(got) == len({(r["grp"], r["u"], r["v"]) for r in got})      # a pair comes once
    return {(r["grp"], r["u"], r["v"]) for r in got}


def test_clustered_pairs_equal_brute_and_most_blocks_never_meet(spark):
    rows, eps = clustered(600, 12, 6, 3), 0.6
    assert edges(spark, rows, eps, 32) == brute(rows, eps)
    sizes = spark.createDataFrame([(0, 600, 19)], "grp bigint, n bigint, nb int")
    points = near_blocks.placed(frame(spark, rows), sizes, eps, 32)
    blocks = points.select("blk").distinct().count()
    met = near_blocks.block_pairs(points, eps).count()
    assert blocks > 12 and met < 0.35 * blocks * (blocks + 1) / 2
    assert points.groupBy("blk").count().agg(F.max("count")).first()[0] <= 64


def test_spread_out_points_ties_and_zero_eps(spark):
    rng = np.random.default_rng(8)
    rows = [(i % 3 // 2, i, rng.normal(size=2).tolist()) for i in range(300)]
    assert edges(spark, rows, 0.3, 16) == brute(rows, 0.3)
    rows += [(1, 1000 + i, [0.5, 0.5]) for i in range(40)]                  # copies, more than a block
    assert edges(spark, rows, 0.0, 16) == brute(rows, 0.0)
    far = [(g, i, [x + 1e6 for x in v]) for g, i, v in rows]
    assert edges(spark, far, 0.3, 16) == brute(far, 0.3)


def test_points_without_distances(spark):
    rows = clustered(80, 2, 3, 5)
    odd = [(0, 900, None), (0, 901, [float("nan"), 0.0, 0.0]), (0, 902, [None, 0.0, 0.0]), (0, 903, [float("inf"), 0.0, 0.0]),
           (0, None, [0.0, 0.0, 0.0]), (None, 904, [0.0, 0.0, 0.0])]
    assert edges(spark, rows + odd, 0.5, 8) == brute(rows, 0.5)
    assert edges(spark, rows + odd, 0.5, 4096) == brute(rows, 0.5)           # one block
    assert edges(spark, [], 0.5, 8) == set()


def test_a_group_without_pivots_loses_no_pair(spark, monkeypatch):
    monkeypatch.setattr(near_blocks, "LOOKED_AT", 0)
    rows = clustered(60, 2, 3, 9)
    assert edges(spark, rows, 0.5, 8) == brute(rows, 0.5)


def linked(rows, eps):
    """(grp, id) -> (links, smallest id reached), by trying all pairs."""
    comp = {(g, i): i for g, i, _ in rows}
    pairs = brute(rows, eps)
    for _ in rows:
        for g, u, v in pairs:
            comp[g, u] = comp[g, v] = min(comp[g, u], comp[g, v])
    return {(g, i): (sum(g == p[0] and i in p[1:] for p in pairs), comp[g, i]) for g, i, _ in rows}


def links(spark, rows, eps, block_rows):
    got = topology.eps_links(frame(spark, rows), eps, block_rows=block_rows).collect()
    assert len(got) == len({(r["grp"], r["id"]) for r in got})
    return {(r["grp"], r["id"]): (r["n_links"], r["component_id"]) for r in got}


def test_links_and_components_equal_brute(spark):
    rows = clustered(120, 6, 3, 4) + [(1, i, [0.4 * (i * 37 % 60), 0.0, 0.0]) for i in range(60)]   # a chain over many blocks
    assert links(spark, rows, 0.5, 16) == linked(rows, 0.5)
    assert links(spark, rows, 0.5, 4096) == linked(rows, 0.5)


def test_links_of_copies_and_points_without_distances(spark):
    rows = [(0, i, [1.0, 2.0]) for i in range(40)] + [(0, 50, [5.0, 5.0])]
    odd = [(0, 60, None), (0, 61, [float("nan"), 0.0])]
    want = linked(rows, 0.0) | {(0, 60): (0, 60), (0, 61): (0, 61)}
    assert links(spark, rows + odd, 0.0, 8) == want
    assert links(spark, rows + odd, 0.0, 4096) == want
    assert links(spark, [], 0.5, 8) == {}


def test_blocks_grow_with_the_group(spark):
    rng = np.random.default_rng(12)
    rows = [(0, i, rng.normal(size=8).tolist()) for i in range(900)]
    few, _ = near_blocks.blocked(frame(spark, rows), 3.0, 8, 4)            # no pair of blocks is closed
    many, _ = near_blocks.blocked(frame(spark, rows), 3.0, 8)
    assert few.count() < 25 * 900 < many.count()
