import numpy as np
from pyspark.sql import functions as F

from tessera.operators import topology
from tessera.operators.graphalgo import connected_components, spanning_forest


def pts(spark, rows):
    return spark.createDataFrame(rows, "grp bigint, id bigint, vec array<double>")


def test_line_points_h0(spark):
    p = pts(spark, [(0, 1, [0.0]), (0, 2, [1.0]), (0, 3, [3.0])])
    bars, sig = topology.h0_diagram(p, eps=10.0)
    deaths = sorted(r["death"] for r in bars.filter(~F.col("infinite")).collect())
    assert deaths == [1.0, 2.0]
    s = sig.collect()[0]
    assert s["beta0"] == 1 and s["beta1"] == 1    # 3 edges, 3 points: one graph cycle
    _, sig15 = topology.h0_diagram(p, eps=1.5)
    assert sig15.collect()[0]["beta0"] == 2


def test_eps_edges_blocked_equals_brute(spark):
    rng = np.random.default_rng(5)
    X = rng.normal(size=(150, 3))
    rows = [(i % 2, i, X[i].tolist()) for i in range(150)]
    e = topology.eps_edges(pts(spark, rows), 1.0, block_rows=16).collect()
    got = {(r["u"], r["v"]) for r in e}
    expect = {(i, j) for i in range(150) for j in range(i + 1, 150)
              if i % 2 == j % 2 and np.linalg.norm(X[i] - X[j]) <= 1.0}
    assert got == expect


def test_spanning_forest_weight_equals_kruskal(spark):
    rng = np.random.default_rng(11)
    X = rng.normal(size=(40, 2))
    edges = [(i, j, float(np.linalg.norm(X[i] - X[j]))) for i in range(40) for j in range(i + 1, 40)
             if np.linalg.norm(X[i] - X[j]) < 0.9]
    parent = list(range(40))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a
    total = 0.0
    for u, v, w in sorted(edges, key=lambda t: (t[2], t[0], t[1])):
        ru, rv = find(u), find(v)
        if ru != rv:
            parent[ru] = rv
            total += w
    verts = spark.createDataFrame([(i,) for i in range(40)], "id bigint")
    e = spark.createDataFrame(edges, "u bigint, v bigint, w double")
    forest = spanning_forest(verts, e).collect()
    assert abs(sum(r["w"] for r in forest) - total) < 1e-9
    comps = connected_components(verts, e.select(F.col("u").alias("src"), F.col("v").alias("dst")))
    assert comps.select("comp").distinct().count() == 40 - len(forest)


def test_wasserstein_identity_symmetry(spark):
    a = np.array([[0.0, 1.0], [0.0, 2.0], [0.0, 0.5]])
    b = np.array([[0.0, 1.2], [0.0, 0.1]])
    assert topology._w2_h0(a, a, 2.0) == 0.0
    assert abs(topology._w2_h0(a, b, 2.0) - topology._w2_h0(b, a, 2.0)) < 1e-12
    # one bar vs nothing: distance to the diagonal (d / sqrt 2)
    assert abs(topology._w2_h0(np.array([[0.0, 2.0]]), np.zeros((0, 2)), 2.0) - 2 / np.sqrt(2)) < 1e-12


def test_drift_gate_reasons(spark):
    sig = spark.createDataFrame([(1, 3), (2, 0), (3, 0)], "grp bigint, beta1 bigint")
    dom = spark.createDataFrame([(1, "nlp"), (2, "cv"), (3, "tabular")], "grp bigint, domain string")
    dist = spark.createDataFrame([(2, 0.5), (3, 0.01)], "grp bigint, distance double")
    got = {r["grp"]: r["reason"] for r in topology.drift_gate(sig, dom, dist, 0.1).collect()}
    assert got == {1: "betti_too_high", 2: "topology_mismatch", 3: "safe"}


def test_h0_multi_block_equals_single_block(spark):
    rng = np.random.default_rng(2)
    X = rng.normal(size=(120, 3))
    rows = [(i % 2, i, X[i].tolist()) for i in range(120)]
    p = pts(spark, rows)
    b1, s1 = topology.h0_diagram(p, 1.2)
    b2, s2 = topology.h0_diagram(p, 1.2, block_rows=16)
    d1 = sorted(round(r["death"], 9) for r in b1.filter(~F.col("infinite")).collect())
    d2 = sorted(round(r["death"], 9) for r in b2.filter(~F.col("infinite")).collect())
    assert d1 == d2
    assert sorted(map(tuple, s1.collect())) == sorted(map(tuple, s2.collect()))


def test_triangles_brute_force(spark):
    rng = np.random.default_rng(9)
    X = rng.normal(size=(60, 2))
    rows = [(0, i, X[i].tolist()) for i in range(60)]
    got = topology.euler_counts(pts(spark, rows), 0.8, block_rows=16).collect()[0]
    adj = np.linalg.norm(X[:, None] - X[None], axis=2) <= 0.8
    np.fill_diagonal(adj, False)
    A = adj.astype(np.int64)
    assert got["n_edges"] == A.sum() // 2 and got["n_triangles"] == np.trace(A @ A @ A) // 6


def _w2_brute(a, b, p=2.0):
    """Exhaustive matching on diagonal-padded diagrams (each side gets the other's projections)."""
    import itertools
    la, lb = a[:, 1] - a[:, 0], b[:, 1] - b[:, 0]
    n, m = len(la), len(lb)
    diag = 2.0 ** (1.0 / p - 1.0)
    best = np.inf
    # rows: a points then m diagonal slots; columns: b points then n diagonal slots
    for perm in itertools.permutations(range(m + n)):
        cost = 0.0
        for r, c in enumerate(perm):
            if r < n and c < m:
                cost += abs(la[r] - lb[c]) ** p
            elif r < n:
                cost += (la[r] * diag) ** p
            elif c < m:
                cost += (lb[c] * diag) ** p
        best = min(best, cost)
    return best ** (1.0 / p)


def test_wasserstein_dp_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    for _ in range(40):
        n, m = rng.integers(0, 4), rng.integers(0, 4)
        a = np.column_stack([np.zeros(n), rng.uniform(0, 2, n) ** 2])
        b = np.column_stack([np.zeros(m), rng.uniform(0, 2, m) ** 2])
        for p in (1.0, 2.0):
            assert abs(topology._w2_h0(a, b, p) - _w2_brute(a, b, p)) < 1e-9


def test_connected_components_long_path_converges(spark):
    from tessera.operators.graphalgo import connected_components
    rng = np.random.default_rng(11)
    ids = rng.permutation(200) + 1
    edges = spark.createDataFrame([(int(ids[i]), int(ids[i + 1])) for i in range(199)] + [(1000, 1001)],
                                  "src bigint, dst bigint")
    verts = spark.createDataFrame([(int(i),) for i in ids] + [(1000,), (1001,), (2000,)], "id bigint")
    comp = {r["id"]: r["comp"] for r in connected_components(verts, edges).collect()}
    assert {comp[int(i)] for i in ids} == {1}
    assert comp[1000] == comp[1001] == 1000 and comp[2000] == 2000


def test_size_estimates_stay_small_over_rounds(spark):
    verts = spark.range(64).select("id")
    edges = spark.range(63).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"), F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("w"))
    forest = spanning_forest(verts, edges)
    assert forest.count() == 63
    # a kept estimate is the product of all joins before it: thousands of digits after a few rounds
    assert len(str(forest._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 12


def test_triangles_by_triples_of_blocks(spark, monkeypatch):
    rng = np.random.default_rng(10)
    X = np.concatenate([rng.normal(size=(70, 3)), rng.normal(size=(50, 3)) + 30, np.ones((5, 3))]) + 1e3
    rows = [(i % 2, i, X[i].tolist()) for i in range(len(X))] + [(0, 500, None), (0, None, [0.0] * 3), (1, 501, [float("nan")] * 3)]
    monkeypatch.setattr(topology, "triangle_counts", None)                 # no edge is needed
    for block_rows in (8, 40, 4096):
        got = {r["grp"]: r for r in topology.euler_counts(pts(spark, rows), 1.1, block_rows=block_rows).collect()}
        for g in (0, 1):
            adj = (np.linalg.norm(X[g::2, None] - X[None, g::2], axis=2) <= 1.1).astype(np.int64)
            np.fill_diagonal(adj, 0)
            assert (got[g]["n_edges"], got[g]["n_triangles"]) == (adj.sum() // 2, np.trace(adj @ adj @ adj) // 6)


def test_triangles_of_repeated_ids(spark):
    rows = [(0, 1, [0.0]), (0, 1, [0.0]), (0, 2, [0.5]), (0, 3, [0.7]), (1, 1, [0.0]), (1, 2, [0.1]), (1, 3, [0.2])]
    got = {r["grp"]: (r["n_points"], r["n_edges"], r["n_triangles"]) for r in topology.euler_counts(pts(spark, rows), 1.0).collect()}
    assert got[1] == (3, 3, 1)
    assert got[0][:2] == (4, 5) and got[0][2] == topology.triangle_counts(topology.eps_edges(pts(spark, rows), 1.0)).filter("grp = 0").first()[1]
