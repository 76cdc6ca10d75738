"""Topological signatures of point groups at a scale ε.

Semantics (documented deviation): the reference builds a Rips complex with
no edge limit, so its infinite bars are always {0: 1}.  Here a group's
signature is taken on the ε-neighbourhood graph of its points under true
Euclidean distance:
  * beta0(ε)  = connected components of the ε-graph,
  * beta1(ε)  = cycle rank of the ε-graph (E - V + beta0), an upper bound on
                the Rips beta1,
  * H0 diagram = one bar (0, w) per minimum-spanning-forest edge w <= ε, and
                 beta0 bars alive past ε reported with death ``inf_death``
                 (1.0, as the reference replaces infinity).

ε-edges are found by pair tasks: a group of more than ``block_rows`` points is
cut into blocks by its distances to pivots (``operators.near_blocks``), and
only blocks that the triangle inequality leaves open for each other meet in a
task, which emits only the pairs within ε.  No task sees more than about
2 * block_rows points.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import rips
from tessera.operators.graphalgo import connected_components, spanning_forest
from tessera.operators.near_blocks import blocked, in_triples
from tessera.session import checked_broadcast, cut_lineage

BLOCK_ROWS = 2048
#: rows of the blocks that meet by threes, and blocks that ``eps_links`` cuts a large group into
TRIPLE_ROWS, LINK_BLOCKS = 8192, 32
EDGE_SCHEMA = "grp bigint, u bigint, v bigint, w double, cnt bigint"

# Beta-1 limits per domain (default 1 for others).
BETTI_LIMITS = (("cv", 1), ("nlp", 2), ("rl", 5), ("tabular", 0))
DEFAULT_BETTI_LIMIT = 1


def _local_forest(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Indices of a minimum spanning forest of one task's edges (Kruskal, early exit).

    By the cycle property an edge outside a subgraph's spanning forest is the
    heaviest edge of some cycle, so it is in no global minimum spanning
    forest either; tasks own disjoint edge sets, so keeping only local
    forests preserves the global forest's weights exactly.
    """
    ids, inv = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = inv[: len(u)], inv[len(u):]
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    keep, need = [], len(ids) - 1
    for i in np.lexsort((v, u, w)):
        ra, rb = find(int(a[i])), find(int(b[i]))
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            keep.append(i)
            if len(keep) == need:
                break
    return np.asarray(keep, dtype=np.int64)


def _pairs_within(eps: float, forest_only: bool = False):
    def fn(key, pdf):
        grp, bi, bj = int(key[0]), int(key[1]), int(key[2])
        a = pdf[pdf["blk"] == bi]
        b = pdf[pdf["blk"] == bj]
        cols = {"grp": "int64", "u": "int64", "v": "int64", "w": "float64", "cnt": "int64"}
        empty = pd.DataFrame({c: pd.Series([], dtype=t) for c, t in cols.items()})
        if a.empty or b.empty:
            return empty
        A = np.stack(a["vec"].to_numpy()).astype(np.float64)
        B = np.stack(b["vec"].to_numpy()).astype(np.float64)
        ia, ib = a["id"].to_numpy(np.int64), b["id"].to_numpy(np.int64)
        approx = (A * A).sum(1)[:, None] + (B * B).sum(1)[None, :] - 2.0 * (A @ B.T)
        slack = 1e-9 * (1.0 + np.abs(approx).max(initial=0.0))
        ii, jj = np.nonzero(approx <= eps * eps + slack)
        if bi == bj:
            keep = ia[ii] < ib[jj]
            ii, jj = ii[keep], jj[keep]
        if len(ii) == 0:
            return empty
        diff = A[ii] - B[jj]
        d = np.sqrt(np.einsum("ij,ij->i", diff, diff))
        keep = d <= eps
        x, y, d = ia[ii][keep], ib[jj][keep], d[keep]
        u, v = np.minimum(x, y), np.maximum(x, y)
        n_edges = len(u)
        cnt = np.zeros(n_edges, dtype=np.int64)
        if forest_only and n_edges:
            sel = _local_forest(u, v, d)
            u, v, d, cnt = u[sel], v[sel], d[sel], cnt[sel]
            # one extra row carries this task's edge count
            u, v = np.append(u, -1), np.append(v, -1)
            d, cnt = np.append(d, 0.0), np.append(cnt, n_edges)
        return pd.DataFrame({"grp": np.full(len(u), grp, dtype=np.int64), "u": u, "v": v, "w": d, "cnt": cnt})
    return fn


def _points(points: DataFrame, group_col: str, id_col: str, vec_col: str) -> DataFrame:
    return points.select(F.col(group_col).cast("bigint").alias("grp"), F.col(id_col).cast("bigint").alias("id"),
                         F.col(vec_col).cast("array<double>").alias("vec"))


def eps_edges(points: DataFrame, eps: float, group_col: str = "grp", id_col: str = "id", vec_col: str = "vec",
              block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(grp, u, v, w): pairs u < v of the same group at Euclidean distance <= eps."""
    points = points.filter(F.col(vec_col).isNotNull())       # a point without coordinates has no distances
    rep, _ = blocked(_points(points, group_col, id_col, vec_col), eps, block_rows)
    return rep.groupBy("grp", "bi", "bj").applyInPandas(_pairs_within(eps), EDGE_SCHEMA).drop("cnt")


def _near(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """Which rows of ``a`` and ``b`` are within eps; distances that rounding could turn are taken exactly."""
    centre = b.mean(axis=0)
    x, y = a - centre, b - centre
    sx, sy = (x * x).sum(1), (y * y).sum(1)
    rough = sx[:, None] + sy[None, :] - 2.0 * (x @ y.T)
    far = np.sqrt(max(sx.max(initial=0.0), sy.max(initial=0.0)))
    slack = 1e-9 * (1.0 + far * far) + 1e-14 * far * a.shape[1] * np.abs(centre).max(initial=0.0)
    near = rough <= eps * eps - slack
    i, j = np.nonzero((rough <= eps * eps + slack) & ~near)
    for k in range(0, len(i), 1 << 15):
        p, q = i[k:k + (1 << 15)], j[k:k + (1 << 15)]
        d = a[p] - b[q]
        near[p, q] = np.sqrt(np.einsum("ij,ij->i", d, d)) <= eps
    return near


def _links_within(eps: float):
    """Pair task of ``eps_links``: for each point with a link in the task, how many it has there and
    the smallest id that it reaches there.  It holds the pairs of a few rows at a time."""
    def fn(key, pdf):
        bi, bj = int(key[1]), int(key[2])
        pdf = pdf.sort_values("id", kind="stable")
        X, ids, blk = np.stack(pdf["vec"].to_numpy()).astype(np.float64), pdf["id"].to_numpy(np.int64), pdf["blk"].to_numpy(np.int64)
        at = np.arange(len(ids))
        left, right = at[blk == bi], at[blk == bj]
        to = X[right]
        links, root = np.zeros(len(ids), np.int64), at.copy()
        step = max(16, (1 << 21) // max(1, len(right)))
        for start in range(0, len(left) if len(right) else 0, step):
            rows = left[start:start + step]
            i, j = np.nonzero(_near(X[rows], to, eps))
            i, j = rows[i], right[j]
            if bi == bj:
                i, j = i[i < j], j[i < j]
            links += np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
            while (root[i] != root[j]).any():
                np.minimum.at(root, np.maximum(root[i], root[j]), np.minimum(root[i], root[j]))
                while (root[root] != root).any():
                    root = root[root]
        on = links > 0
        return pd.DataFrame({"grp": np.full(on.sum(), int(key[0])), "u": ids[on], "v": ids[root[on]], "cnt": links[on]})
    return fn


def eps_links(points: DataFrame, eps: float, group_col: str = "grp", id_col: str = "id", vec_col: str = "vec",
              block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(grp, id, n_links, component_id): for every point with a group and an id, how many points of its
    group lie within eps, and the smallest id that it reaches by such links (its own included).

    A task emits a row a point, never the pairs; ids are unique within a group.  Points without
    distances (see ``near_blocks``) have no links.
    """
    pts = _points(points, group_col, id_col, vec_col).filter("grp is not null and id is not null")
    copies, _ = blocked(pts.filter("vec is not null"), eps, block_rows, LINK_BLOCKS)
    stars = cut_lineage(copies.groupBy("grp", "bi", "bj").applyInPandas(_links_within(eps), "grp bigint, u bigint, v bigint, cnt bigint"))
    links = stars.groupBy("grp", F.col("u").alias("id")).agg(F.sum("cnt").alias("n_links"))
    of = lambda c: F.struct("grp", F.col(c).alias("id"))
    comps = connected_components(links.select(of("id").alias("id")), stars.filter("u != v").select(of("u").alias("src"), of("v").alias("dst")))
    found = comps.select(F.col("id.grp").alias("grp"), F.col("id.id").alias("id"), F.col("comp.id").alias("component_id")).join(links, ["grp", "id"])
    return pts.select("grp", "id").join(found, ["grp", "id"], "left").select(
        "grp", "id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))


def h0_diagram(points: DataFrame, eps: float, group_col: str = "grp", id_col: str = "id", vec_col: str = "vec",
               inf_death: float = 1.0, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(bars, signature).

    bars: (grp, dim=0, birth, death, infinite, multiplicity) — finite bars are spanning-forest edge
    lengths; the beta0 surviving components get ``inf_death``.
    signature: (grp, n_points, n_edges, beta0, beta1).

    Block tasks emit only their local spanning forests (plus an edge count);
    a group held by one block is then final, and only groups cut into
    several blocks go through the distributed Borůvka rounds.
    """
    points = points.filter(F.col(vec_col).isNotNull())       # a point without coordinates has no distances
    rep, sizes = blocked(_points(points, group_col, id_col, vec_col), eps, block_rows)
    pruned = rep.groupBy("grp", "bi", "bj").applyInPandas(_pairs_within(eps, forest_only=True), EDGE_SCHEMA)
    pruned = cut_lineage(pruned)
    n_edges = pruned.groupBy("grp").agg(F.sum("cnt").alias("n_edges"))
    local = pruned.filter(F.col("u") >= 0).select("grp", "u", "v", "w")
    multi = sizes.filter(F.col("nb") > 1).select("grp")
    if multi.limit(1).count() == 0:
        forest = local
    else:
        single = local.join(sizes.filter(F.col("nb") == 1).select("grp"), "grp")
        m_edges = local.join(multi, "grp")
        m_verts = points.select(F.col(group_col).cast("bigint").alias("grp"), F.col(id_col).cast("bigint").alias("id")) \
                        .join(multi, "grp").select("id")
        grp_of = points.select(F.col(id_col).cast("bigint").alias("u"), F.col(group_col).cast("bigint").alias("grp"))
        m_forest = spanning_forest(m_verts, m_edges.select("u", "v", "w")).join(grp_of, "u")
        forest = single.unionByName(m_forest.select("grp", "u", "v", "w"))
    finite = forest.select("grp", F.lit(0).alias("dim"), F.lit(0.0).alias("birth"),
                           F.col("w").alias("death"), F.lit(False).alias("infinite"),
                           F.lit(1).cast("bigint").alias("multiplicity"))
    n_forest = finite.groupBy("grp").agg(F.count(F.lit(1)).alias("n_forest"))
    sig = (sizes.select("grp", F.col("n").alias("n_points")).join(n_edges, "grp", "left").join(n_forest, "grp", "left")
           .select("grp", "n_points", F.coalesce("n_edges", F.lit(0)).alias("n_edges"),
                   (F.col("n_points") - F.coalesce("n_forest", F.lit(0))).alias("beta0")))
    sig = sig.withColumn("beta1", F.col("n_edges") - F.col("n_points") + F.col("beta0"))
    # Surviving components as one row with a multiplicity (never an array of beta0 items).
    inf_bars = sig.filter(F.col("beta0") > 0).select(
        "grp", F.lit(0).alias("dim"), F.lit(0.0).alias("birth"), F.lit(float(inf_death)).alias("death"),
        F.lit(True).alias("infinite"), F.col("beta0").cast("bigint").alias("multiplicity"))
    return finite.unionByName(inf_bars), sig


def rips_signature(points: DataFrame, eps: float, group_col: str = "grp", id_col: str = "id", vec_col: str = "vec",
                   block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(grp, n_points, beta0, beta1) of the Rips complex at ε: beta1 counts its holes over Z2
    (``operators.rips``), where ``h0_diagram`` reports the graph's cycle rank."""
    pts = _points(points, group_col, id_col, vec_col)
    single = cut_lineage(rips.distinct_points(pts))
    edges = cut_lineage(eps_edges(single, eps, block_rows=block_rows))
    holes = rips.betti1(edges)
    sizes = pts.filter("grp is not null and id is not null and vec is not null").groupBy("grp").agg(F.count("*").alias("n_points"))
    of = lambda c: F.struct("grp", F.col(c).alias("id"))
    links = cut_lineage(rips.forest(edges.filter("grp is not null")))
    comps = connected_components(single.select(of("id").alias("id")), links.select(of("u").alias("src"), of("v").alias("dst")))
    parts = comps.groupBy(F.col("id.grp").alias("grp")).agg(F.count_if(F.col("id") == F.col("comp")).alias("beta0"))
    return sizes.join(parts, "grp").join(holes, "grp", "left").select("grp", "n_points", "beta0", F.coalesce("beta1", F.lit(0)).alias("beta1"))


def triangle_counts(edges: DataFrame) -> DataFrame:
    """(grp, n_triangles) of the ε-graphs: 2-simplices of the flag complex at ε.

    Degree-ordered orientation (edge from lower (degree, id) to higher) bounds
    every vertex's out-degree by sqrt(2E), so the wedge join is O(E^1.5) even
    around hub vertices; each triangle is found exactly once.
    """
    e = edges.select("grp", "u", "v")
    deg = (e.select("grp", F.col("u").alias("id")).unionByName(e.select("grp", F.col("v").alias("id")))
           .groupBy("grp", "id").agg(F.count(F.lit(1)).alias("d")))
    du = deg.select("grp", F.col("id").alias("u"), F.col("d").alias("du"))
    dv = deg.select("grp", F.col("id").alias("v"), F.col("d").alias("dv"))
    j = e.join(du, ["grp", "u"]).join(dv, ["grp", "v"])
    u_first = (F.col("du") < F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") < F.col("v")))
    o = j.select("grp", F.when(u_first, F.col("u")).otherwise(F.col("v")).alias("s"),
                 F.when(u_first, F.col("v")).otherwise(F.col("u")).alias("t"))
    a = o.select("grp", "s", F.col("t").alias("x"))
    b = o.select("grp", "s", F.col("t").alias("y"))
    wedges = a.join(b, ["grp", "s"]).filter(F.col("x") < F.col("y")).select(
        "grp", F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))
    closed = wedges.join(e, ["grp", "u", "v"], "left_semi")
    return closed.groupBy("grp").agg(F.count(F.lit(1)).alias("n_triangles"))


def _near_bits(a: np.ndarray, b: np.ndarray, eps: float, later: bool) -> np.ndarray:
    """A row of bits (64 a word) for each row of ``a``: the rows of ``b`` within eps; ``later``: only those after it."""
    out = np.zeros((len(a), -(-len(b) // 64) * 8), np.uint8)
    for start in range(0, len(a), 256):
        near = _near(a[start:start + 256], b, eps)
        bits = np.packbits(np.triu(near, start + 1) if later else near, axis=1)
        out[start:start + 256, :bits.shape[1]] = bits
    return out.view(np.uint64)


def _simplices(eps: float):
    """Task of a triple of blocks: its triangles with one corner in each (corners of one block in its
    order), and its pair's edges where the last two blocks are one."""
    def fn(key, pdf):
        grp, bi, bj, bk = (int(k) for k in key)
        own = {b: pdf[pdf["blk"] == b].sort_values("id", kind="stable")["vec"].to_list() for b in {bi, bj, bk}}
        if not all(own.values()):
            return pd.DataFrame({"grp": [grp], "n_edges": [0], "n_triangles": [0]})
        x, y, z = (np.array(own[b], dtype=np.float64) for b in (bi, bj, bk))
        to_z, from_y = _near_bits(x, z, eps, False), _near_bits(y, z, eps, bj == bk)
        n_edges = n_triangles = 0
        for start in range(0, len(x), 256):
            near = _near(x[start:start + 256], y, eps)
            i, j = np.nonzero(np.triu(near, start + 1) if bi == bj else near)
            n_edges += len(i)
            for k in range(0, len(i), 8192):
                both = to_z[start + i[k:k + 8192]]
                both &= from_y[j[k:k + 8192]]
                n_triangles += int(np.bitwise_count(both).sum(dtype=np.int64))
        return pd.DataFrame({"grp": [grp], "n_edges": [n_edges if bj == bk else 0], "n_triangles": [n_triangles]})
    return fn


def euler_counts(points: DataFrame, eps: float, group_col: str = "grp", id_col: str = "id", vec_col: str = "vec",
                 block_rows: int = TRIPLE_ROWS) -> DataFrame:
    """(grp, n_points, n_edges, n_triangles, euler) of the 2-skeleton at ε.

    Blocks meet by threes and a task gives two numbers, so neither edges nor open wedges are ever
    shuffled: a triangle is a bit that two ends of an edge have in common.  Groups in which an id
    comes again have repeated edges; they are counted from the edges (``triangle_counts``).
    """
    points = points.filter(F.col(vec_col).isNotNull())
    pts = _points(points, group_col, id_col, vec_col)
    repeated = cut_lineage(pts.filter("id is not null").groupBy("grp", "id").count().filter("count > 1").select("grp").distinct())
    once = in_triples(pts.join(repeated, "grp", "left_anti"), eps, block_rows)
    tasks = once.groupBy("grp", "bi", "bj", "bk").applyInPandas(_simplices(eps), "grp bigint, n_edges bigint, n_triangles bigint")
    found = cut_lineage(tasks.groupBy("grp").agg(F.sum("n_edges").alias("n_edges"), F.sum("n_triangles").alias("n_triangles")))
    if not repeated.isEmpty():
        edges = cut_lineage(eps_edges(pts.join(repeated, "grp", "left_semi"), eps, block_rows=min(block_rows, BLOCK_ROWS)))
        found = found.unionByName(edges.groupBy("grp").agg(F.count(F.lit(1)).alias("n_edges")).join(triangle_counts(edges), "grp", "left"))
    n_pts = pts.groupBy("grp").agg(F.count(F.lit(1)).alias("n_points"))
    out = n_pts.join(found, "grp", "left").select("grp", "n_points", F.coalesce("n_edges", F.lit(0)).alias("n_edges"),
                                                  F.coalesce("n_triangles", F.lit(0)).alias("n_triangles"))
    return out.withColumn("euler", F.col("n_points") - F.col("n_edges") + F.col("n_triangles"))


# ------------------------------------------------------------ distances

def _w2_h0(a: np.ndarray, b: np.ndarray, p: float) -> float:
    """p-Wasserstein between two diagrams of (birth, death) points, internal L_p.

    Exact O(n m) dynamic programme for bars sharing one birth (all of H0):
    on a line an optimal matching is non-crossing, a matched pair costs
    |d1 - d2|^p and a point sent to the diagonal costs ((d - b) 2^(1/p - 1))^p
    (its L_p distance to the nearest diagonal point).  Diagonal padding points
    cost nothing and never improve a match, so they are not materialised.
    """
    a = np.sort(a[:, 1] - a[:, 0])
    b = np.sort(b[:, 1] - b[:, 0])
    n, m = len(a), len(b)
    to_diag = 2.0 ** (1.0 / p - 1.0)
    ca, cb = (a * to_diag) ** p, (b * to_diag) ** p
    # Row recurrence cur[j] = min(best[j-1], cur[j-1] + cb[j-1]) is a min-plus
    # prefix scan: with S the prefix sums of cb and g = (cur[0], best),
    # cur = S + running_min(g - S), one vectorised pass per row.
    S = np.concatenate([[0.0], np.cumsum(cb)])
    prev = S.copy()
    for i in range(n):
        best = np.minimum(prev[:-1] + np.abs(a[i] - b) ** p, prev[1:] + ca[i])
        g = np.concatenate([[prev[0] + ca[i]], best])
        prev = S + np.minimum.accumulate(g - S)
    return float(max(prev[m], 0.0) ** (1.0 / p))


def wasserstein_pairs(bars: DataFrame, pairs: DataFrame, p: float = 2.0) -> DataFrame:
    """T3 over a table of diagram pairs (pair_id, left, right) -> (pair_id, distance).

    Both diagrams of a pair meet in one task (diagrams are per group and
    bounded by the group's forest size).
    """
    left = pairs.select("pair_id", F.col("left").alias("grp"), F.lit(0).alias("side"))
    right = pairs.select("pair_id", F.col("right").alias("grp"), F.lit(1).alias("side"))
    sided = left.unionByName(right).join(bars.select("grp", "birth", "death", "multiplicity"), "grp")

    def fn(key, pdf):
        def side(s):
            part = pdf[pdf["side"] == s]
            pts = part[["birth", "death"]].to_numpy(np.float64)
            return np.repeat(pts, part["multiplicity"].to_numpy(np.int64), axis=0)
        a, b = side(0), side(1)
        return pd.DataFrame({"pair_id": [int(key[0])], "distance": [_w2_h0(a.reshape(-1, 2), b.reshape(-1, 2), p)]})
    dist = sided.groupBy("pair_id").applyInPandas(fn, "pair_id bigint, distance double")
    return pairs.select("pair_id").join(dist, "pair_id", "left").fillna(0.0, ["distance"])


def drift_gate(signatures: DataFrame, domains: DataFrame, distances: DataFrame | None = None,
               threshold: float = 0.1) -> DataFrame:
    """Per group: betti_too_high if beta1 > domain limit, else topology_mismatch
    if a stored domain signature is farther than ``threshold``, else safe."""
    spark = signatures.sparkSession
    limits = spark.createDataFrame(list(BETTI_LIMITS), "domain string, max_beta1 int")
    s = signatures.join(domains.select("grp", "domain"), "grp").join(F.broadcast(limits), "domain", "left")
    s = s.withColumn("max_beta1", F.coalesce("max_beta1", F.lit(DEFAULT_BETTI_LIMIT)))
    if distances is not None:
        s = s.join(distances.select("grp", "distance"), "grp", "left")
    else:
        s = s.withColumn("distance", F.lit(None).cast("double"))
    reason = (F.when(F.col("beta1") > F.col("max_beta1"), "betti_too_high")
              .when(F.col("distance").isNotNull() & (F.col("distance") > threshold), "topology_mismatch")
              .otherwise("safe"))
    return s.withColumn("reason", reason).withColumn("is_safe", F.col("reason") == "safe")


def curriculum(signatures: DataFrame, cuts=(0, 2, 5)) -> DataFrame:
    """Stage 1-4 by beta1 (<= 0, <= 2, <= 5, above)."""
    stage = (F.when(F.col("beta1") <= cuts[0], 1).when(F.col("beta1") <= cuts[1], 2)
             .when(F.col("beta1") <= cuts[2], 3).otherwise(4))
    return signatures.withColumn("stage", stage)


def betti_group_count(n: int, block_rows: int = BLOCK_ROWS) -> int:
    return max(1, math.ceil(n / block_rows))
