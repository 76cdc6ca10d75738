"""Topology queries over `embeddings`: one point group per label, scale ε."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import topology
from tessera.plans.catalog import r6, register
from tessera.session import read_table

EPS = 1.25
# Links over the whole table: few lie this near.
NEAR_EPS, NEAR_BLOCK_ROWS = 1.1, 1024
# Test mapping of labels to domains (ranges of the label value).
DOMAIN_SQL = "CASE WHEN label < 3 THEN 'cv' WHEN label < 5 THEN 'nlp' WHEN label < 8 THEN 'rl' ELSE 'tabular' END"

EDGES_SQL = f"""pts AS (SELECT vec_id AS id, label::BIGINT AS grp, embedding::DOUBLE[] AS e FROM embeddings),
edges AS (SELECT a.grp, a.id AS u, b.id AS v, list_distance(a.e, b.e) AS w
          FROM pts a JOIN pts b ON a.grp = b.grp AND a.id < b.id WHERE list_distance(a.e, b.e) <= {EPS})"""

SIG_SQL = f"""{EDGES_SQL},
und AS (SELECT u AS a, v AS b FROM edges UNION ALL SELECT v, u FROM edges),
reach(src, dst) AS (SELECT id, id FROM pts UNION SELECT r.src, und.b FROM reach r JOIN und ON r.dst = und.a),
comp AS (SELECT src AS id, min(dst) AS comp FROM reach GROUP BY src),
sig AS (SELECT p.grp, count(*) AS n_points, count(DISTINCT c.comp) AS beta0,
               coalesce((SELECT count(*) FROM edges e WHERE e.grp = p.grp), 0) AS n_edges
        FROM pts p JOIN comp c USING (id) GROUP BY p.grp)"""


def _points(spark, sf_dir):
    emb = read_table(spark, sf_dir, "embeddings")
    return emb.select(F.col("label").cast("bigint").alias("grp"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


@register("eps_edges", f"WITH {EDGES_SQL} SELECT grp, u, v, round(w, 6) AS w FROM edges")
def q_eps_edges(spark, sf_dir):
    """J7 re-aimed: pairs within ε per group (never all pairs)."""
    e = topology.eps_edges(_points(spark, sf_dir), EPS)
    return e.select("grp", "u", "v", r6("w").alias("w"))


@register("near_links", f"""
WITH RECURSIVE e AS (SELECT a.vec_id AS u, b.vec_id AS v FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
                     WHERE list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) <= {NEAR_EPS}),
reach(src, dst) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.src, e.v FROM reach r JOIN e ON r.dst = e.u),
deg AS (SELECT u, count(*) AS n FROM e GROUP BY u)
SELECT src AS vec_id, coalesce(any_value(deg.n), 0) AS n_links, min(dst) AS component_id
FROM reach LEFT JOIN deg ON deg.u = src GROUP BY src""")
def q_near_links(spark, sf_dir):
    """Links within ε whatever the label; the whole table is one group of blocks."""
    points = _points(spark, sf_dir).withColumn("grp", F.lit(0).cast("bigint"))
    found = topology.eps_links(points, NEAR_EPS, block_rows=NEAR_BLOCK_ROWS)
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id")


@register("betti_at_scale", f"""
WITH RECURSIVE {SIG_SQL}
SELECT grp, n_points, n_edges, beta0, n_edges - n_points + beta0 AS beta1 FROM sig""")
def q_betti_at_scale(spark, sf_dir):
    """beta0 / beta1 (cycle rank) of each group's ε-graph, with V and E."""
    _, sig = topology.h0_diagram(_points(spark, sf_dir), EPS)
    return sig.select("grp", "n_points", "n_edges", "beta0", "beta1")


@register("curriculum", f"""
WITH RECURSIVE {SIG_SQL}
SELECT grp, n_edges - n_points + beta0 AS beta1,
       CASE WHEN n_edges - n_points + beta0 <= 0 THEN 1 WHEN n_edges - n_points + beta0 <= 2 THEN 2
            WHEN n_edges - n_points + beta0 <= 5 THEN 3 ELSE 4 END AS stage
FROM sig""")
def q_curriculum(spark, sf_dir):
    """Curriculum stage of each group by its beta1."""
    _, sig = topology.h0_diagram(_points(spark, sf_dir), EPS)
    return topology.curriculum(sig).select("grp", "beta1", "stage")


@register("h0_diagram")
def q_h0_diagram(spark, sf_dir):
    """H0 bars per group (spanning-forest deaths, surviving components at 1.0)."""
    bars, _ = topology.h0_diagram(_points(spark, sf_dir), EPS)
    return bars.select("grp", "dim", "birth", r6("death").alias("death"), "infinite", "multiplicity")


def _domain_pairs(spark, sf_dir):
    """Each group against its domain's reference group (the domain's smallest label)."""
    emb = read_table(spark, sf_dir, "embeddings")
    dom = emb.select(F.col("label").cast("bigint").alias("grp"), F.expr(DOMAIN_SQL).alias("domain")).distinct()
    ref = dom.groupBy("domain").agg(F.min("grp").alias("ref"))
    pairs = dom.join(ref, "domain").select(F.col("grp").alias("pair_id"), F.col("grp").alias("left"),
                                           F.col("ref").alias("right"), "domain")
    return dom, pairs


@register("diagram_distance")
def q_diagram_distance(spark, sf_dir):
    """2-Wasserstein distance of each group's H0 diagram to its domain reference."""
    bars, _ = topology.h0_diagram(_points(spark, sf_dir), EPS)
    _, pairs = _domain_pairs(spark, sf_dir)
    d = topology.wasserstein_pairs(bars, pairs.select("pair_id", "left", "right"))
    return d.select(F.col("pair_id").alias("grp"), r6("distance").alias("distance"),
                    (F.col("distance") < 0.1).alias("similar"))


@register("drift_gate")
def q_drift_gate(spark, sf_dir):
    """Gate verdict per group (betti_too_high / topology_mismatch / safe)."""
    bars, sig = topology.h0_diagram(_points(spark, sf_dir), EPS)
    dom, pairs = _domain_pairs(spark, sf_dir)
    d = topology.wasserstein_pairs(bars, pairs.select("pair_id", "left", "right"))
    g = topology.drift_gate(sig, dom, d.select(F.col("pair_id").alias("grp"), "distance"), threshold=0.1)
    return g.select("grp", "domain", "beta1", "max_beta1", r6("distance").alias("distance"), "reason", "is_safe")


@register("euler_counts", f"""
WITH {EDGES_SQL},
tri AS (SELECT a.grp, count(*) AS n_triangles FROM edges a JOIN edges b ON a.grp = b.grp AND a.u = b.u AND a.v < b.v
        JOIN edges c ON c.grp = a.grp AND c.u = a.v AND c.v = b.v GROUP BY a.grp),
np AS (SELECT grp, count(*) AS n_points FROM pts GROUP BY grp),
ne AS (SELECT grp, count(*) AS n_edges FROM edges GROUP BY grp)
SELECT np.grp, n_points, coalesce(n_edges, 0) AS n_edges, coalesce(n_triangles, 0) AS n_triangles,
       n_points - coalesce(n_edges, 0) + coalesce(n_triangles, 0) AS euler
FROM np LEFT JOIN ne USING (grp) LEFT JOIN tri USING (grp)""")
def q_euler_counts(spark, sf_dir):
    """V, E, triangles and Euler characteristic of each group's 2-skeleton at ε."""
    return topology.euler_counts(_points(spark, sf_dir), EPS)


@register("rips_betti")
def q_rips_betti(spark, sf_dir):
    """Components and holes of each group's Rips complex at ε (rank over Z2 after collapses)."""
    return topology.rips_signature(_points(spark, sf_dir), EPS)
