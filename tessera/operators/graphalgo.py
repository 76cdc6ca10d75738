"""Iterative graph algorithms on edge DataFrames: connected components and
minimum spanning forest (Borůvka).  Each round is a few joins and one
partial/final aggregate; state is cut with reliable ``checkpoint`` into the
shared checkpoint folder, so a lost executor recomputes one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut_lineage


def connected_components(vertices: DataFrame, edges: DataFrame, id_col: str = "id",
                         src: str = "src", dst: str = "dst", max_rounds: int | None = None) -> DataFrame:
    """(id, comp) with comp = smallest vertex id of the component.

    Min-label propagation with pointer jumping (comp <- comp[comp]) each round;
    runs until no label changes (``max_rounds`` only as an explicit guard,
    which raises rather than return unconverged labels).
    """
    und = cut_lineage(edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
                      .unionByName(edges.select(F.col(dst).alias("a"), F.col(src).alias("b")))
                      .filter(F.col("a") != F.col("b")).distinct())
    labels = cut_lineage(vertices.select(F.col(id_col).alias("id")).distinct().withColumn("comp", F.col("id")))
    rounds = 0
    while True:
        rounds += 1
        if max_rounds is not None and rounds > max_rounds:
            raise RuntimeError(f"connected components did not converge in {max_rounds} rounds")
        msgs = und.join(labels.withColumnRenamed("id", "a"), "a").select(F.col("b").alias("id"), "comp")
        cand = labels.unionByName(msgs).groupBy("id").agg(F.min("comp").alias("comp"))
        hop = cand.select(F.col("id").alias("comp"), F.col("comp").alias("comp2"))
        jumped = cand.join(hop, "comp", "left").select(
            "id", F.least(F.col("comp"), F.coalesce(F.col("comp2"), F.col("comp"))).alias("comp"))
        jumped = cut_lineage(jumped)
        changed = (jumped.join(labels.withColumnRenamed("comp", "old"), "id")
                   .filter(F.col("comp") != F.col("old")).limit(1).count())
        labels = jumped
        if changed == 0:
            break
    return labels


def spanning_forest(vertices: DataFrame, edges: DataFrame, id_col: str = "id", u: str = "u", v: str = "v",
                    w: str = "w") -> DataFrame:
    """Minimum spanning forest edges (u, v, w) by Borůvka rounds.

    Edges are totally ordered by (w, min id, max id), so the cheapest outgoing
    edges of all components never close a cycle.  Every round at least halves
    the number of components that still have an outgoing edge, so the loop
    ends after at most log2(n) rounds; it runs until no edge crosses.
    """
    e = cut_lineage(edges.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v"), F.col(w).cast("double").alias("w"))
                    .filter(F.col("u") != F.col("v")))
    labels = cut_lineage(vertices.select(F.col(id_col).alias("id")).distinct().withColumn("comp", F.col("id")))
    forest = None
    while True:
        lu = labels.select(F.col("id").alias("u"), F.col("comp").alias("cu"))
        lv = labels.select(F.col("id").alias("v"), F.col("comp").alias("cv"))
        cross = e.join(lu, "u").join(lv, "v").filter(F.col("cu") != F.col("cv"))
        cross = cut_lineage(cross)
        if cross.isEmpty():
            break
        key = F.struct("w", "u", "v")
        cand = (cross.select(F.col("cu").alias("c"), key.alias("k"), F.col("cv").alias("other"))
                .unionByName(cross.select(F.col("cv").alias("c"), key.alias("k"), F.col("cu").alias("other"))))
        best = cut_lineage(cand.groupBy("c").agg(F.min(F.struct("k", "other")).alias("b"))
                           .select("c", F.col("b.k.w").alias("w"), F.col("b.k.u").alias("u"),
                                   F.col("b.k.v").alias("v"), F.col("b.other").alias("other")))
        chosen = best.select("u", "v", "w").distinct()
        forest = chosen if forest is None else forest.unionByName(chosen)
        merged = connected_components(best.select(F.col("c").alias("id")).unionByName(best.select(F.col("other").alias("id"))),
                                      best, src="c", dst="other")
        labels = cut_lineage(labels.join(merged.select(F.col("id").alias("comp"), F.col("comp").alias("new")), "comp", "left")
                             .select("id", F.coalesce("new", "comp").alias("comp")))
        e = cross.select("u", "v", "w")
        forest = cut_lineage(forest)
    if forest is None:
        return e.limit(0).select("u", "v", "w")
    return forest
