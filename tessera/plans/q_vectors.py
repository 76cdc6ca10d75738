"""Vector queries over `embeddings`: norms, class means, collapse, kNN, prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.vectors import norm
from tessera.operators import collapse, knn, multiprobe, vector_index
from tessera.plans.catalog import r6, register
from tessera.session import read_table, scratch_path

# DuckDB: unit rows -> per-label mean -> re-normalised mean vector.
MEANS_SQL = """unit AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS nrm
  FROM embeddings),
comp AS (SELECT label, vec_id, unnest(e) / nrm AS x, generate_subscripts(e, 1) AS pos FROM unit WHERE nrm > 0),
raw AS (SELECT label, pos, avg(x) AS m FROM comp GROUP BY label, pos),
cnt AS (SELECT label, count(*) AS n FROM unit WHERE nrm > 0 GROUP BY label),
mn AS (SELECT label, sqrt(sum(m * m)) AS mean_norm FROM raw GROUP BY label),
means AS (SELECT r.label, c.n, mn.mean_norm, list(r.m / mn.mean_norm ORDER BY r.pos) AS mean
          FROM raw r JOIN mn USING (label) JOIN cnt c USING (label) GROUP BY r.label, c.n, mn.mean_norm)"""


@register("vector_norms", """
SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm FROM embeddings""")
def q_vector_norms(spark, sf_dir):
    emb = read_table(spark, sf_dir, "embeddings")
    return emb.select("vec_id", r6(norm("embedding")).alias("norm"))


@register("class_means", f"""
WITH {MEANS_SQL}
SELECT label, n, round(mean_norm, 6) AS mean_norm, list_transform(mean, lambda x: round(x, 6)) AS mean FROM means""")
def q_class_means(spark, sf_dir):
    m = collapse.class_means(read_table(spark, sf_dir, "embeddings"))
    return m.select("label", "n", r6("mean_norm").alias("mean_norm"),
                    F.transform("mean", lambda x: F.round(x, 6)).alias("mean"))


@register("collapse_stats", f"""
WITH {MEANS_SQL},
rows AS (SELECT u.vec_id, 1 - list_sum(list_transform(list_zip(u.e, m.mean), lambda z: z[1] / u.nrm * z[2])) AS d
         FROM unit u JOIN means m USING (label) WHERE u.nrm > 0),
pairs AS (SELECT 1 - list_sum(list_transform(list_zip(a.mean, b.mean), lambda z: z[1] * z[2])) AS d
          FROM means a JOIN means b ON a.label < b.label),
s AS (SELECT (SELECT avg(d) FROM rows) AS intra, coalesce((SELECT avg(d) FROM pairs), 0) AS inter,
             (SELECT count(*) FROM means) AS n_classes, (SELECT sum(n) FROM means) AS n_rows)
SELECT round(intra, 6) AS intra_class_dist, round(inter, 6) AS inter_class_dist,
       round(CASE WHEN inter > 0 THEN intra / inter ELSE 'inf'::DOUBLE END, 6) AS nc_index,
       n_classes, n_rows::BIGINT AS n_rows, CASE WHEN inter > 0 THEN intra / inter ELSE 'inf'::DOUBLE END <= 0.05 AS collapsed
FROM s""")
def q_collapse_stats(spark, sf_dir):
    st = collapse.is_collapsed(read_table(spark, sf_dir, "embeddings"), 0.05)
    return st.select(r6("intra_class_dist").alias("intra_class_dist"), r6("inter_class_dist").alias("inter_class_dist"),
                     r6("nc_index").alias("nc_index"), "n_classes", "n_rows", "collapsed")


def _centroid_queries(spark, sf_dir):
    """Queries = the normalised class means (one per label, derived from the table)."""
    m = collapse.class_means(read_table(spark, sf_dir, "embeddings"))
    return m.select(F.col("label").cast("bigint").alias("qid"), F.col("mean").alias("qvec"))


KNN_SQL = """
WITH {means},
d AS (SELECT m.label AS qid, e.vec_id,
             {dist} AS dist
      FROM means m, embeddings e),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS rank FROM d)
SELECT qid, vec_id, round(dist, 6) AS dist, rank FROM r WHERE rank <= 5"""

L2_SQL = "sqrt(list_sum(list_transform(list_zip(e.embedding::DOUBLE[], m.mean), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
COS_SQL = ("1 - list_sum(list_transform(list_zip(e.embedding::DOUBLE[], m.mean), lambda z: z[1] * z[2])) / "
           "(sqrt(list_sum(list_transform(e.embedding::DOUBLE[], lambda x: x * x))) * sqrt(list_sum(list_transform(m.mean, lambda x: x * x))))")


@register("knn_l2", KNN_SQL.format(means=MEANS_SQL, dist=L2_SQL))
def q_knn_l2(spark, sf_dir):
    emb = read_table(spark, sf_dir, "embeddings")
    res = knn.knn_exact(emb, _centroid_queries(spark, sf_dir), k=5, metric="l2")
    return res.select(F.col("qid").cast("int").alias("qid"), "vec_id", r6("dist").alias("dist"), "rank")


@register("knn_cosine", KNN_SQL.format(means=MEANS_SQL, dist=COS_SQL))
def q_knn_cosine(spark, sf_dir):
    emb = read_table(spark, sf_dir, "embeddings")
    res = knn.knn_exact(emb, _centroid_queries(spark, sf_dir), k=5, metric="cosine")
    return res.select(F.col("qid").cast("int").alias("qid"), "vec_id", r6("dist").alias("dist"), "rank")


@register("recall_at_k")
def q_recall_at_k(spark, sf_dir):
    """Multi-probe candidates + exact re-rank vs exact search, recall@10 per centroid query and
    the number of rows it was compared with."""
    emb = read_table(spark, sf_dir, "embeddings")
    qs = _centroid_queries(spark, sf_dir)
    exact = knn.knn_exact(emb, qs, k=10)
    found = multiprobe.search(emb, qs, k=10)
    compared = found.groupBy("qid").agg(F.count("*").alias("candidates"))
    return knn.recall_at_k(multiprobe.nearest(found, 10), exact, 10).join(compared, "qid", "left").select(
        "qid", "recall", F.coalesce("candidates", F.lit(0)).alias("candidates"))


@register("augment_prompts", f"""
WITH {MEANS_SQL},
d AS (SELECT m.label AS qid, e.vec_id, {L2_SQL} AS dist FROM means m, embeddings e),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS rank FROM d),
h AS (SELECT qid, string_agg('- ' || b.text || chr(10), '' ORDER BY rank) AS lines, list(vec_id ORDER BY rank) AS citations
      FROM r LEFT JOIN documents b ON b.doc_id = r.vec_id WHERE rank <= 3 GROUP BY qid),
p AS (SELECT DISTINCT label AS qid, 'Describe class ' || label::VARCHAR AS prompt FROM embeddings)
SELECT p.qid, CASE WHEN h.lines IS NOT NULL THEN p.prompt || chr(10) || chr(10) || 'Relevant information:' || chr(10) || h.lines
                   ELSE p.prompt END AS augmented,
       coalesce(h.citations, []::BIGINT[]) AS citations
FROM p LEFT JOIN h USING (qid)""")
def q_augment_prompts(spark, sf_dir):
    """Per class prompt, the documents of its 3 nearest vectors appended, all hits cited."""
    emb = read_table(spark, sf_dir, "embeddings")
    hits = knn.knn_exact(emb, _centroid_queries(spark, sf_dir), k=3)
    prompts = emb.select(F.col("label").cast("bigint").alias("qid")).distinct().withColumn(
        "prompt", F.concat(F.lit("Describe class "), F.col("qid").cast("string")))
    contents = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("content"))
    out = knn.augment_prompts(prompts, hits, contents)
    return out.select(F.col("qid").cast("int").alias("qid"), "augmented", "citations")


SESSION_IDS = 100  # the session index holds the newest 100 ids of the store


def _session_split(emb):
    """Session = ids above max(id) - SESSION_IDS (autoincrement ids: newest rows); literal bound, pushed to the scan."""
    top = emb.agg(F.max("vec_id")).first()[0]
    lo = (top if top is not None else 0) - SESSION_IDS
    return emb.filter(F.col("vec_id") > lo), emb.filter(F.col("vec_id") <= lo)


@register("dual_search", f"""
WITH {MEANS_SQL},
t AS (SELECT *, CASE WHEN vec_id > (SELECT max(vec_id) FROM embeddings) - {SESSION_IDS} THEN 'session' ELSE 'long_term' END AS tier
      FROM embeddings),
d AS (SELECT m.label AS qid, e.vec_id, e.tier, {L2_SQL} AS dist FROM means m, t e),
r1 AS (SELECT *, row_number() OVER (PARTITION BY qid, tier ORDER BY dist, vec_id) AS tr FROM d),
r2 AS (SELECT qid, vec_id, tier, dist, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS rank FROM r1 WHERE tr <= 5)
SELECT qid, vec_id, round(dist, 6) AS dist, rank, tier FROM r2 WHERE rank <= 5""")
def q_dual_search(spark, sf_dir):
    """Session (newest ids) and long-term indexes searched exactly, merged top-5 with its tier."""
    emb = read_table(spark, sf_dir, "embeddings")
    session, long_term = _session_split(emb)
    res = knn.dual_search(session, long_term, _centroid_queries(spark, sf_dir), k=5)
    return res.select(F.col("qid").cast("int").alias("qid"), "vec_id", r6("dist").alias("dist"), "rank", "tier")


def _embedding_queries(emb):
    """Every row whose id is divisible by 20 asks for its neighbours."""
    return emb.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))


@register("vector_index_search", f"""
WITH m AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS mean FROM embeddings WHERE vec_id % 20 = 0),
d AS (SELECT m.qid, e.vec_id, {L2_SQL} AS dist FROM m, embeddings e),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS rank FROM d)
SELECT qid, vec_id, round(dist, 6) AS dist, rank FROM r WHERE rank <= 10""")
def q_vector_index_search(spark, sf_dir):
    """S11 + R3: index of all embeddings, exact 10 nearest of every 20th row by pruned reads."""
    emb = read_table(spark, sf_dir, "embeddings")
    path = scratch_path(spark, "vector-index")
    vector_index.build(emb, path)
    res = vector_index.search(spark, path, _embedding_queries(emb), k=10)
    return res.select("qid", "vec_id", r6("dist").alias("dist"), "rank")
