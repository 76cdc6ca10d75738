"""Preprocess, drafts, encoder, domain tags, caps, side effects, citation gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import cells as cellops
from tessera.operators import corpus, knn
from tessera.operators import notebooks as nbops
from tessera.plans.catalog import r6, register
from tessera.plans.fixtures import CELLS_SQL, META_SQL, cells, doc_metadata
from tessera.plans.q_vectors import L2_SQL, MEANS_SQL, _centroid_queries
from tessera.session import read_table


def preprocess(spark, sf_dir, sample_size=None):
    """Metadata (language lookup) -> optional sample -> notebooks -> tagged cells."""
    meta = doc_metadata(spark, sf_dir)
    if sample_size is not None:
        from tessera.operators.sampling import sample_uniform
        meta = sample_uniform(meta, sample_size, "id")
    exploded = cellops.explode_cells(cells(spark, sf_dir))
    return exploded.join(meta.select(F.col("id").alias("notebook_id"), "title", "language"), "notebook_id")


@register("preprocess", f"""
WITH {META_SQL}, {CELLS_SQL}
SELECT c.notebook_id, c.position, c.kind AS type,
       CASE c.kind WHEN 'code' THEN '<code>' || c.source || '</code>' ELSE '<markdown>' || c.source || '</markdown>' END AS content,
       m.title, m.language
FROM cells c JOIN meta m ON m.id = c.notebook_id WHERE c.kind IN ('code', 'markdown')""")
def q_preprocess(spark, sf_dir):
    return preprocess(spark, sf_dir).select("notebook_id", "position", "type", "content", "title", "language")


@register("preprocess_counts", f"""
WITH {META_SQL}
SELECT count(*) FILTER (WHERE id IN (SELECT conv_id FROM conversations)) AS processed,
       count(*) FILTER (WHERE id NOT IN (SELECT conv_id FROM conversations)) AS errors FROM meta""")
def q_preprocess_counts(spark, sf_dir):
    """Notebooks processed vs. errors (missing file or unparseable notebook)."""
    meta = doc_metadata(spark, sf_dir).select("id")
    nbs = cellops.explodable_notebooks(cells(spark, sf_dir)).withColumnRenamed("notebook_id", "id")
    j = meta.join(nbs, "id", "left")
    return j.agg(F.count_if(F.coalesce("ok", F.lit(False))).alias("processed"),
                 F.count_if(~F.coalesce("ok", F.lit(False))).alias("errors"))


@register("normalise_drafts", """
SELECT conv_id, turn, true AS is_fallback, '# conversation ' || conv_id::VARCHAR || chr(10) || chr(10) || text AS source
FROM conversations WHERE role = 'assistant'""")
def q_normalise_drafts(spark, sf_dir):
    """Assistant turns as drafts -> notebook JSON (fallback: one markdown cell)."""
    conv = read_table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    drafts = conv.withColumn("task", F.concat(F.lit("conversation "), F.col("conv_id").cast("string")))
    out = nbops.normalise_drafts(drafts, "task", "text")
    return out.select("conv_id", "turn", "is_fallback",
                      F.get_json_object("notebook_json", "$.cells[0].source[0]").alias("source"))


@register("encode_documents")
def q_encode_documents(spark, sf_dir):
    """Hashed TF-IDF document vectors (pluggable encoder default)."""
    docs = read_table(spark, sf_dir, "documents")
    return corpus.encode_documents(docs, "doc_id", "text")


DOMAIN_KW_SQL = " UNION ALL ".join(
    f"SELECT '{d}' AS domain, {i} AS domain_order, '{w}' AS word"
    for i, (d, ws) in enumerate(corpus.DOMAIN_KEYWORDS) for w in ws)


@register("domain_tags", f"""
WITH kw AS ({DOMAIN_KW_SQL}),
tok AS (SELECT doc_id AS id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9\\-]+')) AS word FROM documents),
per AS (SELECT id, domain, domain_order, count(*) AS hits FROM tok JOIN kw USING (word) GROUP BY ALL),
best AS (SELECT id, arg_min(domain, (-hits, domain_order)) AS best_domain FROM per GROUP BY id)
SELECT id, domain, hits, best_domain FROM per JOIN best USING (id)""")
def q_domain_tags(spark, sf_dir):
    return corpus.domain_tags(read_table(spark, sf_dir, "documents"), "doc_id", "text")


@register("cap_cells", f"""
WITH {CELLS_SQL},
kept AS (SELECT *, row_number() OVER (PARTITION BY notebook_id ORDER BY position) AS k FROM cells WHERE kind IN ('code', 'markdown'))
SELECT notebook_id, k - 1 AS cell_index, kind, substr(source, 1, 1000) AS source FROM kept WHERE k <= 20""")
def q_cap_cells(spark, sf_dir):
    """D3: at most 20 kept cells per notebook, 1000 characters each (salted top-k per notebook)."""
    return cellops.cap_cells(cells(spark, sf_dir))


@register("side_effect_cells", f"""
WITH {CELLS_SQL}
SELECT notebook_id, position, regexp_matches(source, '(^|\\n)[ \\t]*[!%]') AS side_effect FROM cells WHERE kind = 'code'""")
def q_side_effect_cells(spark, sf_dir):
    code = cells(spark, sf_dir).filter(F.col("kind") == "code")
    return code.select("notebook_id", "position", F.col("source").rlike(r"(^|\n)[ \t]*[!%]").alias("side_effect"))


@register("citation_gate", f"""
WITH {MEANS_SQL},
d AS (SELECT m.label AS qid, min({L2_SQL}) AS nearest FROM means m, embeddings e GROUP BY m.label)
SELECT qid, round(nearest, 6) AS nearest, CASE WHEN nearest <= 0.75 THEN 'cited' ELSE 'rejected' END AS verdict FROM d""")
def q_citation_gate(spark, sf_dir):
    """Centroid drafts are cited only if a corpus vector lies within 0.75."""
    hits = knn.knn_exact(read_table(spark, sf_dir, "embeddings"), _centroid_queries(spark, sf_dir), k=1)
    g = corpus.citation_gate(hits, 0.75)
    return g.select(F.col("qid").cast("int").alias("qid"), r6("nearest").alias("nearest"), "verdict")
