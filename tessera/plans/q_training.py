"""Training rows (N1) and preference pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import training
from tessera.plans.catalog import register
from tessera.session import read_table


@register("preference_pairs", """
WITH l AS (SELECT source AS task, doc_id, n_chars, CASE WHEN quality = 1 AND toxic = 0 THEN true WHEN quality = 0 OR toxic = 1 THEN false END AS side
           FROM documents JOIN labels USING (doc_id) WHERE source IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY task, side ORDER BY n_chars DESC, doc_id) AS rank FROM l WHERE side IS NOT NULL)
SELECT p.task, p.rank, p.doc_id AS positive, n.doc_id AS negative
FROM r p JOIN r n ON n.task = p.task AND n.rank = p.rank AND p.side AND NOT n.side""")
def q_preference_pairs(spark, sf_dir):
    """Per source the i-th longest good document and the i-th longest bad one."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    rows = docs.join(read_table(spark, sf_dir, "labels"), "doc_id")
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    return training.preference_pairs(rows, "source", "doc_id", good, bad, [F.desc("n_chars")])


MAX_LENGTH, VOCABULARY = 256, 32_000


@register("pad_truncate", f"""
WITH t AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS words FROM documents),
c AS (SELECT token, count(*) AS n FROM (SELECT unnest(words) AS token FROM t) GROUP BY token),
v AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) + 1 AS id FROM c QUALIFY id <= {VOCABULARY} + 1),
e AS (SELECT doc_id, unnest(words[1:{MAX_LENGTH}]) AS token, generate_subscripts(words[1:{MAX_LENGTH}], 1) AS p FROM t),
j AS (SELECT doc_id, string_agg(coalesce(id, 1)::VARCHAR, ',' ORDER BY p) AS ids, count(id) AS n_known FROM e LEFT JOIN v USING (token) GROUP BY doc_id),
o AS (SELECT t.doc_id, len(words)::INT AS n_tokens, least(len(words), {MAX_LENGTH})::BIGINT AS n_kept, coalesce(n_known, 0)::BIGINT AS n_known, coalesce(ids, '') AS ids FROM t LEFT JOIN j USING (doc_id))
SELECT doc_id, n_tokens, n_kept, n_known,
       sha256(ids || CASE WHEN n_kept IN (0, {MAX_LENGTH}) THEN '' ELSE ',' END || array_to_string(list_transform(range({MAX_LENGTH} - n_kept), lambda x: '0'), ',')) AS ids_sha256
FROM o""")
def q_pad_truncate(spark, sf_dir):
    """Token ids of every document by frequency rank, cut or padded."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = training.training_rows(docs, training.vocabulary(docs, size=VOCABULARY), max_length=MAX_LENGTH)
    return rows.select(F.col("id").alias("doc_id"), "n_tokens", F.aggregate("attention_mask", F.lit(0), lambda s, x: s + x).cast("bigint").alias("n_kept"),
                       F.size(F.filter("input_ids", lambda x: x >= training.FIRST)).cast("bigint").alias("n_known"),
                       F.sha2(F.array_join(F.col("labels").cast("array<string>"), ","), 256).alias("ids_sha256"))
