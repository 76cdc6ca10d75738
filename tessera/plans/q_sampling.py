"""Sampling queries (M1-M3) and the sampled flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import sampling
from tessera.plans.catalog import register
from tessera.session import read_table

HASH_SQL = "('0x' || substr(md5(concat_ws(':', {c}::VARCHAR, '42')), 1, 13))::UBIGINT"


@register("sample_uniform", f"""
SELECT o_orderkey, o_custkey FROM orders ORDER BY {HASH_SQL.format(c='o_orderkey')}, o_orderkey LIMIT 1000""")
def q_sample_uniform(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return sampling.sample_uniform(orders, 1000, "o_orderkey")


@register("sample_weighted", f"""
SELECT doc_id, lang FROM documents
ORDER BY -ln(({HASH_SQL.format(c='doc_id')}::DOUBLE + 0.5) / 4503599627370496.0) / (coalesce(n_chars::DOUBLE, 0) + 0.001), doc_id
LIMIT 100""")
def q_sample_weighted(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return sampling.sample_weighted(docs, 100, "doc_id", "n_chars").select("doc_id", "lang")


@register("sample_stratified", f"""
WITH k AS (SELECT doc_id, lang, {HASH_SQL.format(c='doc_id')} AS h FROM documents),
q AS (SELECT greatest(1, 100 // (count(DISTINCT lang) + max(CASE WHEN lang IS NULL THEN 1 ELSE 0 END))) AS quota FROM documents),
r AS (SELECT k.*, row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) AS rn FROM k WHERE lang IS NOT NULL),
chosen AS (SELECT doc_id, lang, h FROM r WHERE rn <= (SELECT quota FROM q)),
rest AS (SELECT doc_id, lang, h, row_number() OVER (ORDER BY h, doc_id) AS rn2 FROM k
         WHERE doc_id NOT IN (SELECT doc_id FROM chosen))
SELECT doc_id, lang FROM chosen
UNION ALL SELECT doc_id, lang FROM rest WHERE rn2 <= 100 - (SELECT count(*) FROM chosen)""")
def q_sample_stratified(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sampling.sample_stratified(docs, 100, "doc_id", "lang")


@register("sample_stratified_events", f"""
WITH k AS (SELECT event_id, event_type, {HASH_SQL.format(c='event_id')} AS h FROM events),
q AS (SELECT greatest(1, 2000 // (count(DISTINCT event_type) + max(CASE WHEN event_type IS NULL THEN 1 ELSE 0 END))) AS quota FROM events),
r AS (SELECT k.*, row_number() OVER (PARTITION BY event_type ORDER BY h, event_id) AS rn FROM k WHERE event_type IS NOT NULL),
chosen AS (SELECT event_id, event_type, h FROM r WHERE rn <= (SELECT quota FROM q)),
rest AS (SELECT event_id, event_type, h, row_number() OVER (ORDER BY h, event_id) AS rn2 FROM k
         WHERE event_id NOT IN (SELECT event_id FROM chosen))
SELECT event_id, event_type FROM chosen
UNION ALL SELECT event_id, event_type FROM rest WHERE rn2 <= 2000 - (SELECT count(*) FROM chosen)""")
def q_sample_stratified_events(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select("event_id", "event_type")
    return sampling.sample_stratified(ev, 2000, "event_id", "event_type")


@register("sample_third_of_documents", f"""
WITH k AS (SELECT doc_id, lang, {HASH_SQL.format(c='doc_id')} AS h FROM documents),
q AS (SELECT count(*) // 3 AS n, greatest(1, (count(*) // 3) // (count(DISTINCT lang) + max(CASE WHEN lang IS NULL THEN 1 ELSE 0 END))) AS quota FROM documents),
r AS (SELECT k.*, row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) AS rn FROM k),
chosen AS (SELECT doc_id, lang FROM r WHERE lang IS NOT NULL AND rn <= (SELECT quota FROM q)),
rest AS (SELECT doc_id, lang, row_number() OVER (ORDER BY h, doc_id) AS rn2 FROM r WHERE lang IS NULL OR rn > (SELECT quota FROM q))
SELECT doc_id, lang FROM chosen
UNION ALL SELECT doc_id, lang FROM rest WHERE rn2 <= (SELECT n FROM q) - (SELECT count(*) FROM chosen)""")
def q_sample_third_of_documents(spark, sf_dir):
    """M3: a third of all documents, stratified by language: a quota that grows with the table."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sampling.sample_stratified(docs, docs.count() // 3, "doc_id", "lang")
