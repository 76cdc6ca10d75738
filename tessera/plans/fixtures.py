"""Adapters that cast the driver's test tables into the reference's roles.

documents      -> notebook metadata (id, title, language code, length)
conversations  -> cells (one row per turn; turn = position), and for the
                  file-format checks only, notebooks (one JSON text each)
a 4-row code -> language-name lookup plays the languages dimension.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.cells import cells_from_turns
from tessera.operators.joins import lookup_join
from tessera.operators.notebooks import notebooks_from_turns
from tessera.session import read_table

# Fixed test mapping from documents.lang codes to language names.
LANGUAGE_CODES = (("en", "Python"), ("fr", "R"), ("de", "Julia"), ("es", "Klingon"))

LANGUAGE_CASE_SQL = ("CASE lang WHEN 'en' THEN 'Python' WHEN 'fr' THEN 'R' "
                     "WHEN 'de' THEN 'Julia' WHEN 'es' THEN 'Klingon' END")


def language_codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LANGUAGE_CODES), "code string, name string")


def doc_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as notebook metadata: id, title, language (lookup, 'unknown' if unmapped), length."""
    docs = read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("title"), "lang", F.col("n_chars").alias("length"))
    return lookup_join(docs, language_codes(spark), "lang", "code", "name", "language")


def notebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notebook-file form (one raw JSON per conversation): only for the checks
    that are about the file format itself (V1/V2); everything per cell reads
    ``cells`` below, which never assembles a conversation."""
    return notebooks_from_turns(read_table(spark, sf_dir, "conversations"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell-row form: one row per turn (notebook_id, position, kind, source, metadata)."""
    return cells_from_turns(read_table(spark, sf_dir, "conversations"))


# DuckDB side of the same adapters.
META_SQL = f"""meta AS (
  SELECT doc_id AS id, source AS title, lang, n_chars AS length,
         coalesce({LANGUAGE_CASE_SQL}, 'unknown') AS language
  FROM documents)"""

CELLS_SQL = """cells AS (
  SELECT conv_id AS notebook_id, turn,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position,
         CASE role WHEN 'user' THEN 'markdown' WHEN 'assistant' THEN 'code' ELSE role END AS kind,
         text AS source, role
  FROM conversations)"""

CELL_RULE_SQL = """CASE WHEN kind IS NULL THEN 'missing_cell_type'
     WHEN kind NOT IN ('code', 'markdown') THEN 'invalid_cell_type'
     WHEN source IS NULL THEN 'missing_source'
     WHEN length(source) < 10 THEN 'too_short'
     WHEN length(source) > 10000 THEN 'too_long'
     WHEN kind = 'markdown' AND NOT regexp_matches(source, '[#*`]') THEN 'invalid_markdown'
END"""

VERDICT_SQL = f"""verdict AS (
  SELECT notebook_id, count(*) AS n_cells,
         count(error_kind) AS n_errors,
         count(*) FILTER (WHERE error_kind = 'invalid_markdown') AS n_invalid_markdown,
         count(error_kind) = 0 AS valid
  FROM (SELECT notebook_id, {CELL_RULE_SQL} AS error_kind FROM cells) GROUP BY notebook_id)"""
