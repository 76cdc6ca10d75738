"""Validation, notebook and cell queries (documents + conversations)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import cells as cellops
from tessera.operators import validation as val
from tessera.plans.catalog import register
from tessera.plans.fixtures import CELL_RULE_SQL, CELLS_SQL, META_SQL, VERDICT_SQL, cells, doc_metadata


def validate_dataset(spark, sf_dir, sample_size=None, check_code=False):
    """V7 flagship: metadata checks + notebook verdicts -> long report."""
    meta_all = doc_metadata(spark, sf_dir)
    meta = meta_all
    cl = cells(spark, sf_dir)
    if sample_size is not None:
        from tessera.operators.sampling import sample_weighted
        meta = sample_weighted(meta_all, sample_size, "id", "length")
        from tessera.session import BROADCAST_MAX_ROWS
        # The sample has at most sample_size rows by construction: that is the size proof.
        ids = meta.select(F.col("id").alias("notebook_id")).distinct()
        cl = cl.join(F.broadcast(ids) if sample_size <= BROADCAST_MAX_ROWS else ids, "notebook_id", "left_semi")
    verdicts = cellops.notebook_verdicts(cl, check_code=check_code)
    total = meta_all.agg(F.count(F.lit(1)).alias("total_rows"))
    return val.validation_summary(meta, verdicts, "id", "language", None, total_rows=total)


VALIDATION_SUMMARY_SQL = f"""
WITH {META_SQL}, {CELLS_SQL}, {VERDICT_SQL},
j AS (SELECT m.*, v.notebook_id IS NOT NULL AS found, v.valid, v.n_invalid_markdown
      FROM meta m LEFT JOIN verdict v ON m.id = v.notebook_id),
a AS (SELECT count(*) AS total_notebooks, count(*) AS sampled_notebooks,
        count(*) FILTER (WHERE found AND valid) AS valid_notebooks,
        count(*) FILTER (WHERE found AND NOT valid) AS invalid_notebooks,
        0 AS missing_metadata, 0 AS invalid_code,
        coalesce(sum(n_invalid_markdown) FILTER (WHERE found), 0) AS invalid_markdown,
        count(*) FILTER (WHERE coalesce(lower(language) NOT IN ('python','r','julia','javascript','sql','scala','java','c++','c#','go','rust','swift','kotlin','php','ruby','perl','matlab','octave','sas','stata','spss','unknown'), true)) AS invalid_language,
        count(*) FILTER (WHERE lower(trim(language)) NOT IN ('python','ipython notebook html','ipython notebook','r','rmarkdown','r notebook html')) AS invalid_canonical,
        0 AS invalid_timestamps,
        count(*) FILTER (WHERE NOT found) AS missing_notebooks
      FROM j)
SELECT 'total_notebooks' AS metric, total_notebooks::BIGINT AS value FROM a
UNION ALL SELECT 'sampled_notebooks', sampled_notebooks FROM a
UNION ALL SELECT 'valid_notebooks', valid_notebooks FROM a
UNION ALL SELECT 'invalid_notebooks', invalid_notebooks FROM a
UNION ALL SELECT 'missing_metadata', missing_metadata FROM a
UNION ALL SELECT 'invalid_code', invalid_code FROM a
UNION ALL SELECT 'invalid_markdown', invalid_markdown FROM a
UNION ALL SELECT 'invalid_language', invalid_language FROM a
UNION ALL SELECT 'invalid_canonical', invalid_canonical FROM a
UNION ALL SELECT 'invalid_language_total', invalid_language + invalid_canonical FROM a
UNION ALL SELECT 'invalid_timestamps', invalid_timestamps FROM a
UNION ALL SELECT 'missing_notebooks', missing_notebooks FROM a
UNION ALL SELECT 'duplicate_ids', coalesce(sum(c), 0)::BIGINT FROM (SELECT count(*) AS c FROM meta GROUP BY id HAVING count(*) > 1)
UNION ALL SELECT 'total_rows', count(*)::BIGINT FROM documents
"""


@register("validation_summary", VALIDATION_SUMMARY_SQL)
def q_validation_summary(spark, sf_dir):
    """V7 without the Python syntax check (V4), so DuckDB can state the same report."""
    return validate_dataset(spark, sf_dir)


@register("validation_summary_code")
def q_validation_summary_code(spark, sf_dir):
    """V7 with V4: code cells that pass the length rules are parsed as Python."""
    return validate_dataset(spark, sf_dir, check_code=True)


@register("compile_rate")
def q_compile_rate(spark, sf_dir):
    """Share of checked code cells that parse as Python, per notebook language."""
    meta = doc_metadata(spark, sf_dir).select(F.col("id").alias("notebook_id"), "language")
    code = cells(spark, sf_dir).filter((F.col("kind") == "code") & val.cell_rule(F.col("kind"), F.col("source")).isNull())
    # Check where the cells are, then reduce to one row per notebook: the join
    # to the metadata moves two counts per notebook, never the code text.
    ok = code.select("notebook_id", val.python_compiles(F.col("source")).alias("ok"))
    per_nb = ok.groupBy("notebook_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_ok"))
    j = per_nb.join(meta, "notebook_id")
    return j.groupBy("language").agg(F.sum("n").alias("n_code_cells"),
                                     (F.sum("n_ok") / F.sum("n")).alias("compile_rate"))


@register("language_distribution", f"""
WITH {META_SQL}
SELECT language, count(*) AS n FROM meta WHERE language IS NOT NULL GROUP BY language""")
def q_language_distribution(spark, sf_dir):
    return val.language_distribution(doc_metadata(spark, sf_dir), "language")


@register("canonical_language", f"""
WITH {META_SQL}
SELECT id, language,
  CASE WHEN lower(trim(language)) IN ('python','ipython notebook html','ipython notebook') THEN 'python'
       WHEN lower(trim(language)) IN ('r','rmarkdown','r notebook html') THEN 'r' ELSE 'other' END AS canonical_language,
  coalesce(lower(language) NOT IN ('python','r','julia','javascript','sql','scala','java','c++','c#','go','rust','swift','kotlin','php','ruby','perl','matlab','octave','sas','stata','spss','unknown'), true) AS bad_language
FROM meta""")
def q_canonical_language(spark, sf_dir):
    flags = val.metadata_flags(doc_metadata(spark, sf_dir), "id", "language")
    return flags.select("id", "language", "canonical_language", "bad_language")


@register("notebook_verdict", f"""
WITH {CELLS_SQL}, {VERDICT_SQL}
SELECT notebook_id, n_cells, n_errors, valid FROM verdict""")
def q_notebook_verdict(spark, sf_dir):
    v = cellops.notebook_verdicts(cells(spark, sf_dir))
    return v.select("notebook_id", "n_cells", "n_errors", "valid")


@register("cell_rules", f"""
WITH {CELLS_SQL}
SELECT notebook_id, position, kind, {CELL_RULE_SQL} AS error_kind FROM cells""")
def q_cell_rules(spark, sf_dir):
    return cellops.with_errors(cells(spark, sf_dir)).select("notebook_id", "position", "kind", "error_kind")


@register("explode_cells", f"""
WITH {CELLS_SQL}
SELECT notebook_id, position,
       kind AS type,
       CASE kind WHEN 'code' THEN '<code>' || source || '</code>'
                 WHEN 'markdown' THEN '<markdown>' || source || '</markdown>' END AS content,
       '{{"role":"' || role || '"}}' AS metadata
FROM cells WHERE kind IN ('code', 'markdown')""")
def q_explode_cells(spark, sf_dir):
    return cellops.explode_cells(cells(spark, sf_dir))


@register("markdown_formatted", f"""
WITH {CELLS_SQL}
SELECT notebook_id, position, regexp_matches(source, '[#*`]') AS formatted
FROM cells WHERE kind = 'markdown'""")
def q_markdown_formatted(spark, sf_dir):
    md = cells(spark, sf_dir).filter(F.col("kind") == "markdown")
    return md.select("notebook_id", "position", F.col("source").rlike("[#*`]").alias("formatted"))


@register("code_compiles")
def q_code_compiles(spark, sf_dir):
    """V4: Python syntax check of code cells that pass the length rules (Arrow UDF)."""
    cl = cells(spark, sf_dir)
    code = cl.filter((F.col("kind") == "code") & val.cell_rule(F.col("kind"), F.col("source")).isNull())
    return code.select("notebook_id", "position", val.python_compiles(F.col("source")).alias("compiles"))


@register("error_samples", f"""
WITH {CELLS_SQL},
e AS (SELECT notebook_id, position, {CELL_RULE_SQL} AS error_kind FROM cells),
bad AS (SELECT notebook_id, list(error_kind ORDER BY position) FILTER (WHERE error_kind IS NOT NULL) AS errs
        FROM e GROUP BY notebook_id HAVING count(error_kind) > 0)
SELECT notebook_id, array_to_string(errs[1:3], ',') AS errors FROM bad ORDER BY notebook_id LIMIT 5""")
def q_error_samples(spark, sf_dir):
    return cellops.error_samples(cells(spark, sf_dir))
