"""Cell-row form of the notebook operators.

Input is one row per cell, ``(notebook_id, position, kind, source, metadata)``:
the JSONL form the preprocess step writes and retrieval reads, or the turns
of a conversation table.  Nothing here assembles a notebook into one row, so
a notebook holding a third of all cells is never one task's or one row's
work: per-cell rules are projections, per-notebook verdicts are partial /
final aggregates (map-side combine), rejected notebooks leave through an anti
join against their ids, and per-notebook caps and first errors use the salted
top-k.  The notebook-file form (one raw JSON text per notebook, as a folder of
``.json`` files is read) lives in ``operators.notebooks`` / ``validation``.

A notebook with no cells has no rows here; the file form reports it as found
and valid, the cell form cannot see it (validation then counts it missing).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import CELL_KINDS, wrap_content
from tessera.operators.corpus import MAX_CELL_LENGTH, MAX_CELLS
from tessera.operators.topk import top_k_per_group
from tessera.operators.validation import cell_rule, python_compiles


def cells_from_turns(turns: DataFrame, id_col: str = "conv_id", pos_col: str = "turn",
                     role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversation turns as cells: user -> markdown, assistant -> code, any other
    role stays the (rejected) kind; the turn (0-based) is the cell's position and
    the role is kept as cell metadata.  A projection: no shuffle."""
    role = F.col(role_col)
    kind = F.when(role == "user", F.lit("markdown")).when(role == "assistant", F.lit("code")).otherwise(role)
    return turns.select(F.col(id_col).alias("notebook_id"), F.col(pos_col).alias("position"), kind.alias("kind"),
                        F.col(text_col).alias("source"),
                        F.to_json(F.create_map(F.lit("role"), role)).alias("metadata"))


def cell_ok(kind="kind", source="source"):
    """A cell the reference's explode loop accepts: it has a kind, and kept kinds have a source."""
    k, s = F.col(kind), F.col(source)
    return k.isNotNull() & (~k.isin(*CELL_KINDS) | s.isNotNull())


def with_errors(cells: DataFrame, check_code: bool = False) -> DataFrame:
    """Adds ``error_kind`` (V3/V5 first failure; V4 ``invalid_code`` when ``check_code``).

    Only code cells that passed the cheaper rules reach the Python worker; all
    other rows send it a NULL.
    """
    err = cell_rule(F.col("kind"), F.col("source"))
    out = cells.withColumn("error_kind", err)
    if check_code:
        to_check = F.when(F.col("error_kind").isNull() & (F.col("kind") == "code"), F.col("source"))
        out = out.withColumn("_compiles", python_compiles(to_check)).withColumn(
            "error_kind", F.when(F.col("_compiles") == F.lit(False), F.lit("invalid_code")).otherwise(F.col("error_kind"))
        ).drop("_compiles")
    return out


def notebook_verdicts(cells: DataFrame, check_code: bool = False) -> DataFrame:
    """V6 per notebook from its cells, one partial/final aggregate.

    Columns match the notebook-file form: notebook_id, json_ok, missing_fields,
    n_cells, n_errors, n_invalid_code, n_invalid_markdown, valid.  Cell rows
    carry no JSON envelope, so the structure checks hold trivially.
    """
    e = with_errors(cells, check_code)
    agg = e.groupBy("notebook_id").agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.count("error_kind").alias("n_errors"),
        F.count_if(F.col("error_kind") == "invalid_code").alias("n_invalid_code"),
        F.count_if(F.col("error_kind") == "invalid_markdown").alias("n_invalid_markdown"))
    return agg.select("notebook_id", F.lit(True).alias("json_ok"), F.array().cast("array<string>").alias("missing_fields"),
                      "n_cells", "n_errors", "n_invalid_code", "n_invalid_markdown",
                      (F.col("n_errors") == 0).alias("valid"))


def rejected_notebooks(cells: DataFrame) -> DataFrame:
    """Ids of notebooks with a cell the explode loop would raise on (usually few)."""
    return cells.filter(~F.coalesce(cell_ok(), F.lit(False))).select("notebook_id").distinct()


def explodable_notebooks(cells: DataFrame) -> DataFrame:
    """(notebook_id, ok) per notebook: every cell acceptable (A12's processed vs. error)."""
    return cells.groupBy("notebook_id").agg(F.bool_and(F.coalesce(cell_ok(), F.lit(False))).alias("ok"))


def explode_cells(cells: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """E1 on cell rows: kept kinds only, tagged content, default metadata ``{}``;
    a notebook with an unacceptable cell emits nothing (anti join on its id)."""
    kept = cells.filter(F.col("kind").isin(*CELL_KINDS))
    # The rejected ids are usually few but their count is only known after a
    # scan; AQE broadcasts them at runtime from the measured shuffle size, so
    # no extra pass is spent proving the bound up front.
    kept = kept.join(rejected_notebooks(cells), "notebook_id", "left_anti")
    return kept.select("notebook_id", "position", F.col("kind").alias("type"),
                       wrap_content(F.col("source"), F.col("kind")).alias("content"),
                       F.coalesce(F.col("metadata"), F.lit("{}")).alias("metadata"), *carry)


def cap_cells(cells: DataFrame, max_cells: int = MAX_CELLS, max_len: int = MAX_CELL_LENGTH) -> DataFrame:
    """D3: the first ``max_cells`` kept cells of each notebook, sources cut to ``max_len``.

    Salted top-k per notebook, levels planned from the largest notebook's
    cell count, so no ranking window holds more than a few thousand rows.
    """
    kept = cells.filter(F.col("kind").isin(*CELL_KINDS)).select("notebook_id", "position", "kind", "source")
    top = top_k_per_group(kept, ["notebook_id"], ["position"], max_cells, rows_per_group="auto")
    return top.select("notebook_id", (F.col("rank") - 1).alias("cell_index"), "kind",
                      F.substring("source", 1, max_len).alias("source"))


def error_samples(cells: DataFrame, n_notebooks: int = 5, n_errors: int = 3) -> DataFrame:
    """O2: the first ``n_notebooks`` invalid notebooks (by id) with their first
    ``n_errors`` cell errors (in cell order), joined with ','."""
    e = with_errors(cells).filter(F.col("error_kind").isNotNull()).select("notebook_id", "position", "error_kind")
    # Invalid = at least one error row; the first n ids come from a bounded top-n.
    ids = e.select("notebook_id").distinct().orderBy("notebook_id").limit(n_notebooks)
    first = top_k_per_group(e.join(F.broadcast(ids), "notebook_id", "left_semi"), ["notebook_id"],
                            ["position"], n_errors, rows_per_group="auto")
    # At most n_notebooks x n_errors rows remain: a small final aggregate.
    per = first.groupBy("notebook_id").agg(F.array_sort(F.collect_list(F.struct("rank", "error_kind"))).alias("_e"))
    return per.select("notebook_id", F.array_join(F.transform("_e", lambda x: x["error_kind"]), ",").alias("errors"))
