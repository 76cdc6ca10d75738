"""Notebook JSON -> cells (E1), preprocess (E2), draft normalisation.

A notebook is one row of raw JSON text.  Cells are reached through VARIANT
(`try_parse_json` + `try_variant_get`), so malformed input becomes NULL
instead of failing the job.  Texts that are JSON but that VARIANT can't hold
(very long strings or files, repeated keys) are read by `from_json`; their
metadata keeps the order of its keys.  `source` may be a string or a list of strings;
the list form is joined with '' first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.jsonfn import from_json_sql, is_json, is_json_sql
from tessera.functions.text import CELL_KINDS, wrap_content

CELL_STRUCT = (
    "struct(try_variant_get(c, '$.cell_type', 'string') AS kind, "
    "coalesce(array_join(try_variant_get(c, '$.source', 'array<string>'), ''), "
    "try_variant_get(c, '$.source', 'string')) AS source, "
    "coalesce(to_json(try_variant_get(c, '$.metadata', 'variant')), '{}') AS metadata)"
)


def parsed_cells(raw_col: str = "raw") -> Column:
    """array<struct<kind, source, metadata>> of a raw notebook text (NULL if no cells)."""
    return cells_of_variant(f"try_parse_json(`{raw_col}`)", f"`{raw_col}`")


def _large_cell(field: str, type_: str) -> str:
    return from_json_sql("c", f"{field} {type_}") + f".{field}"


LARGE_CELL = (
    f"struct({_large_cell('cell_type', 'string')} AS kind, "
    f"CASE WHEN {_large_cell('source', 'map<string,string>')} IS NULL THEN "
    f"coalesce(array_join({_large_cell('source', 'array<string>')}, ''), {_large_cell('source', 'string')}) END AS source, "
    f"coalesce({_large_cell('metadata', 'string')}, '{{}}') AS metadata)"
)


def cells_of_variant(variant_sql: str, raw_sql: str) -> Column:
    """The cells array of a notebook, given as VARIANT (NULL where it can't hold it) and as text."""
    small = f"transform(try_variant_get({variant_sql}, '$.cells', 'array<variant>'), c -> {CELL_STRUCT})"
    large = f"transform({from_json_sql(raw_sql, 'cells array<string>')}.cells, c -> {LARGE_CELL})"
    return F.expr(f"coalesce({small}, CASE WHEN {is_json_sql(raw_sql)} THEN {large} END)")


def explodable(cells_col: str = "_cells") -> Column:
    """A notebook yields rows only if every cell has a kind and kept kinds have a source."""
    kinds = ", ".join(f"'{k}'" for k in CELL_KINDS)
    return F.expr(f"forall(`{cells_col}`, c -> c.kind IS NOT NULL AND (c.kind NOT IN ({kinds}) OR c.source IS NOT NULL))")


def explodable_notebooks(notebooks: DataFrame, id_col: str = "notebook_id", raw_col: str = "raw") -> DataFrame:
    """(id, ok): the text parses and its cell loop would not raise.

    The text is parsed once in its own projection; the verdict reads the
    parsed value twice, so the optimizer keeps the two projections apart.
    """
    kinds = ", ".join(f"'{k}'" for k in CELL_KINDS)
    v = notebooks.select(F.col(id_col), F.col(raw_col).alias("_raw"), F.try_parse_json(F.col(raw_col)).alias("_v"))
    cells = cells_of_variant("_v", "_raw")
    ok = F.forall(F.coalesce(cells, F.array()), lambda c: c["kind"].isNotNull()
                  & (~c["kind"].isin(*CELL_KINDS) | c["source"].isNotNull()))
    return v.select(F.col(id_col), ((F.col("_v").isNotNull() | is_json("_raw")) & ok).alias("ok"))


def rejected_notebooks(notebooks: DataFrame, id_col: str = "notebook_id", raw_col: str = "raw") -> DataFrame:
    """(notebook_id, reason): one row for each notebook of which ``explode_cells`` has no row."""
    staged = notebooks.select(F.col(id_col).alias("notebook_id"), F.col(raw_col).isNull().alias("_none"),
                              is_json(raw_col).alias("_json"), parsed_cells(raw_col).alias("_cells"))
    reason = (F.when(F.col("_cells").isNull(), F.when(F.col("_none"), "no_text").when(~F.col("_json"), "not_json").otherwise("no_cells_array"))
              .when(F.exists("_cells", lambda c: c["kind"].isNull()), "missing_cell_type")
              .when(F.exists("_cells", lambda c: c["kind"].isin(*CELL_KINDS) & c["source"].isNull()), "missing_source")
              .when(~F.exists("_cells", lambda c: c["kind"].isin(*CELL_KINDS)), "no_kept_cell"))
    return staged.select("notebook_id", reason.alias("reason")).filter(F.col("reason").isNotNull())


def explode_cells(notebooks: DataFrame, id_col: str = "notebook_id", raw_col: str = "raw",
                  carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per kept cell: (id, position, type, content, metadata, *carry).

    Position is the cell's index in the notebook; non code/markdown cells are
    dropped; a notebook with a cell lacking ``cell_type`` (or a kept cell
    lacking ``source``) emits nothing, as it errors in the reference.

    Each notebook text is parsed once: the rejection is folded into the
    generator's input (a rejected notebook explodes a NULL array), and the
    only filter sits above the generator, so nothing is pushed back onto the
    parse.  ``posexplode_outer`` keeps the optimizer from inferring a
    size filter that would re-parse the text below.
    """
    staged = notebooks.select(F.col(id_col).alias("notebook_id"), *carry, parsed_cells(raw_col).alias("_cells"))
    keep = F.when(F.coalesce(explodable("_cells"), F.lit(False)), F.col("_cells"))
    cells = staged.select("notebook_id", *carry, F.posexplode_outer(keep).alias("position", "_c"))
    return (cells
            .filter(F.col("_c.kind").isin(*CELL_KINDS))
            .select("notebook_id", "position",
                    F.col("_c.kind").alias("type"),
                    wrap_content(F.col("_c.source"), F.col("_c.kind")).alias("content"),
                    F.col("_c.metadata").alias("metadata"),
                    *carry))


def notebooks_from_turns(turns: DataFrame, id_col: str = "conv_id", pos_col: str = "turn",
                         role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Test-table adapter: conversation turns -> one raw notebook JSON per conversation.

    user -> markdown cell, assistant -> code cell, anything else keeps its role
    as the (rejected) cell kind; cell metadata records the role.
    """
    kind = (F.when(F.col(role_col) == "user", F.lit("markdown"))
            .when(F.col(role_col) == "assistant", F.lit("code"))
            .otherwise(F.col(role_col)))
    cell = F.struct(F.col(pos_col).alias("p"), kind.alias("cell_type"),
                    F.col(role_col).alias("role"), F.col(text_col).alias("source"))
    grouped = turns.groupBy(F.col(id_col).alias("notebook_id")).agg(F.array_sort(F.collect_list(cell)).alias("_t"))
    nb = F.struct(
        F.transform("_t", lambda t: F.struct(t["cell_type"].alias("cell_type"), F.create_map(F.lit("role"), t["role"]).alias("metadata"),
                                             t["source"].alias("source"))).alias("cells"),
        F.create_map(F.lit("kernel"), F.lit("python3")).alias("metadata"),
        F.lit(4).alias("nbformat"), F.lit(4).alias("nbformat_minor"))
    return grouped.select("notebook_id", F.to_json(nb).alias("raw"))


def normalise_drafts(drafts: DataFrame, task_col: str, text_col: str) -> DataFrame:
    """Draft text -> notebook JSON: keep valid JSON, else wrap as one markdown cell."""
    fallback = F.to_json(F.struct(
        F.array(F.struct(F.lit("markdown").alias("cell_type"), F.create_map().cast("map<string,string>").alias("metadata"),
                         F.array(F.concat(F.lit("# "), F.col(task_col), F.lit("\n\n"), F.col(text_col))).alias("source"))).alias("cells"),
        F.create_map(F.lit("kernelspec"), F.create_map(
            F.lit("display_name"), F.lit("Python 3"), F.lit("language"), F.lit("python"),
            F.lit("name"), F.lit("python3"))).alias("metadata"),
        F.lit(4).alias("nbformat"), F.lit(4).alias("nbformat_minor")))
    ok = is_json(text_col)
    return drafts.withColumn("notebook_json", F.when(ok, F.col(text_col)).otherwise(fallback)) \
                 .withColumn("is_fallback", ~ok)
