"""Node/edge memory tables (S16, G1-G5, D4) as DataFrames.

The reference keeps a tiny SQLite graph and answers one call at a time; here
the same operations are batch joins: many nodes stored per append, many
search terms and many source nodes answered per job.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import like_literal
from tessera.operators import postings
from tessera.operators.topk import smallest_n, top_k_per_group
from tessera.operators.training import numbered
from tessera.session import cut_lineage

NODE_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False), T.StructField("type", T.StringType(), False),
    T.StructField("content", T.StringType(), False), T.StructField("metadata", T.StringType(), True),
    T.StructField("created_at", T.TimestampNTZType(), True)])
EDGE_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False), T.StructField("source_id", T.LongType(), False),
    T.StructField("target_id", T.LongType(), False), T.StructField("relation", T.StringType(), False),
    T.StructField("metadata", T.StringType(), True), T.StructField("created_at", T.TimestampNTZType(), True)])


def empty_graph(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Empty node and edge tables (``clear`` = overwrite with these)."""
    return spark.createDataFrame([], NODE_SCHEMA), spark.createDataFrame([], EDGE_SCHEMA)


#: columns that tell nodes and edges apart
NODE_KEY = ("type", "content", "metadata")
EDGE_KEY = ("source_id", "target_id", "relation", "metadata")


def _appended(table: DataFrame | None, rows: DataFrame, key: tuple[str, ...], with_ids: bool, new_only: bool) -> DataFrame:
    """``table`` and ``rows`` below it.

    Rows without ids are numbered from the table's largest id on, by the md5 of their ``key``
    columns and then by time: the ids are dense, depend on the rows alone (not on how they are
    partitioned), and are written once, so that recomputing a lost task gives the same ones.
    With ``new_only`` a row whose ``key`` columns (nulls being equal) the table has already, or
    an earlier row of the batch (the smallest in the rest), is not appended, so a batch may be
    sent again.
    """
    if new_only:
        by = [F.md5(F.col(c).cast("string")).alias(f"_k{i}") for i, c in enumerate(key)]
        names = [f"_k{i}" for i in range(len(key))]
        rest = [c for c in rows.columns if c not in key]
        rows = rows.select("*", *by).groupBy(*names).agg(F.min(F.struct(*rest, *key)).alias("_row")).select(*names, "_row.*")
        if table is not None:
            known = table.select(*[c.alias(f"_t{i}") for i, c in enumerate(by)])
            same = functools.reduce(Column.__and__, [F.col(n).eqNullSafe(F.col(f"_t{i}")) for i, n in enumerate(names)])
            rows = rows.join(known, same, "left_anti")
        rows = rows.drop(*names)
    if not with_ids:
        base = 0 if table is None else table.agg(F.max("id")).first()[0] or 0
        order = [*[F.md5(F.col(c).cast("string")) for c in key], F.col("_time")]
        rows = numbered(rows, [], order, "_rank").withColumn("id", F.lit(base) + F.col("_rank"))
    rows = rows.select("id", *[c for c in rows.columns if c not in ("id", "_rank", "_time")])
    return rows if table is None else table.unionByName(rows)


def store_nodes(nodes: DataFrame | None, new: DataFrame, typ: str | Column, id_col: str | None = None,
                content_col: str = "content", metadata: Column | None = None,
                created_at: Column | None = None, new_only: bool = False) -> DataFrame:
    """G1 in batch: append rows as nodes.  Ids come from ``id_col`` or, if absent, continue
    densely after the largest id, the same in every run; ``new_only`` skips nodes already there."""
    rows = new.select(
        *([F.col(id_col).cast("bigint").alias("id")] if id_col else []), (typ if isinstance(typ, Column) else F.lit(typ)).alias("type"),
        F.col(content_col).cast("string").alias("content"),
        (metadata if metadata is not None else F.lit("{}")).alias("metadata"),
        (created_at if created_at is not None else F.localtimestamp().cast("timestamp_ntz")).alias("created_at"),
        *([] if id_col else [(created_at if created_at is not None else F.lit(None).cast("timestamp_ntz")).alias("_time")]))
    return _appended(nodes, rows, NODE_KEY, id_col is not None, new_only)


def link(edges: DataFrame | None, new: DataFrame, source_col: str, target_col: str, relation: str | Column,
         id_col: str | None = None, metadata: Column | None = None, created_at: Column | None = None,
         new_only: bool = False) -> DataFrame:
    """G2 in batch: append edges (foreign keys are not enforced, as in SQLite's default).
    Ids and ``new_only`` as for ``store_nodes``."""
    rows = new.select(
        *([F.col(id_col).cast("bigint").alias("id")] if id_col else []), F.col(source_col).cast("bigint").alias("source_id"),
        F.col(target_col).cast("bigint").alias("target_id"),
        (relation if isinstance(relation, Column) else F.lit(relation)).alias("relation"),
        (metadata if metadata is not None else F.lit("{}")).alias("metadata"),
        (created_at if created_at is not None else F.localtimestamp().cast("timestamp_ntz")).alias("created_at"),
        *([] if id_col else [(created_at if created_at is not None else F.lit(None).cast("timestamp_ntz")).alias("_time")]))
    return _appended(edges, rows, EDGE_KEY, id_col is not None, new_only)


def retrieve(nodes: DataFrame, query: str, k: int = 5) -> DataFrame:
    """Nodes whose content contains ``query`` (ASCII case-insensitive), newest first."""
    hits = nodes.filter(F.col("content").ilike(like_literal(query)))
    return smallest_n(hits, [F.desc_nulls_last("created_at"), F.desc("id")], k)


def retrieve_batch(nodes: DataFrame, terms: DataFrame, k: int = 5, term_col: str = "term",
                   stored: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """G3 for a table of search terms: top-k newest matching nodes per term.

    Terms meet nodes through the postings of their rarest gram (``operators.postings``; ``stored``
    are those of ``postings.load``, otherwise they are made for the terms' grams).  Matching ids
    are ranked per term with the salted top-k before the winners' columns are read.
    """
    found = postings.matches(nodes, terms.select(F.col(term_col).alias("term")), stored, carry=("created_at",))
    # Matches are written once (reliable checkpoint): the ranking below reads
    # them twice (largest-term count, then the salted levels it plans).
    found = cut_lineage(found)
    order = [F.desc_nulls_last("created_at"), F.desc("id")]
    best = top_k_per_group(found, ["term"], order, k, rows_per_group="auto", salt_cols=["term", "id"])
    return best.select("term", "id", "rank").join(nodes, "id")


def neighbors(nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None,
              relation: str | None = None, source_col: str = "source_id") -> DataFrame:
    """Outgoing 1-hop neighbours with edge attributes; dangling edges drop out."""
    e = edges
    if relation is not None:
        e = e.filter(F.col("relation") == relation)
    if sources is not None:
        e = e.join(sources.select(F.col(source_col).alias("source_id")).distinct(), "source_id", "left_semi")
    e = e.select("source_id", F.col("target_id").alias("id"), "relation", F.col("metadata").alias("edge_metadata"))
    return e.join(nodes.select("id", "type", "content", "metadata"), "id", "inner")


def cap_newest(table: DataFrame, n: int) -> DataFrame:
    """Keep the newest ``n`` rows (nodes 1000, edges 5000 by configuration)."""
    return smallest_n(table, [F.desc_nulls_last("created_at"), F.desc("id")], n)
