"""Lookup, coverage and foreign-key joins.

Dimension sides are broadcast only behind a row-count check
(`checked_broadcast`); otherwise Spark shuffles both sides on the key and AQE
splits skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import checked_broadcast


def dedupe_last(dim: DataFrame, key: str, order_col: str | None = None) -> DataFrame:
    """One row per key; with ``order_col`` the last row by it wins (dict semantics)."""
    if order_col is None:
        return dim.dropDuplicates([key])
    return (dim.groupBy(key).agg(F.max_by(F.struct(*[c for c in dim.columns if c != key]), F.col(order_col)).alias("_v"))
            .select(key, "_v.*"))


def lookup_join(df: DataFrame, dim: DataFrame, fk: str, key: str, value: str, out: str,
                default: str = "unknown", order_col: str | None = None) -> DataFrame:
    """J1 + P13: left lookup ``fk -> dim.key``, NULL/unmapped -> ``default``.

    Duplicate keys in ``dim``: with ``order_col`` the last row by it wins (as a
    dict built in file order: ``sources.files.source_position``); otherwise one of them is kept.
    """
    if order_col is not None:
        dim = dedupe_last(dim.select(key, value, order_col), key, order_col)
    d = dim.select(F.col(key).alias("_lk"), F.col(value).alias("_lv")).dropDuplicates(["_lk"])
    j = df.join(checked_broadcast(d), df[fk] == F.col("_lk"), "left")
    return j.withColumn(out, F.coalesce(F.col("_lv"), F.lit(default))).drop("_lk", "_lv")


def with_presence(df: DataFrame, other: DataFrame, key: str, other_key: str, flag: str = "present") -> DataFrame:
    """Every row of ``df`` with a flag telling whether ``other`` has its key."""
    keys = other.select(F.col(other_key).alias("_pk")).distinct().withColumn("_hit", F.lit(True))
    j = df.join(keys, df[key] == F.col("_pk"), "left")
    return j.withColumn(flag, F.coalesce(F.col("_hit"), F.lit(False))).drop("_pk", "_hit")


def missing_rows(df: DataFrame, other: DataFrame, key: str, other_key: str) -> DataFrame:
    """Rows of ``df`` whose key has no partner (NOT EXISTS)."""
    return df.join(other.select(F.col(other_key).alias(key)), on=key, how="left_anti")


def fk_orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Child rows whose non-null foreign key has no parent row."""
    return (child.filter(F.col(fk).isNotNull())
            .join(parent.select(F.col(pk).alias(fk)), on=fk, how="left_anti"))
