"""Exact-size sampling: uniform (M1), length-weighted (M2), stratified (M3).

All draws use a per-row md5 key, so they are deterministic, identical in
Spark and DuckDB.  The rows with the smallest keys are found by ``operators.threshold``:
one path for every n and any stratum, without ordering rows.  Rows with equal keys (equal
ids) go by the id, an id that is not a whole number by its hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.hashing import hashkey, weighted_key
from tessera.operators import threshold

WEIGHT_FLOOR = 1e-3  # added to every length so empty rows can still be drawn


def key(id_col: str, seed: int = 42, weight_col: str | None = None) -> Column:
    if weight_col is None:
        return hashkey(id_col, seed).cast("double")
    w = F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)) + F.lit(WEIGHT_FLOOR)
    return weighted_key(id_col, w, seed)


def _ident(df: DataFrame, id_col: str) -> Column:
    whole = df.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    return F.col(id_col).cast("bigint") if whole else F.xxhash64(id_col)


def sample_uniform(df: DataFrame, n: int | None, id_col: str, seed: int = 42) -> DataFrame:
    """Exactly min(n, rows) rows without replacement; ``None`` keeps all rows."""
    if n is None:
        return df
    return threshold.smallest(df, n, key(id_col, seed), _ident(df, id_col))


def sample_weighted(df: DataFrame, n: int | None, id_col: str, weight_col: str, seed: int = 42) -> DataFrame:
    """Weighted draw without replacement, weight = length + 1e-3 (null length = 0)."""
    if n is None:
        return df
    return threshold.smallest(df, n, key(id_col, seed, weight_col), _ident(df, id_col))


def sample_stratified(df: DataFrame, n: int | None, id_col: str, stratum_col: str, seed: int = 42) -> DataFrame:
    """Quota ``max(1, n // strata)`` per stratum, then a uniform top-up.

    NULL counts as a stratum for the quota but contributes no rows, as in the
    reference.  The result can exceed ``n`` when strata outnumber ``n``.
    """
    if n is None:
        return df
    by = "_stratum"
    own, ident = key(id_col, seed), _ident(df, id_col)
    rows = threshold._written(df.select(F.col(stratum_col).alias(by), own.alias("_key"), ident.alias("_id")), "keys")
    counts = rows.groupBy(by).count()
    stats = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("rows"), F.count("*").alias("strata")).first()
    if stats["rows"] <= n:
        return df
    if stats["strata"] <= 1:
        return sample_uniform(df, n, id_col, seed)
    quota = max(1, n // stats["strata"])
    cut = threshold.cuts(rows.filter(F.col(by).isNotNull()), [by], quota)
    n_chosen = counts.filter(F.col(by).isNotNull()).agg(F.sum(F.least(F.lit(quota), "count"))).first()[0] or 0
    marked = threshold.within(rows, cut, [by], F.col("_key"), F.col("_id"))
    more = None
    if n_chosen < n:
        rest = threshold._written(marked.filter("not _taken").select(F.lit(0).alias(threshold.ALL), "_key", "_id"), "rest")
        more = threshold.cuts(rest, [threshold.ALL], n - n_chosen).first()  # one row
    out = threshold.within(df.withColumn(by, F.col(stratum_col)), cut, [by], own, ident)
    if more is None:
        taken = F.col("_taken")
    elif more["cut_key"] is None:
        taken = F.lit(True)
    else:
        taken = F.col("_taken") | (own < more["cut_key"]) | ((own == more["cut_key"]) & (ident <= more["cut_id"]))
    return out.filter(taken).select([F.col(f"`{c}`") for c in df.columns])


