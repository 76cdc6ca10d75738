"""Deterministic per-row random keys, identical in Spark and DuckDB.

``hashkey(id, seed)`` = first 13 hex digits (52 bits) of md5("id:seed").
The same expression in DuckDB is
``('0x' || substr(md5(concat_ws(':', id, seed)), 1, 13))::UBIGINT``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 52


def hashkey(id_col, seed: int = 42) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    hexd = F.substring(F.md5(F.concat_ws(":", c.cast("string"), F.lit(str(seed)))), 1, 13)
    return F.conv(hexd, 16, 10).cast("bigint")


def uniform01(id_col, seed: int = 42) -> Column:
    """(h + 0.5) / 2^52, strictly inside (0, 1)."""
    return (hashkey(id_col, seed).cast("double") + F.lit(0.5)) / F.lit(float(2 ** HASH_BITS))


def weighted_key(id_col, weight: Column, seed: int = 42) -> Column:
    """Efraimidis-Spirakis key: the n smallest -ln(u)/w are a weighted draw without replacement."""
    return -F.log(uniform01(id_col, seed)) / weight
