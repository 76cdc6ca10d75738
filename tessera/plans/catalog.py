"""Registered queries: one Spark plan and (where SQL can say it) one DuckDB oracle each.

Each query takes (spark, sf_dir) and returns a DataFrame over the whole
tables; computed columns carry the same alias on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def _load_all() -> None:
    # Import for side effects: each module registers its queries.
    from tessera.plans import q_validation, q_profile, q_sampling, q_graph, q_vectors, q_topology, q_training, q_misc  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(ORACLE)


def r6(c) -> F.Column:
    """Round doubles to 6 places so engines agree despite summation order."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)
