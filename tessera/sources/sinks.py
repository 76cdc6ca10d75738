"""Sinks: cells JSONL (S7), report JSON (S9), vector table (S10/S11),
put-if-absent (S12), signature store (S15)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_cells_jsonl(cells: DataFrame, path: str, partition_by: str | None = None, mode: str = "overwrite") -> None:
    w = cells.write.mode(mode)
    if partition_by:
        w = w.partitionBy(partition_by)
    w.json(path)


def write_report_json(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per report row; booleans stay booleans."""
    report.select(F.to_json(F.struct(*report.columns)).alias("value")).write.mode(mode).text(path)


def write_vectors(vectors: DataFrame, path: str, buckets_col: str | None = None, mode: str = "append") -> None:
    """(id, content, metadata, embedding) as Parquet, appended."""
    w = vectors.write.mode(mode)
    if buckets_col:
        w = w.partitionBy(buckets_col)
    w.parquet(path)


def save_if_absent(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write only when nothing exists at ``path``."""
    df.write.mode("ignore").format(fmt).save(path)


def save_signatures(sigs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """(domain, betti map, diagram array<struct>) as Parquet."""
    sigs.write.mode(mode).parquet(path)
