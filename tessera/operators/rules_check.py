"""Rule-driven checks over whole tables (P3, A3 rule mode, A13, A14, J9).

The rule table is configuration (a few dozen rows) and is read on the driver
to plan one aggregate pass per dataset; the data itself never leaves Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.joins import fk_orphans
from tessera.sources.rules import type_family

REPORT_SCHEMA = "dataset string, column_name string, check_name string, value bigint"


def _dataset_name(dataset: str) -> str:
    return dataset.rsplit(".", 1)[0]


def sample_for_rules(df: DataFrame, columns: list[dict], sample_size: int, seed: int = 42) -> DataFrame:
    """Rule-mode sample: length-weighted (TotalLines, LinesOfCode) if present, else uniform,
    keyed on the first unique column (or a hash of the whole row)."""
    from tessera.operators.sampling import sample_uniform, sample_weighted
    key = next((c["column"] for c in columns if c.get("is_unique") and c["column"] in df.columns), None)
    if key is None:
        df = df.withColumn("_row_key", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
        key = "_row_key"
    length = next((c for c in ("TotalLines", "LinesOfCode") if c in df.columns), None)
    out = (sample_weighted(df, sample_size, key, length, seed) if length else sample_uniform(df, sample_size, key, seed))
    return out.drop("_row_key") if key == "_row_key" else out


def rule_report(spark: SparkSession, tables: dict[str, DataFrame], rules: dict,
                only_missing: bool = True, sample_size: int | None = None) -> DataFrame:
    """Long report (dataset, column_name, check_name, value).

    checks: file_missing, missing_column, type_mismatch (P3), missing (A3,
    only n > 0 in rule mode), required_null (A14), duplicate_rows (A14,
    unique columns), fk_orphans (J9), fk_unresolved (key line without target).
    """
    static_rows = []
    parts = []
    for dataset, spec in rules.items():
        name = _dataset_name(dataset)
        if name not in tables:
            static_rows.append((dataset, None, "file_missing", 1))
            continue
        df = tables[name]
        if sample_size is not None:
            df = sample_for_rules(df, spec["columns"], sample_size)
        types = dict((f.name, f.dataType.simpleString()) for f in df.schema.fields)
        present = []
        for c in spec["columns"]:
            col = c["column"]
            if col not in types:
                static_rows.append((dataset, col, "missing_column", 1))
                continue
            present.append(c)
            if type_family(types[col]) != c["dtype"]:
                static_rows.append((dataset, col, "type_mismatch", 1))
        if present:
            # One scan per dataset: all null counts in one aggregate row, which
            # yields both the missing and the required-null report rows.
            agg = df.agg(*[F.count_if(F.col(f"`{c['column']}`").isNull()).alias(c["column"]) for c in present])
            entries = []
            for c in present:
                entries.append(F.struct(F.lit(c["column"]).alias("column_name"), F.lit("missing").alias("check_name"),
                                        F.col(f"`{c['column']}`").cast("bigint").alias("value")))
                if c["required"]:
                    entries.append(F.struct(F.lit(c["column"]).alias("column_name"),
                                            F.lit("required_null").alias("check_name"),
                                            F.col(f"`{c['column']}`").cast("bigint").alias("value")))
            rows = agg.select(F.inline(F.array(*entries)))
            keep = F.col("value") > 0
            if not only_missing:
                keep = keep | (F.col("check_name") == "missing")
            parts.append(rows.filter(keep).select(F.lit(dataset).alias("dataset"), "column_name", "check_name", "value"))
        for c in present:
            if c["is_unique"]:
                dup = (df.groupBy(c["column"]).count().filter(F.col("count") > 1)
                       .agg(F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("value"))
                       .select(F.lit(dataset).alias("dataset"), F.lit(c["column"]).alias("column_name"),
                               F.lit("duplicate_rows").alias("check_name"), "value"))
                parts.append(dup)
        for fk in spec["fks"]:
            target = tables.get(fk["fk_table"])
            if fk["fk_column"] is None or target is None or fk["column"] not in types:
                static_rows.append((dataset, fk["column"], "fk_unresolved", 1))
                continue
            orphans = (fk_orphans(df.select(fk["column"]), fk["column"], target, fk["fk_column"])
                       .agg(F.count(F.lit(1)).cast("bigint").alias("value"))
                       .select(F.lit(dataset).alias("dataset"), F.lit(fk["column"]).alias("column_name"),
                               F.lit("fk_orphans").alias("check_name"), "value"))
            parts.append(orphans)
    out = spark.createDataFrame(static_rows, REPORT_SCHEMA)
    for p in parts:
        out = out.unionByName(p)
    return out
