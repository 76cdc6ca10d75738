"""File sources: CSV with rule schema (S1-S3), notebook folders (S4, S17),
JSON-or-raw (S13), listings (S14), JSONL cells (S8), rules preview (V8).

Notebook files are read in one scan (``wholetext``, one row per file) and the
id comes from the file name via ``_metadata.file_path``; there is never a
per-row open.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import NA_TOKENS

CELL_SCHEMA = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("content", T.StringType()),
    T.StructField("metadata", T.StringType()), T.StructField("notebook_id", T.LongType()),
    T.StructField("title", T.StringType()), T.StructField("language", T.StringType()),
])


def source_position() -> Column:
    """Where a row stands in its files, for a column of a plain scan (before any shuffle): the file's
    path, where the part of it that a task reads starts, and the row's place in the task.  Of two
    rows of a source the later one has the larger value, however the scan is split; files count
    in the order of their paths."""
    return F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))


def read_csv_typed(spark: SparkSession, path: str, schema: T.StructType, corrupt_col: str = "_corrupt", position: str | None = None) -> DataFrame:
    """S1 + S2: CSV read as text, missing tokens -> NULL, then ``try_cast`` to the rule types.

    Values that do not fit their type become NULL and are flagged per row in
    ``bad_<column>`` so they can be counted rather than failing the job.  ``position`` names a
    column for ``source_position``, by which ``joins.lookup_join`` lets the last duplicate win.
    """
    text_schema = T.StructType([T.StructField(f.name, T.StringType(), True) for f in schema.fields])
    raw = (spark.read.option("header", True).option("mode", "PERMISSIVE").option("multiLine", False)
           .option("nullValue", "\u0000").schema(text_schema).csv(path))
    cols = []
    for f in schema.fields:
        txt = F.when(F.col(f.name).isin(*NA_TOKENS), F.lit(None)).otherwise(F.col(f.name))
        if isinstance(f.dataType, T.TimestampNTZType):
            from tessera.functions.temporal import coerce_timestamp
            typed = coerce_timestamp(txt)
        else:
            typed = txt.try_cast(f.dataType)
        cols.append(typed.alias(f.name))
        cols.append((txt.isNotNull() & typed.isNull()).alias(f"bad_{f.name}"))
    return raw.select(*cols, *([source_position().alias(position)] if position else []))


def require_columns(df: DataFrame, required) -> None:
    """Fail at plan time, before any job, if columns are missing."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}. Found columns: {df.columns}")


def missing_columns(df: DataFrame, required) -> list[str]:
    """P1 as a finding list (no exception)."""
    return [c for c in required if c not in df.columns]


def read_notebook_dir(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """(notebook_id, path, raw) for every ``{id}.json`` under ``path`` (any depth)."""
    df = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
          .text(path, wholetext=True))
    p = F.col("_metadata.file_path")
    return df.select(
        F.regexp_extract(p, r"([0-9]+)\.json$", 1).try_cast("bigint").alias("notebook_id"),
        p.alias("path"), F.col("value").alias("raw"))


def id_path(id_col, root: str = "", ext: str = ".json"):
    """Two-level layout ``{id div 1e6}/{(id div 1000) % 1000}/{id}.json``."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    exact = c.cast("decimal(20,0)")      # integer division without a double round trip
    return F.concat(F.lit(root), (exact / F.lit(1000000)).cast("bigint").cast("string"), F.lit("/"),
                    F.pmod((exact / F.lit(1000)).cast("bigint"), F.lit(1000)).cast("string"), F.lit("/"),
                    c.cast("string"), F.lit(ext))


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, modificationTime) without reading file bodies."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True)
            .load(path).select("path", "length", "modificationTime"))


def read_json_or_raw(spark: SparkSession, path: str) -> DataFrame:
    """Each file as (path, raw, parsed VARIANT or NULL)."""
    df = spark.read.text(path, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"),
                     F.try_parse_json("value").alias("parsed"))


def read_cells_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Cells JSONL with an explicit schema (no inference pass)."""
    return spark.read.schema(CELL_SCHEMA).json(path)


def rules_preview(spark: SparkSession, path: str, n_bytes: int = 2048) -> DataFrame:
    """V8: first 2 KB of the rules document, or 'NOT FOUND'."""
    try:
        df = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # only an absent path is a finding
            raise
        return spark.createDataFrame([("NOT FOUND",)], "data_constitution string")
    return df.select(F.substring("value", 1, n_bytes).alias("data_constitution"))
