"""Rule-document parser (S6) and rule -> Spark schema mapping.

Line forms (one dataset per ``## name.ext`` section):
    - Column: type (required|nullable, unique, FK to Other.csv)
    **Foreign Keys:**
      - Column → Table.Column        (target column may be absent)

The document is read as one text (``wholetext``) and split into numbered
lines, so line order is exact; the section name is carried forward with
``last_value(ignoreNulls)`` over the line number.  Rule documents are small
configuration files, never data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rule type -> Spark SQL type.
RULE_TYPES = {"int64": "bigint", "float64": "double", "string": "string", "datetime": "timestamp_ntz", "bool": "boolean"}

SECTION_RE = r"^## +`?([^`]+?\.(csv|parquet|json))`?\s*$"
COLUMN_RE = r"^- ([A-Za-z0-9_]+):\s*([A-Za-z0-9_]+)\s*(\((.*)\))?"
FK_RE = r"^\s+- ([A-Za-z0-9_]+)\s*→\s*([A-Za-z0-9_]+)(\.([A-Za-z0-9_]+))?"


def rule_lines(spark: SparkSession, path: str) -> DataFrame:
    doc = spark.read.text(path, wholetext=True)
    return doc.select(F.col("_metadata.file_path").alias("_file"),
                      F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))


def parse_rules(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, kind, column, dtype, required, nullable, is_unique, fk_table, fk_column, line_no)."""
    lines = rule_lines(spark, path)
    sect = F.regexp_extract("line", SECTION_RE, 1)
    lines = lines.withColumn("_sect", F.when(sect != "", sect))
    # A section ends at the next ## heading of any kind.
    lines = lines.withColumn("_head", F.col("line").startswith("## "))
    w = Window.partitionBy("_file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("_hid", F.sum(F.col("_head").cast("int")).over(w))
    w2 = Window.partitionBy("_file", "_hid").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("dataset", F.last("_sect", ignorenulls=True).over(w2)).filter(F.col("dataset").isNotNull())
    col_name = F.regexp_extract("line", COLUMN_RE, 1)
    notes = F.lower(F.regexp_extract("line", COLUMN_RE, 4))
    fk_col = F.regexp_extract("line", FK_RE, 1)
    columns = lines.filter(col_name != "").select(
        "dataset", F.lit("column").alias("kind"), col_name.alias("column"),
        F.regexp_extract("line", COLUMN_RE, 2).alias("dtype"),
        notes.contains("required").alias("required"), notes.contains("nullable").alias("nullable"),
        notes.rlike(r"(^|[ ,])unique").alias("is_unique"),
        F.when(notes.contains("fk to "), F.regexp_extract(notes, r"fk to ([a-z0-9_]+)", 1)).alias("fk_table"),
        F.lit(None).cast("string").alias("fk_column"), "line_no")
    fks = lines.filter(fk_col != "").select(
        "dataset", F.lit("fk").alias("kind"), fk_col.alias("column"), F.lit(None).cast("string").alias("dtype"),
        F.lit(None).cast("boolean").alias("required"), F.lit(None).cast("boolean").alias("nullable"),
        F.lit(None).cast("boolean").alias("is_unique"),
        F.regexp_extract("line", FK_RE, 2).alias("fk_table"),
        F.when(F.regexp_extract("line", FK_RE, 4) != "", F.regexp_extract("line", FK_RE, 4)).alias("fk_column"),
        "line_no")
    return columns.unionByName(fks)


def rules_dict(rules: DataFrame) -> dict:
    """Small driver-side view of a parsed rule table: {dataset: {"columns": [...], "fks": [...]}}."""
    out: dict = {}
    for r in rules.orderBy("line_no").collect():
        d = out.setdefault(r["dataset"], {"columns": [], "fks": []})
        if r["kind"] == "column":
            d["columns"].append(r.asDict())
        else:
            d["fks"].append(r.asDict())
    return out


def schema_for(columns: list[dict]) -> T.StructType:
    """Spark schema from rule columns (unknown types read as string)."""
    fields = []
    for c in columns:
        spark_type = RULE_TYPES.get(c["dtype"], "string")
        fields.append(T.StructField(c["column"], T._parse_datatype_string(spark_type), True))
    return T.StructType(fields)


def type_family(spark_type: str) -> str:
    t = spark_type.lower()
    if t in ("bigint", "int", "smallint", "tinyint"):
        return "int64"
    if t in ("double", "float") or t.startswith("decimal"):
        return "float64"
    if t.startswith("timestamp") or t == "date":
        return "datetime"
    if t == "boolean":
        return "bool"
    if t == "string":
        return "string"
    return t
