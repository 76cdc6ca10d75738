"""Every column of a table, or of every table of a folder, in one profile.

Numeric columns: count, mean, standard deviation (n - 1), extremes, quartiles.  Time columns:
first, last, quartiles.  Text and boolean columns: distinct values, the most frequent value and
how often it occurs (ties: the smallest md5).  Arrays, maps and structs: count only.  Every
column has its count and its missing values (NULL; a NaN is a value).

Moments and quartiles come from one aggregate a table.  Quartiles are read from mergeable KLL
sketches of SKETCH_K items: a value reported for rank p has a true rank within RANK_ERROR of p
in 99 of 100 cases, whatever the number of rows (NaNs are not in them); sketches draw random
bits, so quartiles may differ within that error from run to run.  Texts are counted by
(column, md5), so neither texts nor lists of values are shuffled; only the most frequent value's
hash of each column comes to the driver (a row a column), and a second scan of the text columns
finds its text.

A table without rows has a row for each column, with count 0 and nulls.  A table without columns
has no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.temporal import micros_to_ntz, ntz_to_micros
from tessera.session import scratch_path

#: items a level of a sketch; error of a rank: 2.296 / k ** 0.9723 (99 % confidence)
SKETCH_K = 1600
RANK_ERROR = 2.296 / SKETCH_K ** 0.9723
QUARTILES = (0.25, 0.5, 0.75)

#: numeric statistics, time statistics
NUMBERS = ("mean", "std", "min", "max", "p25", "p50", "p75")
TIMES = ("first", "last", "t25", "t50", "t75")


def _col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def kind(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return "text" if isinstance(dtype, (T.StringType, T.BooleanType, T.CharType, T.VarcharType)) else "other"


def _micros(name: str, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(_col(name))
    return ntz_to_micros(_col(name).cast("timestamp_ntz"))


def _measures(i: int, field: T.StructField) -> list[Column]:
    """Aggregates of column number ``i``, named by the number (names may clash or hold any character)."""
    out = [F.count(_col(field.name)).alias(f"n{i}")]
    if kind(field.dataType) == "numeric":
        x = _col(field.name).cast("double")
        out += [F.avg(x).alias(f"mean{i}"), F.stddev_samp(x).alias(f"std{i}"), F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}"),
                F.kll_sketch_agg_double(x, F.lit(SKETCH_K)).alias(f"sketch{i}")]
    elif kind(field.dataType) == "datetime":
        x = _micros(field.name, field.dataType)
        out += [F.min(x).alias(f"first{i}"), F.max(x).alias(f"last{i}"), F.kll_sketch_agg_bigint(x, F.lit(SKETCH_K)).alias(f"sketch{i}")]
    return out


def _entry(i: int, field: T.StructField) -> Column:
    """One column's struct from the aggregated row."""
    k, n = kind(field.dataType), F.col(f"n{i}")
    stats = {c: F.lit(None).cast("double") for c in NUMBERS} | {c: F.lit(None).cast("timestamp_ntz") for c in TIMES}
    if k == "numeric":
        filled = F.kll_sketch_get_n_double(f"sketch{i}") > 0
        stats |= {c: F.col(f"{c}{i}") for c in ("mean", "std", "min", "max")}
        stats |= {f"p{int(100 * p)}": F.when(filled, F.kll_sketch_get_quantile_double(f"sketch{i}", F.lit(p))) for p in QUARTILES}
    elif k == "datetime":
        stats |= {c: micros_to_ntz(F.col(f"{c}{i}")) for c in ("first", "last")}
        stats |= {f"t{int(100 * p)}": micros_to_ntz(F.when(n > 0, F.kll_sketch_get_quantile_bigint(f"sketch{i}", F.lit(p)))) for p in QUARTILES}
    return F.struct(F.lit(field.name).alias("column_name"), F.lit(k).alias("kind"), n.alias("count"), (F.col("n_rows") - n).alias("n_missing"),
                    *[stats[c].alias(c) for c in (*NUMBERS, *TIMES)])


def measures(df: DataFrame, table: str) -> DataFrame:
    """(table_name, column_name, kind, count, n_missing, NUMBERS, TIMES): one aggregate over ``df``."""
    fields = df.schema.fields
    row = df.agg(F.count("*").alias("n_rows"), *[a for i, f in enumerate(fields) for a in _measures(i, f)])
    return row.select(F.lit(table).alias("table_name"), F.inline(F.array(*[_entry(i, f) for i, f in enumerate(fields)])))


def _hashes(df: DataFrame, table: str, names: list[str]) -> DataFrame:
    """(table_name, column_name, h): a row for every value that is not null."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.md5(_col(c).cast("string")).alias("h")) for c in names])
    return df.select(F.lit(table).alias("table_name"), F.inline(pairs)).filter("h is not null")


def frequent_values(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, n_distinct, freq, top) of the text and boolean columns that have values."""
    spark = next(iter(tables.values())).sparkSession
    schema = "table_name string, column_name string, n_distinct bigint, freq bigint, top string"
    names = {t: [f.name for f in df.schema.fields if kind(f.dataType) == "text"] for t, df in tables.items()}
    names = {t: own for t, own in names.items() if own}
    if not names:
        return spark.createDataFrame([], schema)
    counts = reduce(DataFrame.unionByName, [_hashes(tables[t], t, own) for t, own in names.items()])
    counts = counts.groupBy("table_name", "column_name", "h").agg(F.count("*").alias("n"))
    best = counts.groupBy("table_name", "column_name").agg(
        F.count("*").alias("n_distinct"), F.max("n").alias("freq"), F.min_by("h", F.struct((-F.col("n")).alias("n"), "h")).alias("h"))
    path = scratch_path(spark, "frequent-values")
    best.write.parquet(path)
    best = spark.read.schema(best.schema).parquet(path)
    hashes = {(r["table_name"], r["column_name"]): r["h"] for r in best.select("table_name", "column_name", "h").collect()}  # a row a column
    texts = []
    for t, own in names.items():
        if known := [c for c in own if (t, c) in hashes]:
            text = {c: _col(c).cast("string") for c in known}
            row = tables[t].agg(*[F.any_value(F.when(F.md5(text[c]) == hashes[t, c], text[c]), F.lit(True)).alias(f"top{i}") for i, c in enumerate(known)])
            texts.append(row.select(F.lit(t).alias("table_name"), F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"top{i}").alias("top")) for i, c in enumerate(known)]))))
    if not texts:
        return spark.createDataFrame([], schema)
    return best.drop("h").join(F.broadcast(reduce(DataFrame.unionByName, texts)), ["table_name", "column_name"])  # a row a column


def profile_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """A row for every column of every table: ``measures`` and ``frequent_values``; column names of a
    table must differ."""
    tables = {t: df for t, df in tables.items() if df.columns}
    rows = reduce(DataFrame.unionByName, [measures(df, t) for t, df in tables.items()])
    return rows.join(F.broadcast(frequent_values(tables)), ["table_name", "column_name"], "left")  # a row a column
