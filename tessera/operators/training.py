"""Training rows and preference pairs (N1, D10), both on exact ranks of distributed rows.

``numbered`` gives every row its place within its group without gathering a group: rows are
dealt by ranges of (group, order), each range counts its rows per group, and a row's place is
its place within the range and the counts of the ranges before.  A group of any size is spread
over the ranges; the windows run over one range of a group, and over its counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import scratch_path

#: ids below the first token's: padding, and a token that the vocabulary does not hold
PAD, UNKNOWN, FIRST = 0, 1, 2
#: a token's rows meet its id in so many tasks
SALTS = 16


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, f"training-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, groups: Sequence[str], order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """``df`` with every row's place from 1 within its group, null groups among them; ``order`` must tell
    rows of a group apart for the result to be the same in every run."""
    keys = {f"_o{i}": c for i, c in enumerate(order)}
    by = [F.col(g) for g in groups]
    ranged = df.repartitionByRange(*by, *keys.values()).withColumn("_range", F.spark_partition_id())
    ranged = _written(ranged, "ranges")  # a range stays the same however often it is read
    counts = ranged.groupBy(*groups, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = ranged.withColumn("_place", F.row_number().over(Window.partitionBy(*groups, "_range").orderBy(*keys.values())))
    same = F.col("_range") == F.col("_r")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return own.join(before, same).select(*df.columns, (F.col("_place") + F.col("_before")).alias(rank))


def preference_pairs(rows: DataFrame, task: str, ident: str, positive: Column, negative: Column, order: Sequence[Column]) -> DataFrame:
    """(task, rank, positive, negative): the i-th positive row of a task meets its i-th negative row.

    Rows that are neither (or whose test is null) are left out, and so are rows beyond the smaller
    side and rows without a task; a row that is both counts as positive.
    """
    side = F.when(positive, F.lit(True)).when(negative, F.lit(False))
    told = rows.withColumn("_side", side).filter(F.col("_side").isNotNull() & F.col(task).isNotNull())
    ranked = numbered(told, [task, "_side"], [*order, F.col(ident)])
    one = lambda keep, name: ranked.filter(F.col("_side") == keep).select(F.col(task).alias("task"), "rank", F.col(ident).alias(name))
    return one(True, "positive").join(one(False, "negative"), ["task", "rank"])


def tokens(text: Column) -> Column:
    """Lower-cased runs of characters other than ASCII white space."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([^\\x20\\x09-\\x0D]+)"), F.lit(1))


def vocabulary(docs: DataFrame, text_col: str = "text", size: int = 32_000, least: int = 1) -> DataFrame:
    """(token, n, id): ids from FIRST by falling count, then by token, of the ``size`` first tokens that occur ``least`` times."""
    counts = docs.select(F.explode(tokens(F.col(text_col))).alias("token")).groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    ranked = numbered(counts.withColumn("_all", F.lit(0)), ["_all"], [F.desc("n"), F.col("token")])
    return ranked.filter(F.col("rank") <= size).select("token", "n", (F.col("rank") + FIRST - 1).cast("int").alias("id"))


def training_rows(docs: DataFrame, words: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_length: int = 2048) -> DataFrame:
    """(id, n_tokens, input_ids, attention_mask, labels), each array of ``max_length``: the first
    tokens' ids, then padding; labels are the ids, as the trainer wants them.

    Tokens meet the vocabulary by an equi-join, a frequent token in SALTS tasks; a document is put
    together from at most ``max_length`` rows.
    Null and empty texts give padding only; rows with a null id are left out, ids are unique.
    """
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("all"))
    cut = rows.select("id", F.size("all").alias("n_tokens"), F.slice("all", 1, max_length).alias("first"))
    each = cut.select("id", F.posexplode("first").alias("at", "token"))
    salted = each.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    spread = words.select("token", F.col("id").alias("number"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    # every place of the cut text has a row: the vocabulary's id or UNKNOWN, put in order by place
    found = salted.join(spread, ["token", "salt"], "left").select("id", F.struct("at", F.coalesce("number", F.lit(UNKNOWN)).alias("number")).alias("pair"))
    known = found.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("pair")), lambda x: x["number"]).alias("found"))
    both = cut.select("id", "n_tokens", F.size("first").alias("kept")).join(known, "id", "left")
    ids = F.concat(F.coalesce("found", F.array().cast("array<int>")), F.array_repeat(F.lit(PAD), F.lit(max_length) - F.col("kept")))
    mask = F.concat(F.array_repeat(F.lit(1), F.col("kept")), F.array_repeat(F.lit(0), F.lit(max_length) - F.col("kept")))
    return both.select("id", "n_tokens", ids.alias("input_ids"), mask.alias("attention_mask")).withColumn("labels", F.col("input_ids"))
