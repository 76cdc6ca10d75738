"""The rows with the smallest keys of each group, by refining histograms of the key.

For each group the key of its quota-th row is looked for: the group's interval of keys is cut
into BUCKETS parts of equal width, the rows of each part are counted, the part that holds the
quota-th row becomes the interval (from its smallest to its largest key), and so on until the
interval is one key.  Rows of that key are told apart by their ids in the same way.  Counting
is a partial and a final aggregate over (group, part), so neither a large group nor a large
quota meets in one task, and every quota takes the same path; windows run over the at most
BUCKETS counts of a group only.  After the first round only the rows inside the intervals are
read, about one in BUCKETS.

Keys are numbers and never null; ids are unique within a group (rows that share key and id are
taken or left together).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import BROADCAST_MAX_ROWS, fits, scratch_path

BUCKETS = 1024
ALL = "_all"


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, f"threshold-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _with_state(rows: DataFrame, state: DataFrame, groups: list[str]) -> DataFrame:
    """A row a group: sent to the rows where their number is within the broadcast bound."""
    return rows.join(F.broadcast(state) if fits(state, BROADCAST_MAX_ROWS) else state, groups)


def _part(column: str) -> Column:
    """Which part of the group's interval a value lies in; never decreases with the value."""
    exact = "decimal(38,0)" if column == "_id" else "double"  # ids may lie further apart than a long
    value, lo, hi = (F.col(c).cast(exact) for c in (column, "lo", "hi"))
    return F.least(F.lit(BUCKETS - 1), F.floor((value - lo).cast("double") / (hi - lo).cast("double") * BUCKETS)).cast("int")


def _refined(rows: DataFrame, state: DataFrame, groups: list[str], column: str) -> tuple[DataFrame, DataFrame]:
    """(rows inside, state) once every open group's interval of ``column`` is one value."""
    value = F.col(column)
    inside = rows
    while True:
        open_ = state.filter("lo < hi")
        if open_.isEmpty():
            return inside, state
        per = (_with_state(inside, open_, groups).filter((value >= F.col("lo")) & (value <= F.col("hi"))).withColumn("_part", _part(column))
               .groupBy(*groups, "_part").agg(F.count("*").alias("c"), F.min(value).alias("a"), F.max(value).alias("b"), F.first("need").alias("need")))
        parts = per.withColumn("upto", F.sum("c").over(Window.partitionBy(*groups).orderBy("_part"))).filter((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("c") < F.col("need")))
        moved = parts.select(*groups, F.col("c").alias("n"), F.col("a").alias("lo"), F.col("b").alias("hi"), (F.col("need") - F.col("upto") + F.col("c")).alias("need"))
        state = _written(moved.unionByName(state.filter("lo >= hi")), "state")
        inside = _written(_with_state(inside, state, groups).filter((value >= F.col("lo")) & (value <= F.col("hi"))).select(rows.columns), "inside")


def cuts(rows: DataFrame, groups: list[str], quota: int | Column) -> DataFrame:
    """(groups, cut_key, cut_id): the last row to take of each group of ``rows`` (groups, _key, _id);
    a null cut takes the whole group.  A quota below 1 gives no cut row."""
    quota = F.lit(quota) if isinstance(quota, int) else quota
    sizes = rows.groupBy(*groups).agg(F.count("*").alias("n"), F.min("_key").alias("lo"), F.max("_key").alias("hi"))
    sizes = _written(sizes.withColumn("need", F.least(quota.cast("bigint"), "n")).filter("need > 0"), "sizes")
    whole = sizes.filter("need = n").select(*groups, F.lit(None).cast("double").alias("cut_key"), F.lit(None).cast("bigint").alias("cut_id"))
    inside, by_key = _refined(rows, sizes.filter("need < n"), groups, "_key")
    found = _with_state(inside, by_key.select(*groups, "need", F.col("lo").alias("cut_key")), groups).filter(F.col("_key") == F.col("cut_key"))
    ties = found.groupBy(*groups, "cut_key").agg(F.count("*").alias("n"), F.min("_id").alias("lo"), F.max("_id").alias("hi"), F.first("need").alias("need"))
    ties = _written(ties, "ties")
    tied = found.select(*groups, "_key", "_id")
    _, by_id = _refined(tied, ties.drop("cut_key"), groups, "_id")
    cut = by_id.select(*groups, F.col("hi").alias("cut_id")).join(ties.select(*groups, "cut_key"), groups).select(*groups, "cut_key", "cut_id")
    return whole.unionByName(cut)


def within(df: DataFrame, cut: DataFrame, groups: list[str], key: Column, ident: Column) -> DataFrame:
    """``df`` with ``_taken``: whether the row comes up to its group's cut."""
    marked = df.join(F.broadcast(cut.withColumn("_known", F.lit(True))) if fits(cut, BROADCAST_MAX_ROWS) else cut.withColumn("_known", F.lit(True)), groups, "left")
    up_to = F.col("cut_key").isNull() | (key < F.col("cut_key")) | ((key == F.col("cut_key")) & (ident <= F.col("cut_id")))
    return marked.withColumn("_taken", F.coalesce(F.col("_known"), F.lit(False)) & up_to).drop("_known", "cut_key", "cut_id")


def smallest(df: DataFrame, n: int, key: Column, ident: Column) -> DataFrame:
    """The ``n`` rows with the smallest (key, id)."""
    rows = _written(df.select(F.lit(0).alias(ALL), key.cast("double").alias("_key"), ident.cast("bigint").alias("_id")), "keys")
    cut = cuts(rows, [ALL], n).first()  # one row
    if cut is None:
        return df.limit(0)
    if cut["cut_key"] is None:
        return df
    value, own = key.cast("double"), ident.cast("bigint")
    return df.filter((value < cut["cut_key"]) | ((value == cut["cut_key"]) & (own <= cut["cut_id"])))
