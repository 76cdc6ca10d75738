"""Helpers shared by the training-data operators.

Rules that hold for every operator here:

* a row whose id is null is left out;
* an id that occurs on several rows counts once, with the smallest text
  (null text is the empty text);
* a null text is the empty text;
* only the id and text columns are read, so further columns of any name pass
  unnoticed; an empty table gives an empty result of the same columns.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import scratch_path

#: bytes of text that a Python task handles at a time, and rows or bytes of one result batch
SLICE_BYTES = 4 << 20
OUT_ROWS = 200_000

#: Spark removes a query's shuffle files when the query has ended
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

MULT = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1
INVERSE = pow(MULT, -1, 1 << 64)


def q(name: str) -> str:
    """A column name that may hold dots or back quotes."""
    return "`" + name.replace("`", "``") + "`"


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id bigint, text string), one row per id, text never null."""
    rows = df.select(F.col(q(id_col)).cast("bigint").alias("id"),
                     F.coalesce(F.col(q(text_col)).cast("string"), F.lit("")).alias("text")).filter("id is not null")
    twice = df.select(F.col(q(id_col)).cast("bigint").alias("id")).filter("id is not null").groupBy("id").count().filter("count > 1").select("id")
    if twice.isEmpty():  # ids only; the texts are not shuffled for it
        return rows
    single = rows.join(twice, "id", "left_anti")
    return single.unionByName(rows.join(twice, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")))


def one_row_per_id(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole rows, one per non-null id: the smallest text, then the smallest JSON of the row."""
    rows = df.filter(F.col(q(id_col)).isNotNull())
    twice = rows.groupBy(F.col(q(id_col)).alias("__id")).count().filter("count > 1").select("__id")
    if twice.isEmpty():
        return rows
    on = F.col(q(id_col)) == F.col("__id")
    first = F.min_by(F.struct(*[F.col(q(c)) for c in df.columns]),
                     F.struct(F.coalesce(F.col(q(text_col)), F.lit("")), F.to_json(F.struct(*[F.col(q(c)) for c in df.columns]))))
    some = rows.join(twice, on, "left_semi").groupBy(F.col(q(id_col))).agg(first.alias("__row")).select("__row.*")
    return rows.join(twice, on, "left_anti").unionByName(some)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the cluster's shared folder: lineage ends there, and the shuffle
    files that it took are removed at once, not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.select("*").write.parquet(path)  # a frame keeps the setting that it was made under
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, comp) for every end of a link; comp is the smallest id reachable.  An end linked only
    to itself has no row.

    In each round every end goes to the first of its neighbours and itself, in one fixed order by
    hash, and on to where that one goes; links are then drawn between the places reached, so a
    round works on the links still open, and stars and chains need few rounds.
    """
    first, second = F.col(a).alias("a"), F.col(b).alias("b")
    links = written(links.filter(F.col(a) != F.col(b)).select(first, second).distinct(), "links")
    steps: list[DataFrame] = []
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(F.xxhash64("b")).alias("h"), F.min_by("b", F.xxhash64("b")).alias("b"))
        up = written(near.select(F.col("a").alias("id"), F.when(F.col("h") < F.xxhash64("a"), F.col("b")).otherwise(F.col("a")).alias("up")), "ups")
        up = written(up.join(up.select(F.col("id").alias("up"), F.col("up").alias("top")), "up").select("id", F.col("top").alias("up")), "tops")
        steps.append(up)
        drawn = links.join(up.select(F.col("id").alias("a"), F.col("up").alias("x")), "a").join(up.select(F.col("id").alias("b"), F.col("up").alias("y")), "b")
        links = written(drawn.filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    if not steps:
        return links.select(F.col("a").alias("id"), F.col("b").alias("comp"))
    found = steps.pop()
    for step in reversed(steps):
        found = step.join(found.select(F.col("id").alias("up"), F.col("up").alias("top")), "up", "left").select("id", F.coalesce("top", "up").alias("up"))
    found = written(found, "roots")
    return found.join(found.groupBy("up").agg(F.min("id").alias("comp")), "up").select("id", "comp")


# --- inside Python tasks -------------------------------------------------------------------

def slices(batches: Iterable[pa.RecordBatch], size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in order, in pieces of about ``size`` bytes, so that a task holds few texts at once."""
    for batch in batches:
        rows, total = batch.num_rows, batch.nbytes
        step = max(1, rows if total <= size else rows * size // total)
        for start in range(0, rows, step):
            yield batch.slice(start, step)


def utf8(column: pa.Array) -> list[bytes]:
    return column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    return h * np.uint64(0x94D049BB133111EB)


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 14)
        for k, base in enumerate((MULT, INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def gram_hashes(words: np.ndarray, k: int | np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of the k words from each position (or each of ``at``, and then k may be an
    array as well); words are 64-bit word hashes."""
    n = len(words)
    if at is None and n < k:
        return np.empty(0, np.uint64)
    up, down = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words * up, out=total[1:])
    if at is None:
        return mix((total[k:] - total[:-k]) * down[: n - k + 1] + np.uint64(k * MULT & MASK))
    return mix((total[at + k] - total[at]) * down[at] + np.asarray(k, np.uint64) * np.uint64(MULT))


def minimisers(grams: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of ``width`` grams the (first) smallest: its positions, and for each the first
    run that chose it and how many runs did.  Equal runs choose the same place."""
    runs = len(grams) - width + 1
    if runs <= 0:
        e = np.empty(0, np.int64)
        return e, e, e
    chosen = np.lib.stride_tricks.sliding_window_view(grams, width).argmin(axis=1) + np.arange(runs)
    first = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
    return chosen[first], first, np.diff(np.append(first, runs))
