"""Exact top-k building blocks that never sort a whole hot group in one task.

* ``smallest_n``: the n rows with the smallest ordering key over a whole table.
  Small n uses ``orderBy().limit()`` (TakeOrderedAndProject: each task keeps
  n rows, one merge of n * tasks rows).  Large n cuts the key range with an
  exact histogram so only the boundary slice is ranked.
* ``top_k_per_group``: k smallest per group via two window passes; the first
  runs per (group, salt) so a group holding a third of the table is split
  across ``salt_buckets`` tasks, the second ranks at most k * salt_buckets
  candidates per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TAKE_ORDERED_MAX = 200_000
DEFAULT_SALT_BUCKETS = 32


def _cols(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def smallest_n(df: DataFrame, order_cols: Sequence, n: int, key_col: str | None = None,
               take_ordered_max: int = TAKE_ORDERED_MAX, grid: int = 1024, _depth: int = 0) -> DataFrame:
    """Exactly ``n`` rows (or all, if fewer) with the smallest ``order_cols``.

    ``key_col`` (a numeric column, the first element of ``order_cols``) enables
    the large-n path; without it ``orderBy().limit()`` is used.
    """
    order = _cols(order_cols)
    if n <= 0:
        return df.limit(0)
    if n <= take_ordered_max or key_col is None or _depth >= 4:
        return df.orderBy(*order).limit(n)
    # Large n: exact histogram over approximate cut points of the key.
    probs = [i / grid for i in range(1, grid)]
    cuts = df.agg(F.percentile_approx(F.col(key_col).cast("double"), probs, 10 * grid).alias("c")).first()["c"]
    cuts = sorted(set(cuts or []))
    if not cuts:
        return df.orderBy(*order).limit(n)
    arr = "array({})".format(",".join(repr(float(c)) for c in cuts))
    bucket = F.expr(f"array_position(transform({arr}, x -> x >= cast(`{key_col}` AS double)), true)")
    tagged = df.withColumn("_bucket", F.when(bucket == 0, F.lit(len(cuts) + 1)).otherwise(bucket))
    counts = sorted(tuple(r) for r in tagged.groupBy("_bucket").count().collect())
    running, boundary, below = 0, None, 0
    for b, c in counts:
        if running + c >= n:
            boundary, below = b, running
            break
        running += c
    if boundary is None:
        return df
    full = tagged.filter(F.col("_bucket") < boundary).drop("_bucket")
    edge = tagged.filter(F.col("_bucket") == boundary).drop("_bucket")
    rest = smallest_n(edge, order_cols, n - below, key_col=key_col, take_ordered_max=take_ordered_max,
                      grid=grid, _depth=_depth + 1)
    return full.unionByName(rest)


def top_k_per_group(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence, k,
                    salt_col: Column | None = None, salt_buckets: int = DEFAULT_SALT_BUCKETS,
                    rank_col: str = "rank", rows_per_group: int | str | None = None,
                    window_rows: int = 4096, salt_cols: Sequence[str] | None = None) -> DataFrame:
    """k smallest rows per group by ``order_cols`` (add an id for a total order).

    ``k`` may be an int or a Column (per-group quota).  Output keeps the input
    columns plus ``rank_col`` (1-based).  With ``rows_per_group`` (an upper
    estimate, or ``"auto"`` to measure the largest group first) and an int
    ``k``, enough salted levels are planned that no window sees more than
    about ``window_rows`` rows of one group.
    """
    order = _cols(order_cols)
    kcol = F.lit(k) if isinstance(k, int) else k
    groups = list(group_cols)
    if rows_per_group == "auto":
        # Size of the largest group, from one partial/final count aggregate.
        biggest = df.groupBy(*groups).count().agg(F.max("count")).first()[0]
        rows_per_group = int(biggest or 0)
    # Salt source: any deterministic choice is correct; a small unique-per-group
    # key keeps hashing cheap (never whole text rows).  Named order columns
    # plus the group qualify; otherwise every hashable column is used.
    if salt_cols:
        hashable = [F.col(c) for c in salt_cols]
    elif all(isinstance(c, str) for c in order_cols):
        hashable = [F.col(c) for c in list(order_cols) + groups]
    else:
        hashable = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    levels: list[int] = []
    if rows_per_group is not None and isinstance(k, int):
        rows = rows_per_group
        window = max(window_rows, 4 * k)   # each level then shrinks a group at least fourfold
        while rows > window:
            s = -(-rows // window)
            levels.append(s)
            rows = k * s
    elif salt_col is not None:
        levels = [0]
    else:
        levels = [salt_buckets]
    cur = df
    for i, s in enumerate(levels):
        salt = salt_col if (s == 0 and salt_col is not None) else F.pmod(F.xxhash64(F.lit(i), *hashable), F.lit(s))
        cur = cur.withColumn("_salt", salt)
        w1 = Window.partitionBy(*groups, "_salt").orderBy(*order)
        cur = cur.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= kcol).drop("_salt", "_r1")
    w2 = Window.partitionBy(*groups).orderBy(*order)
    return cur.withColumn(rank_col, F.row_number().over(w2).cast("bigint")).filter(F.col(rank_col) <= kcol)
