"""Blocks of points and the pairs of blocks that can hold two points within ε.

A group of at most ``block_rows`` points is one block.  A larger group gets up to PIVOTS of its
own points as pivots.  A point's ring is its distance to the first pivot in steps of at least ε,
its cell the nearest pivot; points of one (ring, cell) are cut into blocks of about ``block_rows``
rows by a hash of the id.  By the triangle inequality

    |x - y|  >=  | |x - p| - |y - p| |     for every pivot p,

so two points within ε lie in the same or in neighbouring rings, and two blocks need to meet only
if their ranges of distances come within ε of each other for every pivot.  Blocks meet by an
equi-join on (group, ring), which holds one row a block, not the points; a point is copied once
for each pair of blocks that its own block is left in.  Rounding never closes a pair.

Points with a null id, a null vector, or a null or non-finite component have no distances: they
are in no block, but count in a group's size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import l2_distance
from tessera.session import checked_broadcast, scratch_path

#: pivots of a group (three bits of a block's number), and rows among which each is looked for
PIVOTS, LOOKED_AT = 8, 64
#: rows of a block that grows with its group
LARGEST = 32_768
#: groups whose pivots are sent to every task: at most PIVOTS vectors each
STATE_ROWS = 1_000
SLACK = 1e-9


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, f"near-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _usable(points: DataFrame) -> DataFrame:
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return points.filter(F.col("id").isNotNull() & F.col("vec").isNotNull() & finite)


def _reach(eps: float, *sizes: Column) -> Column:
    """ε and what rounding may add to it at distances of that size."""
    return F.lit(eps * (1 + SLACK)) + F.lit(SLACK) * (1 + reduce(F.greatest, sizes))


def _pivots(points: DataFrame) -> DataFrame:
    """(grp, pivots): of each group, and each of PIVOTS slots of the hashed id, the point that a second
    hash puts first.  Only about LOOKED_AT points a slot take part; a slot without one has no pivot."""
    few = points.filter(F.pmod(F.xxhash64(F.lit(1), "id"), F.col("n")) < PIVOTS * LOOKED_AT)
    slots = few.groupBy("grp", F.pmod(F.xxhash64("id"), F.lit(PIVOTS)).alias("slot")).agg(F.min_by("vec", F.struct(F.xxhash64(F.lit(2), "id"), "id")).alias("p"))
    return slots.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "p"))), lambda s: s["p"]).alias("pivots"))


def placed(points: DataFrame, sizes: DataFrame, eps: float, block_rows: int) -> DataFrame:
    """(grp, id, vec, d, ring, blk): ``points`` (grp, id, vec) of the groups of ``sizes`` (grp, n, nb),
    their distances ``d`` to the group's pivots, and their block's number, which grows with the ring."""
    own = _usable(points).join(checked_broadcast(sizes), "grp")
    pivots = checked_broadcast(_written(_pivots(own), "pivots"), STATE_ROWS)
    none = F.array().cast("array<array<double>>")
    d = F.transform(F.coalesce("pivots", none), lambda p: l2_distance("vec", p))
    rows = _written(own.join(pivots, "grp", "left").select("grp", "id", "vec", "nb", d.alias("d")), "distances")

    spans = rows.groupBy("grp").agg(F.min(F.get("d", F.lit(0))).alias("lo"), F.max(F.get("d", F.lit(0))).alias("hi"), F.first("nb").alias("nb"))
    rings = F.ceil(F.col("nb") / F.lit(PIVOTS))
    spans = spans.select("grp", "lo", F.greatest(_reach(eps, F.col("hi"), F.lit(0.0)), (F.col("hi") - F.col("lo")) / rings).alias("width"))
    rows = rows.drop("nb").join(checked_broadcast(spans), "grp")
    ring = F.coalesce(F.floor((F.get("d", F.lit(0)) - F.col("lo")) / F.col("width")), F.lit(0)).cast("bigint")
    cell = F.coalesce(F.array_position("d", F.array_min("d")) - 1, F.lit(0)).cast("bigint")
    rows = rows.select("grp", "id", "vec", "d", ring.alias("ring"), cell.alias("cell"))
    parts = rows.groupBy("grp", "ring", "cell").agg(F.ceil(F.count("*") / F.lit(block_rows)).alias("parts"))
    blk = F.shiftleft("ring", 35) + F.shiftleft("cell", 32) + F.pmod(F.xxhash64("id"), F.col("parts"))
    return rows.join(checked_broadcast(parts), ["grp", "ring", "cell"]).select("grp", "id", "vec", "d", "ring", blk.alias("blk"))


def block_pairs(points: DataFrame, eps: float) -> DataFrame:
    """(grp, bi, bj), bi <= bj: the pairs of blocks of ``placed`` points that no pivot closes."""
    span = [f(F.get("d", F.lit(i))).alias(f"{name}{i}") for i in range(PIVOTS) for name, f in (("lo", F.min), ("hi", F.max))]
    blocks = _written(points.groupBy("grp", "ring", "blk").agg(*span), "blocks")

    def side(letter: str, ring: Column, block: str) -> DataFrame:
        return blocks.select("grp", ring.alias("ring"), F.col("blk").alias(block), *[F.col(f"{n}{i}").alias(f"{letter}_{n}{i}") for i in range(PIVOTS) for n in ("lo", "hi")])

    def open_to(i: int) -> Column:
        reach = _reach(eps, F.col(f"a_hi{i}"), F.col(f"b_hi{i}"))
        near = (F.col(f"a_lo{i}") - F.col(f"b_hi{i}") <= reach) & (F.col(f"b_lo{i}") - F.col(f"a_hi{i}") <= reach)
        return F.coalesce(near, F.lit(True))  # a pivot that the group does not have

    a, b = side("a", F.explode(F.array(F.col("ring"), F.col("ring") + 1)), "bi"), side("b", F.col("ring"), "bj")
    open_pairs = a.join(b, ["grp", "ring"]).filter((F.col("bi") <= F.col("bj")) & reduce(Column.__and__, map(open_to, range(PIVOTS))))
    return open_pairs.select("grp", "bi", "bj")


def folded(rows: DataFrame, block_rows: int) -> DataFrame:
    """(grp, blk, fold): neighbouring blocks of ``placed`` rows put together to about ``block_rows`` rows
    (never twice as many), for work on triples of blocks, which few blocks hold down."""
    n = rows.groupBy("grp", "blk").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("grp").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return n.select("grp", "blk", F.floor(before / F.lit(block_rows)).alias("fold"))


def in_triples(points: DataFrame, eps: float, block_rows: int) -> DataFrame:
    """(grp, id, vec, blk, bi, bj, bk): a copy of each of ``points`` (grp, id, vec) for every triple of
    folded blocks bi <= bj <= bk that it is in and whose pairs can all hold two points within ε."""
    sizes = _sizes(points, block_rows)
    zero = F.lit(0).cast("bigint")
    copies = _usable(points).join(checked_broadcast(sizes.filter("nb = 1").select("grp")), "grp").select(
        "grp", "id", "vec", *[zero.alias(c) for c in ("blk", "bi", "bj", "bk")])
    large = sizes.filter("nb > 1")
    if large.isEmpty():
        return copies
    rows = _written(placed(points, large, eps, block_rows), "placed")
    fold = _written(folded(rows, block_rows), "folds")
    open_pairs = block_pairs(rows, eps)
    for at in ("bi", "bj"):
        open_pairs = open_pairs.join(fold.select("grp", F.col("blk").alias(at), F.col("fold").alias(f"{at}_to")), ["grp", at])
    pairs = open_pairs.select("grp", F.least("bi_to", "bj_to").alias("bi"), F.greatest("bi_to", "bj_to").alias("bj")).distinct()
    pairs = _written(pairs, "pairs")
    ij, ik, jk = pairs, pairs.withColumnRenamed("bj", "bk"), pairs.select("grp", F.col("bi").alias("bj"), F.col("bj").alias("bk"))
    triples = ij.join(ik, ["grp", "bi"]).filter("bj <= bk").join(jk, ["grp", "bj", "bk"], "left_semi")
    meets = triples.select("grp", F.explode(F.array_distinct(F.array("bi", "bj", "bk"))).alias("blk"), "bi", "bj", "bk")
    own = rows.join(fold, ["grp", "blk"]).select("grp", "id", "vec", F.col("fold").alias("blk"))
    return copies.unionByName(own.join(meets, ["grp", "blk"]).select(copies.columns))


def _sizes(points: DataFrame, block_rows: int) -> DataFrame:
    sizes = points.groupBy("grp").agg(F.count("*").alias("n"))
    return _written(sizes.withColumn("nb", F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(block_rows))).cast("int")), "sizes")


def blocked(points: DataFrame, eps: float, block_rows: int, blocks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(copies, sizes) of ``points`` (grp, id, vec).

    copies: (grp, id, vec, blk, bi, bj), a row for each open pair of blocks (bi, bj) that the
    point's block ``blk`` is in.  sizes: (grp, n, nb), nb = 1 for a group of one block.

    With ``blocks`` the blocks of a large group grow up to LARGEST rows so that it has about
    that many: where no pair of blocks is closed, a point is copied once for each of them.
    """
    if blocks:
        most = points.groupBy("grp").count().agg(F.max("count")).first()[0] or 0
        block_rows = max(block_rows, min(LARGEST, -(-most // blocks)))
    sizes = _sizes(points, block_rows)
    zero = F.lit(0).cast("bigint")
    copies = _usable(points).join(checked_broadcast(sizes.filter("nb = 1").select("grp")), "grp").select(
        "grp", "id", "vec", zero.alias("blk"), zero.alias("bi"), zero.alias("bj"))
    large = sizes.filter("nb > 1")
    if large.isEmpty():
        return copies, sizes
    rows = _written(placed(points, large, eps, block_rows), "placed")
    pairs = block_pairs(rows, eps)
    meets = pairs.select("grp", F.explode(F.array_distinct(F.array("bi", "bj"))).alias("blk"), "bi", "bj")
    return copies.unionByName(rows.select("grp", "id", "vec", "blk").join(meets, ["grp", "blk"]).select(copies.columns)), sizes
