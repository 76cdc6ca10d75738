"""A vector index on Parquet whose searches are exact and read only what can hold a hit.

``build`` assigns every row to the nearest of a bounded number of coarse centroids (fitted on a
bounded sample, see SAMPLE_ROWS) and stores rows of one cell in order of their distance to its
centroid, as blocks of at most BLOCK_ROWS rows: one Parquet row a block, with the smallest and
the largest distance in it.  The table is partitioned by cell.

For a query q, a cell's centroid c and a row x the triangle inequality gives

    |q - x|  >=  | |q - c| - |x - c| |

so a block can hold a hit only if its range of distances comes within the k-th distance found
so far of |q - c|.  ``search`` first reads the nearest cells that hold k rows, takes the k-th
distance from them, and then the blocks that it leaves open in the other cells; after that no
block is open.  Closed cells are pruned as partitions, closed blocks by the row groups' ranges.

Queries are never gathered: they meet blocks by an equi-join on the block's number, in groups of
at most about GROUP queries, and every pair of block and group is one numpy kernel.  The driver
holds the centroids (at most MAX_CELLS) and one range of distances for each cell.

Rows with a null id, and vectors that are null, of another length than the index, or hold a
null or non-finite component are not indexed; queries like that get no rows.  With cosine, zero
vectors are left out in the same way.  Ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.topk import top_k_per_group
from tessera.session import scratch_path

#: rows that the centroids are fitted on at most, rows a cell should have, and cells at most
SAMPLE_ROWS, CELL_ROWS, MAX_CELLS = 50_000, 2_000, 4_096
BLOCK_ROWS = 1_024
#: queries that meet a block in one kernel
GROUP = 1_024
#: pairs of a block and a group of queries that come to a task at once
BATCH_ROWS = 16
#: terms in the filter on ranges of distances
RANGES = 64
#: rounding never closes a block
SLACK = 1e-9

BLOCKS = "cell int, block bigint, n int, low double, high double, ids array<bigint>, distances array<double>, vectors array<double>"


def _usable(vector: str, dims: int | None = None) -> Column:
    good = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return good & (F.size(vector) == dims) if dims else good & (F.size(vector) > 0)


def _rows(df: DataFrame, id_col: str, vec_col: str, metric: str, dims: int | None = None) -> DataFrame:
    """(id, v) that can be compared; unit vectors for cosine."""
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & _usable("v", dims))
    if metric == "cosine":
        size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
        rows = rows.withColumn("_size", size).filter("_size > 0").select("id", F.transform("v", lambda x: x / F.col("_size")).alias("v"))
    return rows


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Distances of all rows to all centroids, without the cancellation of a matrix product near 0."""
    out = np.empty((len(x), len(centroids)))
    for start in range(0, len(x), 256):
        part = x[start:start + 256]
        for k in range(0, len(centroids), 256):
            out[start:start + 256, k:k + 256] = np.sqrt(((part[:, None, :] - centroids[None, k:k + 256]) ** 2).sum(axis=2))
    return out


def fit_centroids(rows: DataFrame, n: int, seed: int = 42) -> np.ndarray:
    """At most MAX_CELLS centroids of a sample of at most SAMPLE_ROWS rows (those with the smallest
    hashed ids), by the k-means of Spark ML."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    cells = max(1, min(MAX_CELLS, math.ceil(n / CELL_ROWS), SAMPLE_ROWS // 10))
    sample = rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(SAMPLE_ROWS).repartition(rows.sparkSession.sparkContext.defaultParallelism)
    model = KMeans(k=max(2, cells), maxIter=8, seed=seed).fit(sample.select(array_to_vector("v").alias("features")))
    return np.unique(np.array(model.clusterCenters()), axis=0)


def _assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, v, cell, distance)."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _distances(_matrix(batch.column(1), dims), centroids)
            cell = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(cell)), cell])], names=["id", "v", "cell", "distance"])
    return rows.mapInArrow(run, "id bigint, v array<double>, cell int, distance double")


def _blocks(assigned: DataFrame, dims: int, first_block: int) -> DataFrame:
    """Runs of at most BLOCK_ROWS rows of one cell in order of distance; a hot cell is dealt over many tasks."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = first_block + (TaskContext.get().partitionId() << 32)
        rest: pa.Table | None = None

        def given(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal number, rest
            table = table.combine_chunks()
            cell = table["cell"].to_numpy()
            edges = np.concatenate(([0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)])) if len(cell) else np.zeros(1, int)
            rest = None
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                for start in range(a, b, BLOCK_ROWS):
                    end = min(start + BLOCK_ROWS, b)
                    if end == len(cell) and not last:  # may go on in the next batch
                        rest = table.slice(start)
                        break
                    part = table.slice(start, end - start)
                    d = part["distance"].to_numpy()
                    lists = [pa.array([x], t) for x, t in ((part["id"].to_numpy(), pa.list_(pa.int64())), (d, pa.list_(pa.float64())),
                                                           (_matrix(part["v"].combine_chunks(), dims).ravel(), pa.list_(pa.float64())))]
                    yield pa.RecordBatch.from_arrays([pa.array([cell[start]], pa.int32()), pa.array([number]), pa.array([end - start], pa.int32()),
                                                      pa.array([d[0]]), pa.array([d[-1]]), *lists], names=["cell", "block", "n", "low", "high", "ids", "distances", "vectors"])
                    number += 1

        for batch in batches:
            table = pa.Table.from_batches([batch])
            yield from given(table if rest is None else pa.concat_tables([rest, table]), False)
        if rest is not None:
            yield from given(rest, True)

    order = ["cell", "distance", "id"]
    return assigned.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, BLOCKS)


def _write(blocks: DataFrame, path: str, mode: str) -> None:
    (blocks.write.mode(mode).option("parquet.block.size", 4 << 20).option("parquet.block.size.row.check.min", 1)
     .partitionBy("cell").parquet(f"{path}/blocks"))


def build(df: DataFrame, path: str, id_col: str = "vec_id", vec_col: str = "embedding", metric: str = "l2", seed: int = 42) -> None:
    """Writes the index of all rows of ``df`` (one dimension for all; that of most rows) to ``path``."""
    rows = _rows(df, id_col, vec_col, metric)
    by_size = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    spark = df.sparkSession
    dims, n = (by_size["dims"], by_size["count"]) if by_size else (1, 0)
    rows = rows.filter(F.size("v") == dims)
    centroids = fit_centroids(rows, n, seed) if n else np.zeros((0, dims))
    made = [(i, metric, [float(x) for x in c]) for i, c in enumerate(centroids)]
    _write(_blocks(_assigned(rows, centroids), dims, 0), path, "overwrite") if n else spark.createDataFrame([], BLOCKS).write.mode("overwrite").parquet(f"{path}/blocks")
    spark.createDataFrame(made, "cell int, metric string, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")


def add(df: DataFrame, path: str, id_col: str = "vec_id", vec_col: str = "embedding") -> None:
    """Appends the rows whose ids the index does not hold yet, so that a second run adds nothing."""
    spark = df.sparkSession
    centroids, metric = _centroids(spark, path)
    held = spark.read.parquet(f"{path}/blocks")
    first = (held.agg(F.max("block")).first()[0] + 1) if len(centroids) else 0
    rows = _rows(df, id_col, vec_col, metric, centroids.shape[1]).dropDuplicates(["id"])
    rows = rows.join(held.select(F.explode("ids").alias("id")), "id", "left_anti")
    _write(_blocks(_assigned(rows, centroids), centroids.shape[1], first), path, "append")


def _centroids(spark: SparkSession, path: str) -> tuple[np.ndarray, str]:
    made = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()  # at most MAX_CELLS
    return np.array([r.centroid for r in made]), made[0].metric if made else "l2"


def _open_blocks(index: DataFrame, cells: list[tuple[int, float, float]]) -> DataFrame:
    """Blocks of the cells whose distances come into the cell's range: partitions and row groups are
    pruned by a filter of at most RANGES terms, each over cells with similar ranges."""
    cells = sorted(cells, key=lambda x: (x[1], x[2]))
    step = max(1, math.ceil(len(cells) / RANGES))
    test = F.lit(False)
    for start in range(0, len(cells), step):
        some = cells[start:start + step]
        test = test | (F.col("cell").isin([int(c) for c, _, _ in some]) & (F.col("high") >= min(lo for _, lo, _ in some)) & (F.col("low") <= max(hi for _, _, hi in some)))
    return index.filter(F.col("cell").isin([int(c) for c, _, _ in cells]) & test)


PROBES = "qid bigint, q array<double>, cell int, at double, within double"


def _probes(queries: DataFrame, centroids: np.ndarray, sizes: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, first: bool) -> DataFrame:
    """(qid, q, cell, at: its distance to the cell's centroid, within: the distance that hits are within).

    ``first``: the nearest cells that hold k rows; otherwise the other cells that ``within`` leaves open."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, GROUP):
                part = batch.slice(start, GROUP)
                d = _distances(_matrix(part.column(1), dims), centroids)
                order = np.argsort(d, axis=1, kind="stable")
                before = np.cumsum(sizes[order], axis=1) - sizes[order]
                nearest = np.zeros(d.shape, bool)
                np.put_along_axis(nearest, order, before < k, axis=1)
                within = part.column(2).to_numpy(zero_copy_only=False)
                least = np.maximum(np.maximum(d - high, low - d), 0)
                chosen = nearest if first else ~nearest & (least <= (within * (1 + SLACK) + SLACK * (1 + d.max(axis=1)))[:, None])
                i, cell = np.nonzero(chosen & (sizes > 0))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(i)), part.column(1).take(pa.array(i)), pa.array(cell.astype(np.int32)),
                                                  pa.array(d[i, cell]), pa.array(within[i])], names=["qid", "q", "cell", "at", "within"])
    return queries.select("qid", "q", "within").mapInArrow(run, PROBES)


HITS = "qid bigint, vec_id bigint, dist double, tested bigint"


def _block_hits(x: np.ndarray, ids: np.ndarray, away: np.ndarray, q: np.ndarray, at: np.ndarray, within: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, distance) of all rows that can be among the k nearest of a block for its queries, and
    the rows compared per query.  A matrix product with a known rounding slack rules rows out;
    what is left is compared by its exact distance."""
    centre = x.mean(axis=0)
    y, p = x - centre, q - centre
    size = (p * p).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :]
    rough = size - 2.0 * (p @ y.T)
    slack = 64 * np.finfo(float).eps * size * x.shape[1]
    open_ = np.abs(at[:, None] - away[None, :]) <= (within * (1 + SLACK) + SLACK * (1 + at))[:, None]
    kth = np.partition(np.where(open_, rough + slack, np.inf), k - 1, axis=1)[:, k - 1] if k < len(ids) else np.full(len(q), np.inf)
    bound = np.minimum(kth, within * within * (1 + SLACK))
    i, j = np.nonzero(open_ & (rough - slack <= bound[:, None]))
    d = np.empty(len(i))
    for start in range(0, len(i), 1 << 16):
        a, b = i[start:start + (1 << 16)], j[start:start + (1 << 16)]
        d[start:start + (1 << 16)] = np.sqrt(((x[b] - q[a]) ** 2).sum(axis=1))
    return i, ids[j], d, open_.sum(axis=1)


def _nearest(qid: np.ndarray, ids: np.ndarray, d: np.ndarray, tested: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k nearest rows of each query; the first carries how many were compared."""
    order = np.lexsort((ids, d, qid))
    qid, ids, d, tested = qid[order], ids[order], d[order], tested[order]
    first = np.flatnonzero(np.concatenate(([True], qid[1:] != qid[:-1]))) if len(qid) else np.empty(0, int)
    long = np.diff(np.append(first, len(qid)))
    rank = np.arange(len(qid)) - np.repeat(first, long)
    sums = np.add.reduceat(tested, first) if len(first) else tested
    keep = rank < k
    return qid[keep], ids[keep], d[keep], np.where(rank == 0, np.repeat(sums, long), 0)[keep]


#: hits that a task holds before it keeps only the nearest of each query
HELD = 500_000


def _hits(pairs: DataFrame, dims: int, k: int) -> DataFrame:
    """The k nearest rows that a task has seen for each of its queries; ``tested`` counts the rows compared."""
    names = ["qid", "vec_id", "dist", "tested"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0
        for batch in batches:
            for row in range(batch.num_rows):
                ids, away, vectors, asked = (batch.column(i)[row].values for i in range(4))
                qid, at, within = (asked.field(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
                q = asked.field(1).flatten().to_numpy().reshape(-1, dims)
                i, hit, d, tested = _block_hits(vectors.to_numpy().reshape(-1, dims), ids.to_numpy(), away.to_numpy(), q, at, within, k)
                counted = np.zeros(len(i), np.int64)
                first = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1]))) if len(i) else np.empty(0, int)
                counted[first] = tested[i[first]]
                held.append(_nearest(qid[i], hit, d, counted, k))
                n += len(held[-1][0])
                if n > HELD:
                    held = [_nearest(*(np.concatenate(c) for c in zip(*held)), k)]
                    n = len(held[0][0])
                    if n > HELD // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], names=names)
                        held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _nearest(*(np.concatenate(c) for c in zip(*held)), k)], names=names)
    return pairs.select("ids", "distances", "vectors", "asked").mapInArrow(run, HITS)


def _round(spark: SparkSession, path: str, probes: DataFrame, catalog: DataFrame, dims: int, k: int) -> DataFrame:
    """Hits of the probes in the blocks that they leave open, written to the shared folder."""
    probes = _kept(probes, "probes")
    open_ = F.col("high") >= F.col("at") - F.col("within") - SLACK * (1 + F.col("at"))
    open_ = open_ & (F.col("low") <= F.col("at") + F.col("within") + SLACK * (1 + F.col("at")))
    # a probe is shuffled once for each block that it leaves open
    asks = probes.join(catalog, "cell").filter(open_).select("block", "qid", "q", "at", "within")
    groups = asks.groupBy("block").count().select("block", F.ceil(F.col("count") / GROUP).alias("groups"))
    asks = asks.join(groups, "block").withColumn("group", F.pmod(F.xxhash64("qid"), F.col("groups")))
    asked = asks.groupBy("block", "group").agg(F.collect_list(F.struct("qid", "q", "at", "within")).alias("asked"))
    ranges = probes.groupBy("cell").agg(F.min(F.col("at") - F.col("within") - SLACK * (1 + F.col("at"))).alias("lo"),
                                        F.max(F.col("at") + F.col("within") + SLACK * (1 + F.col("at"))).alias("hi")).collect()  # a row a cell
    index = _open_blocks(spark.read.parquet(f"{path}/blocks"), [tuple(r) for r in ranges])
    # a row holds a block and a group of queries, megabytes: a batch takes few of them
    batch, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    spark.conf.set(batch, str(BATCH_ROWS))
    try:
        return _kept(_hits(index.join(asked, "block"), dims, k), "hits")
    finally:
        spark.conf.set(batch, before)


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, f"index-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 5, query_id: str = "qid", query_vec: str = "qvec") -> DataFrame:
    """(qid, vec_id, dist, rank, tested): the k nearest rows of the index for every query, exactly;
    ``tested`` is the number of rows that were compared with the query."""
    centroids, metric = _centroids(spark, path)
    empty = spark.createDataFrame([], "qid bigint, vec_id bigint, dist double, rank bigint, tested bigint")
    if not len(centroids) or k < 1:
        return empty
    dims = centroids.shape[1]
    catalog = spark.read.parquet(f"{path}/blocks").select("cell", "block", "n", "low", "high")
    sizes, low, high = np.zeros(len(centroids), np.int64), np.full(len(centroids), np.inf), np.zeros(len(centroids))
    for r in catalog.groupBy("cell").agg(F.sum("n"), F.min("low"), F.max("high")).collect():  # a row a cell
        sizes[r[0]], low[r[0]], high[r[0]] = r[1:]
    rows = _rows(queries, query_id, query_vec, metric, dims).dropDuplicates(["id"]).select(F.col("id").alias("qid"), F.col("v").alias("q"))
    catalog = catalog.select("cell", "block", "low", "high")
    far = rows.withColumn("within", F.lit(float("inf")))
    near = _round(spark, path, _probes(far, centroids, sizes, low, high, k, True), catalog, dims, k)
    found = top_k_per_group(near.select("qid", "vec_id", "dist"), ["qid"], ["dist", "vec_id"], k, rows_per_group="auto")
    kth = found.filter(F.col("rank") == k).select("qid", F.col("dist").alias("within"))
    rest = rows.join(kth, "qid")  # fewer than k rows in all: every cell was read
    other = _round(spark, path, _probes(rest, centroids, sizes, low, high, k, False), catalog, dims, k)
    every = near.unionByName(other)
    best = top_k_per_group(every.select("qid", "vec_id", "dist"), ["qid"], ["dist", "vec_id"], k, rows_per_group="auto")
    tested = every.groupBy("qid").agg(F.sum("tested").alias("tested"))
    dist = F.col("dist") * F.col("dist") / 2 if metric == "cosine" else F.col("dist")
    return best.join(tested, "qid").select("qid", "vec_id", dist.alias("dist"), "rank", "tested")
