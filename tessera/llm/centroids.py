"""Centroid clustering of integer vectors by an equal-average equal-variance search.

Every component x becomes floor(scale * x).  Centroids start as the vectors whose ids have the
smallest hashes; each round assigns all vectors and moves every centroid to the exact floor of
its vectors' mean.

A vector's nearest centroid is looked for among the centroids sorted by component mean,
outward from the vector's own mean.  With means m and deviations v (the length of x - m),

    |x - c|^2  >=  d (m_x - m_c)^2 + (v_x - v_c)^2

so the scan of a vector ends where the first term alone passes the best distance found (the
centroids further out are worse still), and a centroid is passed over where both terms pass
it.  What is left is compared by its exact integer distance; equal distances go to the smaller
number.  Vectors of a batch scan side by side.

Results by case: rows with a null id are left out; an id that occurs on several rows counts
once, with the smallest vector; vectors that are null, of another length, or hold a null, a
non-finite component or one of 2^27 or more after scaling (whose squares pass a long) are left
out; repeated vectors under different ids are assigned alike; with fewer vectors than
centroids all of them are centroids; no vectors give an empty result.  Columns of other names
are not read.

A round is one map over the vectors and one sum of at most k rows a task; the driver holds the
k centroids only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import q, slices, written

#: components from here on are not squared and summed exactly in a long
LIMIT = 1 << 27


def integers(column: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the vectors kept, their integer components) of a column of lists."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == dims)
    if not len(at):
        return at, np.empty((0, dims), np.int64)
    flat = pc.list_flatten(column.take(pa.array(at)))
    x = np.floor(scale * flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims))  # null: nan
    good = (np.abs(x) < LIMIT).all(axis=1)
    return at[good], x[good].astype(np.int64)


class Search:
    """The nearest of a set of centroids, for many vectors side by side."""

    def __init__(self, centroids: np.ndarray):
        self.order = np.lexsort((np.arange(len(centroids)), centroids.sum(axis=1)))
        self.centroids = centroids[self.order]
        self.sums, self.deviations = self.features(self.centroids)

    @staticmethod
    def features(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sums = x.sum(axis=1)
        return sums, np.sqrt(((x - (sums / x.shape[1])[:, None]) ** 2).sum(axis=1))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number, squared distance) for each row of ``x``, and how many distances were computed."""
        n, d = x.shape
        k = len(self.centroids)
        sums, deviations = self.features(x)
        best, who = np.full(n, np.iinfo(np.int64).max), np.full(n, k)
        up = np.searchsorted(self.sums, sums)
        down = up - 1
        rows, compared = np.arange(n), 0
        while len(rows):
            # the side whose centroid has the nearer mean; a side that is used up is infinitely far
            above = np.where(up[rows] < k, np.abs(self.sums[np.minimum(up[rows], k - 1)] - sums[rows]).astype(float), np.inf)
            below = np.where(down[rows] >= 0, np.abs(self.sums[np.maximum(down[rows], 0)] - sums[rows]).astype(float), np.inf)
            rises = above <= below
            gap = np.where(rises, above, below)
            least = best[rows] * (1 + 1e-9)  # rounding never rejects
            open_ = np.isfinite(gap) & (gap * gap / d <= least)
            rows, rises, gap, least = rows[open_], rises[open_], gap[open_], least[open_]
            if not len(rows):
                break
            at = np.where(rises, up[rows], down[rows])
            up[rows[rises]] += 1
            down[rows[~rises]] -= 1
            apart = np.abs(deviations[rows] - self.deviations[at]) - 1e-9 * (deviations[rows] + self.deviations[at])
            near = gap * gap / d + np.maximum(apart, 0) ** 2 <= least
            some, at = rows[near], at[near]
            exact = ((x[some] - self.centroids[at]) ** 2).sum(axis=1)
            compared += len(some)
            number = self.order[at]
            better = (exact < best[some]) | ((exact == best[some]) & (number < who[some]))
            best[some[better]], who[some[better]] = exact[better], number[better]
        return who, best, compared


def vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector array<double>): one row an id."""
    rows = df.select(F.col(q(id_col)).cast("bigint").alias("id"), F.col(q(vector_col)).cast("array<double>").alias("vector")).filter("id is not null")
    twice = rows.groupBy("id").count().filter("count > 1").select("id")
    if twice.isEmpty():  # ids only; the vectors are not shuffled for it
        return rows
    return rows.join(twice, "id", "left_anti").unionByName(rows.join(twice, "id", "left_semi").groupBy("id").agg(F.min("vector").alias("vector")))


def kept_vectors(rows: DataFrame, dims: int, scale: int) -> DataFrame:
    """(id, x array<bigint>) of the vectors that can be clustered."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            at, x = integers(part.column(1), dims, scale)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, dims, dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), lists], names=["id", "x"])
    return rows.mapInArrow(run, "id bigint, x array<bigint>")


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes, in the order of the hashes."""
    start = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    chosen = rows.select(start.alias("h"), "x").orderBy("h").limit(k).collect()
    return np.array([r.x for r in chosen], dtype=np.int64)


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Every centroid at the floor of the mean of the vectors nearest to it."""
    k, dims = centroids.shape
    names = ["cluster", "n"] + [f"s{i}" for i in range(dims)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, total, count = Search(centroids), np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for part in slices(batches):
            x = part.column(0).flatten().to_numpy().reshape(-1, dims)
            who = search.nearest(x)[0]
            np.add.at(total, who, x)
            count += np.bincount(who, minlength=k)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some]), *(pa.array(total[some, i]) for i in range(dims))], names=names)

    schema = ", ".join(f"{n} bigint" for n in names)
    sums = rows.select("x").mapInArrow(run, schema).groupBy("cluster").agg(*(F.sum(F.col(n).cast("decimal(38,0)")).alias(n) for n in names[1:]))
    out = centroids.copy()
    for r in sums.collect():  # at most k rows
        out[r[0]] = [int(s) // int(r[1]) for s in r[2:]]
    return out


def centroid_clusters(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, rounds: int = 3,
                      dims: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """(id, cluster int, distance long, cluster_inertia long, inertia long, centroid array<bigint>) for
    every vector kept, after ``rounds`` moves of the centroids and one more assignment."""
    rows = written(kept_vectors(vectors(df, id_col, vector_col), dims, scale), "integers")
    spark = df.sparkSession
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], "id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    for _ in range(rounds):
        centroids = moved(rows, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        for part in slices(batches):
            who, best, _ = search.nearest(part.column(1).flatten().to_numpy().reshape(-1, dims))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(who.astype(np.int32)), pa.array(best)], names=["id", "cluster", "distance"])

    assigned = written(rows.mapInArrow(run, "id bigint, cluster int, distance bigint"), "assigned")
    wide = T.DecimalType(38, 0)
    sums = {r[0]: int(r[1]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast(wide))).collect()}  # at most k rows
    facts = [(c, sums.get(c, 0), sum(sums.values()), [int(x) for x in centroids[c]]) for c in range(len(centroids))]
    each = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    return assigned.join(F.broadcast(each), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
