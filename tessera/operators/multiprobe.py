"""Approximate nearest neighbours by multi-probe hashing of random projections.

Each of ``num_tables`` tables projects a vector on PROJECTIONS random orthonormal directions and
cuts each of them into cells of one width; a bucket is a cell of all directions.  A query looks
into its own bucket and into every bucket that comes within a radius of its projection, nearest
first; candidates are compared by their exact distance.

Width and radius are fitted on a bounded sample (SAMPLE_ROWS rows, SAMPLE_QUERIES queries): the
radius is that within which the nearest of the tables' projections holds ``recall`` of the true
k nearest, the width the larger of the radius and SPREAD times the projections' deviation, so a
bucket within the radius is never further than the next cell in any direction and all of them
are found.  Where vectors lie in clusters few buckets are open; where they are spread evenly
most rows stay candidates, as no projection tells near from far: ``candidates`` says how many.

Every usable row is indexed, without its vector; candidates get theirs by joins on the ids.
Rows with a null id, or a vector that is null, of another length than the first usable one, or
that holds a null or non-finite component are not indexed; queries like that get no rows.
Ties go to the smaller id.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import l2_distance
from tessera.operators.topk import top_k_per_group
from tessera.session import scratch_path

SAMPLE_ROWS, SAMPLE_QUERIES = 20_000, 200
PROJECTIONS, SPREAD = 6, 0.25
#: rows that enumerate their buckets at once
STEP = 1_024
HASHES = "id bigint, tab int, bucket bigint"


@dataclass(frozen=True)
class Fit:
    """Projections (tables x dims x directions), cell width and probing radius."""

    directions: np.ndarray
    width: float
    radius: float


def _usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("id").isNotNull() & (F.size("v") > 0) & finite)


def _sample(rows: DataFrame, n: int, seed: int) -> np.ndarray:
    """Vectors of the ``n`` rows with the smallest hashed ids."""
    return np.array([r["v"] for r in rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(n).select("v").collect()], dtype=float)


def fit(corpus: DataFrame, queries: DataFrame, dims: int, k: int, num_tables: int, seed: int, recall: float) -> Fit:
    rng = np.random.default_rng(seed)
    directions = np.stack([np.linalg.qr(rng.normal(size=(dims, min(PROJECTIONS, dims))))[0] for _ in range(num_tables)])
    x, q = _sample(corpus, SAMPLE_ROWS, seed), _sample(queries, SAMPLE_QUERIES, seed)
    needed = [0.0]
    for row in q:
        d = ((x - row) ** 2).sum(axis=1)
        near = x[np.argsort(d, kind="stable")[:k]] - row
        needed += np.sqrt((np.einsum("nd,tdm->tnm", near, directions) ** 2).sum(axis=2)).min(axis=0).tolist()
    radius = float(np.quantile(needed, recall)) * (1 + 1e-9)
    spread = float(np.einsum("nd,tdm->tnm", x - x.mean(axis=0), directions).std())
    return Fit(directions, max(radius, SPREAD * spread) or 1.0, radius)


def _buckets(fitted: Fit, probes: bool):
    """mapInArrow body: (id, tab, bucket) of each row's own bucket, or of all that a query probes."""
    directions, width, radius = fitted.directions, fitted.width, fitted.radius
    m = directions.shape[2]
    odd = np.random.default_rng(m).integers(1, 2**62, size=m, dtype=np.int64) * 2 + 1  # cells to one number; rows that collide are only compared
    steps = np.array(list(itertools.product((-1, 0, 1), repeat=m)) if probes else [(0,) * m], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, STEP):
                part = batch.slice(start, STEP)
                ids = part.column(0).to_numpy()
                x = part.column(1).flatten().to_numpy().reshape(len(ids), -1)
                for t, along in enumerate(directions):
                    at = x @ along / width
                    cell = np.floor(at)
                    gaps = np.stack([at - cell, np.zeros_like(at), cell + 1 - at], axis=2) ** 2
                    far = sum(gaps[:, j, :][:, steps[:, j] + 1] for j in range(m))
                    row, step = np.nonzero(far <= (radius / width) ** 2 * (1 + 1e-9)) if probes else (np.arange(len(ids)), np.zeros(len(ids), dtype=int))
                    bucket = ((cell.astype(np.int64)[row] + steps[step]) * odd).sum(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(np.full(len(row), t, dtype=np.int32)), pa.array(bucket)], names=["id", "tab", "bucket"])
    return run


def candidates(corpus: DataFrame, queries: DataFrame, fitted: Fit) -> DataFrame:
    """(qid, vec_id): each row of ``corpus`` (id, v) that shares a probed bucket with a query, once."""
    index = corpus.mapInArrow(_buckets(fitted, False), HASHES).withColumnRenamed("id", "vec_id")
    probes = queries.mapInArrow(_buckets(fitted, True), HASHES).withColumnRenamed("id", "qid")
    return probes.join(index, ["tab", "bucket"]).select("qid", "vec_id").distinct()


def search(corpus: DataFrame, queries: DataFrame, k: int, num_tables: int = 4, seed: int = 42, recall: float = 0.98,
           corpus_id: str = "vec_id", corpus_vec: str = "embedding", query_id: str = "qid", query_vec: str = "qvec") -> DataFrame:
    """(qid, vec_id, dist): every candidate with its Euclidean distance, written once; ids must be unique."""
    spark = corpus.sparkSession
    c, q = _usable(corpus, corpus_id, corpus_vec), _usable(queries, query_id, query_vec)
    first = c.first()
    if first is None:
        return spark.createDataFrame([], "qid bigint, vec_id bigint, dist double")
    dims = len(first["v"])
    c, q = c.filter(F.size("v") == dims), q.filter(F.size("v") == dims)
    pairs = candidates(c, q, fit(c, q, dims, k, num_tables, seed, recall))
    compared = pairs.join(c.withColumnRenamed("id", "vec_id"), "vec_id").join(q.select(F.col("id").alias("qid"), F.col("v").alias("qv")), "qid")
    path = scratch_path(spark, "multiprobe")
    compared.select("qid", "vec_id", l2_distance("v", "qv").alias("dist")).write.parquet(path)
    return spark.read.schema("qid bigint, vec_id bigint, dist double").parquet(path)


def nearest(found: DataFrame, k: int) -> DataFrame:
    """(qid, vec_id, dist, rank): the ``k`` nearest of the candidates."""
    return top_k_per_group(found, ["qid"], ["dist", "vec_id"], k, rows_per_group="auto")


def knn_lsh(corpus: DataFrame, queries: DataFrame, k: int = 5, threshold: float | None = None, num_tables: int = 4, seed: int = 42,
            recall: float = 0.98, corpus_id: str = "vec_id", corpus_vec: str = "embedding", query_id: str = "qid",
            query_vec: str = "qvec") -> DataFrame:
    """The ``k`` nearest candidates of each query, those within ``threshold`` only where one is given."""
    found = search(corpus, queries, k, num_tables, seed, recall, corpus_id, corpus_vec, query_id, query_vec)
    return nearest(found if threshold is None else found.filter(F.col("dist") <= threshold), k)
