import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import knn, vector_index
from tessera.session import scratch_path


def clustered(seed, n, dims, centres, spread, offset=0.0):
    r = np.random.default_rng(seed)
    c = r.normal(size=(centres, dims)) * 10 + offset
    return c[r.integers(centres, size=n)] + r.normal(size=(n, dims)) * spread


def table(spark, vectors, first=0):
    rows = [(first + i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)


def asked(emb, every=7):
    return emb.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))


def rows(df):
    return {(r.qid, r["rank"]): (r.vec_id, round(r.dist, 7)) for r in df.collect()}


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(vector_index, "CELL_ROWS", 100)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_equal_to_scan_and_reads_little(spark, small_blocks, metric):
    data = clustered(1, 3000, 12, 20, .5)
    data[40:80] = data[40]  # ties
    emb = table(spark, data)
    path = scratch_path(spark, "vi")
    vector_index.build(emb, path, metric=metric)
    got = vector_index.search(spark, path, asked(emb), k=6).cache()
    assert rows(got) == rows(knn.knn_exact(emb, asked(emb), k=6, metric=metric))
    share = got.filter("rank = 1").agg(F.avg("tested")).first()[0] / 3000
    assert share < .2  # twenty groups: a query reads its own


def test_odd_rows_and_add(spark, small_blocks):
    data = clustered(2, 600, 4, 5, 1.0, offset=1e4)
    odd = spark.createDataFrame([(None, [1.0] * 4), (9001, None), (9002, [1.0] * 3), (9003, [1.0, None, 1.0, 1.0]), (9004, [float("nan")] * 4), (9005, [])], "vec_id long, embedding array<double>")
    emb = table(spark, data)
    path = scratch_path(spark, "vi")
    vector_index.build(emb.unionByName(odd), path)
    more = table(spark, clustered(3, 300, 4, 3, 9.0), first=5000)
    for _ in range(2):  # the second run adds nothing
        vector_index.add(more.unionByName(emb), path)
    whole = emb.unionByName(more)
    assert spark.read.parquet(f"{path}/blocks").agg(F.sum("n")).first()[0] == 900
    q = asked(whole, 11).unionByName(odd.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec")))
    assert rows(vector_index.search(spark, path, q, k=4)) == rows(knn.knn_exact(whole, asked(whole, 11), k=4))
    assert vector_index.search(spark, path, q.limit(0), k=4).count() == 0
    # more than there are
    assert vector_index.search(spark, path, asked(whole, 4500), k=2000).count() == whole.count()
    assert spark.read.parquet(f"{path}/blocks").groupBy("block").count().filter("count > 1").count() == 0


def test_hot_cell_and_empty(spark):
    same = table(spark, np.ones((5000, 3)))  # one vector, many rows
    path = scratch_path(spark, "vi")
    vector_index.build(same, path)
    blocks = spark.read.parquet(f"{path}/blocks")
    assert blocks.agg(F.max("n")).first()[0] <= vector_index.BLOCK_ROWS and blocks.agg(F.sum("n")).first()[0] == 5000
    got = rows(vector_index.search(spark, path, asked(same, 2500), k=3))
    assert {k: v[0] for k, v in got.items()} == {(q, r): r - 1 for q in (0, 2500) for r in (1, 2, 3)}
    path = scratch_path(spark, "vi")
    vector_index.build(same.limit(0), path)
    assert vector_index.search(spark, path, asked(same, 2500)).count() == 0


def test_cells_and_row_groups_are_pruned(spark, small_blocks):
    emb = table(spark, clustered(4, 4000, 8, 10, .5))
    path = scratch_path(spark, "vi")
    vector_index.build(emb, path)
    index = spark.read.parquet(f"{path}/blocks")
    cells = [r.cell for r in index.select("cell").distinct().collect()]
    some = vector_index._open_blocks(index, [(cells[0], 0.0, 1.0), (cells[1], .5, 2.0)])
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan and "GreaterThanOrEqual(high" in plan and "LessThanOrEqual(low" in plan
    assert 0 < len(set(r.f for r in some.select(F.input_file_name().alias("f")).collect())) < len(index.inputFiles())
    wide = vector_index._open_blocks(index, [(c, 0.0, 1e9) for c in cells])
    assert wide.count() == index.count()


def test_a_batch_takes_few_blocks(spark, small_blocks, monkeypatch):
    taken = []
    kept = vector_index._kept
    monkeypatch.setattr(vector_index, "_kept", lambda df, name: (taken.append((name, spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))), kept(df, name))[1])
    emb = table(spark, clustered(4, 500, 4, 3, 1.0))
    path = scratch_path(spark, "vi")
    vector_index.build(emb, path)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert vector_index.search(spark, path, asked(emb, 50), k=2).count() == 20
    assert {n for name, n in taken if name == "hits"} == {str(vector_index.BATCH_ROWS)}
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
