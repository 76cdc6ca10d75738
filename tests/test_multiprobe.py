import numpy as np

from tessera.operators import knn, multiprobe


def frames(spark, x, q):
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    return corpus, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "qid bigint, qvec array<double>")


def measured(spark, x, q, k=10):
    corpus, queries = frames(spark, x, q)
    found = multiprobe.search(corpus, queries, k).collect()
    pairs = {(r["qid"], r["vec_id"]): r["dist"] for r in found}
    assert len(pairs) == len(found)                                           # a candidate comes once
    recall = []
    for i, row in enumerate(q):
        d = np.sqrt(((x - row) ** 2).sum(axis=1))
        assert all(abs(pairs[i, j] - d[j]) < 1e-9 for j in range(len(x)) if (i, j) in pairs)
        true = np.lexsort((np.arange(len(x)), d))[:k]
        recall.append(sum((i, int(j)) in pairs for j in true) / k)
    return np.mean(recall), len(found) / (len(x) * len(q))


def clustered(n, clusters, dims, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims))
    x = centres[np.arange(n) % clusters] + 0.1 * rng.normal(size=(n, dims))
    return x, centres[np.arange(60) % clusters] + 0.1 * rng.normal(size=(60, dims))


def test_clusters_recall_and_few_pairs(spark):
    recall, share = measured(spark, *clustered(3000, 50, 32, 1))
    assert recall >= 0.95 and share < 0.1


def test_evenly_spread_vectors_keep_their_recall(spark):
    rng = np.random.default_rng(2)
    recall, _ = measured(spark, rng.normal(size=(800, 16)), rng.normal(size=(40, 16)))
    assert recall >= 0.95


def test_the_sample_is_bounded_and_every_row_is_indexed(spark, monkeypatch):
    monkeypatch.setattr(multiprobe, "SAMPLE_ROWS", 300)
    monkeypatch.setattr(multiprobe, "SAMPLE_QUERIES", 20)
    recall, share = measured(spark, *clustered(2000, 20, 16, 3))
    assert recall >= 0.95 and share < 0.3


def test_odd_rows_ties_and_threshold(spark):
    rows = [(5, [0.0, 1.0]), (3, [0.0, 1.0]), (4, [0.0, 1.0]), (6, None), (7, [float("nan"), 0.0]), (8, [1.0]), (9, [None, 0.0]), (None, [0.0, 0.0]), (10, [9.0, 9.0])]
    corpus = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    queries = spark.createDataFrame([(1, [0.0, 1.0]), (2, None), (3, [1.0])], "qid bigint, qvec array<double>")
    got = [(r["qid"], r["vec_id"], r["rank"]) for r in multiprobe.knn_lsh(corpus, queries, k=2).orderBy("rank").collect()]
    assert got == [(1, 3, 1), (1, 4, 2)]
    assert {r["vec_id"] for r in multiprobe.knn_lsh(corpus, queries, k=9, threshold=1.0).collect()} == {3, 4, 5}
    assert multiprobe.knn_lsh(corpus.filter("false"), queries, k=2).count() == 0
    assert multiprobe.knn_lsh(corpus, queries.filter("false"), k=2).count() == 0
    assert knn.recall_at_k(multiprobe.knn_lsh(corpus, queries, k=2), knn.knn_exact(corpus.filter("vec_id in (3, 4, 5, 10)"), queries.filter("qid = 1"), k=2), 2).first()["recall"] == 1.0
