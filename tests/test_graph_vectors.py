import numpy as np
from pyspark.sql import functions as F

from tessera.operators import collapse, graph, knn, multiprobe


def _graph(spark):
    nodes = spark.createDataFrame(
        [(1, "note", "Use 100% of the DATA", None, "2024-01-01 00:00:00"),
         (2, "note", "use 50% of the data", None, "2024-01-02 00:00:00"),
         (3, "note", "unrelated", None, "2024-01-03 00:00:00"),
         (4, "note", "more data here", None, "2024-01-04 00:00:00")],
        "id bigint, type string, content string, metadata string, created_at string").withColumn(
        "created_at", F.col("created_at").cast("timestamp_ntz"))
    edges = spark.createDataFrame(
        [(1, 1, 2, "cites", "{}"), (2, 1, 3, "mentions", "{}"), (3, 1, 99, "cites", "{}")],
        "id bigint, source_id bigint, target_id bigint, relation string, metadata string")
    return nodes, edges


def test_retrieve_case_and_wildcards(spark):
    nodes, _ = _graph(spark)
    assert [r["id"] for r in graph.retrieve(nodes, "data", 5).collect()] == [4, 2, 1]
    assert [r["id"] for r in graph.retrieve(nodes, "0% of", 5).collect()] == [2, 1]
    assert [r["id"] for r in graph.retrieve(nodes, "data", 2).collect()] == [4, 2]


def test_neighbors_relation_and_dangling(spark):
    nodes, edges = _graph(spark)
    got = sorted((r["id"], r["relation"]) for r in graph.neighbors(nodes, edges).collect())
    assert got == [(2, "cites"), (3, "mentions")]          # edge to 99 drops out
    got = [r["id"] for r in graph.neighbors(nodes, edges, relation="cites").collect()]
    assert got == [2]


def test_clear_and_store(spark):
    n, e = graph.empty_graph(spark)
    assert n.count() == 0 and e.count() == 0
    new = spark.createDataFrame([("a",), ("b",)], "content string")
    stored = graph.store_nodes(n, new, "fact")
    ids = [r["id"] for r in stored.collect()]
    assert len(set(ids)) == 2


def test_knn_exact_multi_block_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    C = rng.normal(size=(300, 8)).astype(np.float32)
    Q = rng.normal(size=(25, 8)).astype(np.float32)
    corpus = spark.createDataFrame([(i, C[i].tolist()) for i in range(300)], "vec_id bigint, embedding array<float>")
    queries = spark.createDataFrame([(i, Q[i].tolist()) for i in range(25)], "qid bigint, qvec array<float>")
    for metric in ("l2", "cosine"):
        res = knn.knn_exact(corpus.repartition(7), queries, k=4, metric=metric, query_block_rows=10).collect()
        got = {(r["qid"], r["rank"]): r["vec_id"] for r in res}
        Cd, Qd = C.astype(np.float64), Q.astype(np.float64)
        for i in range(25):
            if metric == "l2":
                d = np.sqrt(((Cd - Qd[i]) ** 2).sum(1))
            else:
                d = 1 - (Cd @ Qd[i]) / (np.linalg.norm(Cd, axis=1) * np.linalg.norm(Qd[i]))
            expect = np.lexsort((np.arange(300), d))[:4]
            assert [got[(i, r)] for r in range(1, 5)] == list(expect)


def test_collapse_orthogonal_classes(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [2.0, 0.0], 0), (2, [0.0, 3.0], 1), (3, [0.0, 1.0], 1)],
                               "vec_id bigint, embedding array<float>, label int")
    r = collapse.collapse_stats(df).collect()[0]
    assert abs(r["intra_class_dist"]) < 1e-12 and abs(r["inter_class_dist"] - 1) < 1e-12 and abs(r["nc_index"]) < 1e-12


def test_collapse_one_class_and_brute_force(spark):
    one = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0)], "vec_id bigint, embedding array<float>, label int")
    r = collapse.collapse_stats(one).collect()[0]
    assert r["inter_class_dist"] == 0.0 and r["nc_index"] == float("inf")
    rng = np.random.default_rng(3)
    X = rng.normal(size=(120, 5))
    y = rng.integers(0, 4, 120)
    df = spark.createDataFrame([(i, X[i].tolist(), int(y[i])) for i in range(120)], "vec_id bigint, embedding array<double>, label int")
    r = collapse.collapse_stats(df).collect()[0]
    U = X / np.linalg.norm(X, axis=1, keepdims=True)
    M = np.stack([U[y == c].mean(0) for c in range(4)])
    M = M / np.linalg.norm(M, axis=1, keepdims=True)
    intra = np.mean([1 - U[i] @ M[y[i]] for i in range(120)])
    inter = np.mean([1 - M[i] @ M[j] for i in range(4) for j in range(i + 1, 4)])
    assert abs(r["intra_class_dist"] - intra) < 1e-12 and abs(r["inter_class_dist"] - inter) < 1e-12


def test_dual_search_overlapping_tiers_match_brute_force(spark):
    rng = np.random.default_rng(7)
    vecs = rng.normal(size=(60, 4))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vecs)]
    corpus = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    session = corpus.filter(F.col("vec_id") >= 40)            # overlaps the long-term index on 40..49
    long_term = corpus.filter(F.col("vec_id") < 50)
    qv = rng.normal(size=(3, 4))
    queries = spark.createDataFrame([(q, [float(x) for x in v]) for q, v in enumerate(qv)], "qid bigint, qvec array<double>")
    got = knn.dual_search(session, long_term, queries, k=4).collect()
    for q in range(3):
        d = np.sqrt(((vecs - qv[q]) ** 2).sum(1))
        want = sorted(range(60), key=lambda i: (d[i], i))[:4]
        mine = sorted((r for r in got if r["qid"] == q), key=lambda r: r["rank"])
        assert [r["vec_id"] for r in mine] == want
        assert [r["rank"] for r in mine] == [1, 2, 3, 4]
        for r in mine:
            assert r["tier"] == ("session" if r["vec_id"] >= 40 else "long_term")


def test_retrieve_batch(spark):
    nodes, _ = _graph(spark)
    terms = spark.createDataFrame([("data",), ("0% of",), ("unrelated",), ("more",), ("nothing",)], "term string")
    one = sorted(tuple(r) for r in graph.retrieve_batch(nodes, terms, k=2).select("term", "id", "rank").collect())
    assert one == [("0% of", 1, 2), ("0% of", 2, 1), ("data", 2, 2), ("data", 4, 1), ("more", 4, 1), ("unrelated", 3, 1)]


def test_encode_documents_tfidf_properties(spark):
    from tessera.operators.corpus import encode_documents
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "alpha gamma"), (3, "alpha beta beta"), (4, "alpha")],
                                 "doc_id bigint, text string")
    vec = {r["id"]: np.array(r["embedding"], dtype=np.float64) for r in encode_documents(docs, "doc_id", "text", 64).collect()}
    for i in (1, 2, 3):
        assert abs(np.linalg.norm(vec[i]) - 1.0) < 1e-6        # L2-normalised
    assert np.allclose(vec[1], vec[3])                          # same text, same vector
    assert np.count_nonzero(vec[4]) == 0                        # "alpha" is in every document: IDF 0
    assert np.count_nonzero(vec[2]) == 1                        # only "gamma" carries weight


def test_recall_at_k_exact_is_one_and_lsh_bounded(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(80)]
    corpus = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    queries = spark.createDataFrame([(q, rows[q][1]) for q in range(4)], "qid bigint, qvec array<double>")
    exact = knn.knn_exact(corpus, queries, k=5)
    assert all(r["recall"] == 1.0 for r in knn.recall_at_k(exact, exact, 5).collect())
    approx = multiprobe.knn_lsh(corpus, queries, k=5, threshold=10.0, num_tables=4)
    got = knn.recall_at_k(approx, exact, 5).collect()
    assert len(got) == 4 and all(0.0 <= r["recall"] <= 1.0 for r in got)
    assert all(r["recall"] >= 0.2 for r in got)                 # each query finds itself (distance 0)


def test_encode_documents_pluggable_encoder(spark):
    from tessera.operators.corpus import encode_documents
    docs = spark.createDataFrame([(1, "banana", "x"), (2, "apple pie", "y"), (3, None, "z")],
                                 "doc_id bigint, text string, tag string")

    def enc(texts):                           # a stand-in model: (length, count of 'a')
        return np.stack([[len(t), t.count("a")] for t in texts])
    got = {r["id"]: (r["tag"], list(r["embedding"])) for r in encode_documents(docs, "doc_id", "text", encoder=enc,
                                                                                keep=("tag",)).collect()}
    assert got == {1: ("x", [6.0, 3.0]), 2: ("y", [9.0, 1.0]), 3: ("z", [0.0, 0.0])}


def test_dataset_token_rate(spark):
    from tessera.operators.corpus import dataset_token_rate
    docs = spark.createDataFrame([
        (1, "load <dataset>Titanic</dataset> and <dataset> iris </dataset> then <dataset>nope</dataset>"),
        (2, "no tokens here"),
        (3, "x" * 5000 + "<dataset>MNIST</dataset>")],             # found anywhere in a long text
        "doc_id bigint, text string")
    known = spark.createDataFrame([("titanic",), ("Iris",), ("mnist",)], "name string")
    got = {r["id"]: (r["n_tokens"], r["n_resolved"], round(r["rate"], 4))
           for r in dataset_token_rate(docs, "doc_id", "text", known).collect()}
    assert got == {1: (3, 2, 0.6667), 3: (1, 1, 1.0)}


def test_link_appends_keep_ids_unique(spark):
    _, e = graph.empty_graph(spark)
    batch = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "s bigint, t bigint").repartition(2)
    e = graph.link(e, batch, "s", "t", "next")
    e = graph.link(e, batch, "t", "s", "prev")
    ids = [r["id"] for r in e.collect()]
    assert len(ids) == 6 and len(set(ids)) == 6


def test_knn_skips_null_and_odd_vectors(spark):
    corpus = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [1.0, 1.0, 1.0]), (4, [3.0, 4.0])],
                                   "vec_id bigint, embedding array<double>")
    queries = spark.createDataFrame([(0, [0.0, 0.1]), (9, None)], "qid bigint, qvec array<double>")
    got = [(r["qid"], r["vec_id"], r["rank"]) for r in knn.knn_exact(corpus, queries, k=5).orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 4, 2)]


def test_ids_are_dense_and_the_same_in_every_run(spark):
    batch = spark.createDataFrame([(f"text {i % 40}", str(i % 3)) for i in range(60)] + [(None, "0")], "content string, m string")
    more = batch.unionByName(spark.createDataFrame([("new", "0"), ("new", "0")], batch.schema))
    runs = []
    for parts in (1, 3, 7):
        n, _ = graph.empty_graph(spark)
        n = graph.store_nodes(n, batch.repartition(parts), "fact", metadata=F.col("m"))
        n = graph.store_nodes(n, more.repartition(parts, "m"), "note", metadata=F.col("m"), new_only=True)
        again = graph.store_nodes(n, more.repartition(parts), "note", metadata=F.col("m"), new_only=True)
        rows = [(x.id, x.type, x.content, x.metadata) for x in again.collect()]
        assert sorted(x[0] for x in rows) == list(range(1, len(rows) + 1))
        assert sorted(map(str, rows)) == sorted(str((x.id, x.type, x.content, x.metadata)) for x in again.collect())  # made anew
        assert sum(x[1] == "fact" for x in rows) == 61 and sum(x[1] == "note" for x in rows) == len({(x.content, x.m) for x in more.collect()})
        runs.append(sorted(map(str, rows)))
    assert runs[0] == runs[1] == runs[2]
    _, e = graph.empty_graph(spark)
    pairs = spark.createDataFrame([(1, 2), (2, 3), (1, 2), (3, None)], "s bigint, t bigint")
    e = graph.link(e, pairs, "s", "t", "next", new_only=True)
    e = graph.link(e, pairs.repartition(4), "s", "t", "next", new_only=True)
    assert sorted(x.id for x in e.collect()) == [1, 2, 3]
    e = graph.link(e, pairs.withColumn("k", F.col("s") + 100), "s", "t", "prev", id_col="k", new_only=True)
    assert sorted(x.id for x in e.collect()) == [1, 2, 3, 101, 102, 103]
