"""Exact k-nearest-neighbour search and what is built on it (J6, R3, D7-D9); approximate search
is in ``operators.multiprobe``.

Exact search never shuffles the corpus and never materialises query x corpus
pairs.  The query set is cut into blocks of at most ``query_block_rows``
(size-checked) and each block is broadcast as a matrix; every corpus
partition streams its Arrow batches through numpy, keeps a running top-k per
query and emits only k rows per query.  A salted multi-level top-k, sized
from k x partitions, merges the candidates.  Query sets larger than one
block take one scan of the corpus per block.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.topk import top_k_per_group

QUERY_BLOCK_ROWS = 20_000
#: bytes of one matrix of distances in a task
SCAN_BYTES = 64 << 20
RESULT_SCHEMA = "qid bigint, vec_id bigint, dist double"


def _scan_topk(Q: np.ndarray, qids: np.ndarray, metric: str, k: int):
    """mapInPandas body: running top-k of every query over one partition's batches.

    Matrix products give each distance with a known rounding slack; every row within the slack
    of a query's k-th is then compared by its exact distance, so ties and large offsets change
    nothing.  Memory is bounded by SCAN_BYTES, whatever the number of queries.
    """
    if metric == "cosine":
        norms = np.linalg.norm(Q, axis=1, keepdims=True)
        usable = norms[:, 0] > 0
        Q, qids = Q[usable] / norms[usable], qids[usable]

    def nearest(block: np.ndarray, ids: np.ndarray, C: np.ndarray, cid: np.ndarray, best: list):
        centre = C.mean(axis=0) if metric == "l2" else np.zeros(C.shape[1])
        q, c = block - centre, C - centre
        size = (q * q).sum(1)[:, None] + (c * c).sum(1)[None, :]
        rough = size - 2.0 * (q @ c.T)  # squared distance; for unit vectors twice 1 - cosine
        slack = 64 * np.finfo(float).eps * size * C.shape[1]
        kth = np.partition(rough + slack, k - 1, axis=1)[:, k - 1:k] if k <= len(cid) else np.full((len(ids), 1), np.inf)
        for i in range(len(ids)):
            at = np.flatnonzero(rough[i] - slack[i] <= kth[i])
            d = 1.0 - C[at] @ block[i] if metric == "cosine" else np.sqrt(((C[at] - block[i]) ** 2).sum(1))
            old_d, old_i = best[i]
            d, found = np.concatenate([old_d, d]), np.concatenate([old_i, cid[at]])
            order = np.lexsort((found, d))[:k]
            best[i] = d[order], found[order]

    def fn(batches):
        best = [(np.empty(0), np.empty(0, np.int64)) for _ in qids]
        for pdf in batches:
            if pdf.empty or not len(qids):
                continue
            C = np.stack(pdf["v"].to_numpy()).astype(np.float64)
            cid = pdf["id"].to_numpy(dtype=np.int64)
            if metric == "cosine":
                norms = np.linalg.norm(C, axis=1, keepdims=True)
                C, cid = C[norms[:, 0] > 0] / norms[norms[:, 0] > 0], cid[norms[:, 0] > 0]
                if not len(cid):
                    continue
            step = max(1, SCAN_BYTES // (8 * len(cid)))
            for start in range(0, len(qids), step):
                part = best[start:start + step]
                nearest(Q[start:start + step], qids[start:start + step], C, cid, part)
                best[start:start + step] = part
        if any(len(d) for d, _ in best):
            yield pd.DataFrame({"qid": np.repeat(qids, [len(d) for d, _ in best]), "vec_id": np.concatenate([i for _, i in best]),
                                "dist": np.concatenate([d for d, _ in best])})
    return fn


def knn_exact(corpus: DataFrame, queries: DataFrame, k: int = 5, metric: str = "l2",
              corpus_id: str = "vec_id", corpus_vec: str = "embedding",
              query_id: str = "qid", query_vec: str = "qvec", query_block_rows: int = QUERY_BLOCK_ROWS) -> DataFrame:
    """(qid, vec_id, dist, rank): the k nearest corpus rows for every query row.

    ``metric`` is ``l2`` (Euclidean) or ``cosine`` (1 - cosine similarity).
    Ties are broken by the smaller corpus id.  Corpus rows whose vector is
    NULL or of another dimension than the queries cannot be compared and are
    skipped; queries without a vector get no rows; a query block mixing
    dimensions is an error.  Zero vectors have no cosine: such queries get no
    rows and such corpus rows are no hits.
    """
    spark = corpus.sparkSession
    c = corpus.select(F.col(corpus_id).cast("bigint").alias("id"), F.col(corpus_vec).cast("array<double>").alias("v"))
    q = queries.select(F.col(query_id).cast("bigint").alias("id"), F.col(query_vec).cast("array<double>").alias("v")) \
        .filter(F.col("v").isNotNull())
    parts = max(1, c.rdd.getNumPartitions())
    # One bounded read decides the common case (all queries fit one block);
    # larger query sets are hashed into blocks, each again read with a bound.
    first = q.limit(query_block_rows + 1).collect()
    if len(first) <= query_block_rows:
        blocks = [lambda: first]
    else:
        n_blocks = 2 * math.ceil(q.count() / query_block_rows)

        def reader(b):
            def read():
                # hashed over id and vector: a block holds about half of query_block_rows, whatever the ids
                return q.filter(F.pmod(F.xxhash64("id", "v"), F.lit(n_blocks)) == b).collect()
            return read
        blocks = [reader(b) for b in range(n_blocks)]
    out = None
    for read in blocks:
        rows = read()       # one bounded, checked block: the broadcast payload
        if not rows:
            continue
        dims = {len(r["v"]) for r in rows}
        if len(dims) != 1:
            raise ValueError(f"query vectors of several dimensions: {sorted(dims)}")
        Q = np.array([r["v"] for r in rows], dtype=np.float64)
        ids = np.array([r["id"] for r in rows], dtype=np.int64)
        bq = spark.sparkContext.broadcast((Q, ids))

        def run(batches, bq=bq):
            Qb, idb = bq.value
            yield from _scan_topk(Qb, idb, metric, k)(batches)
        local = c.filter(F.size("v") == F.lit(Q.shape[1])).mapInPandas(run, RESULT_SCHEMA)
        out = local if out is None else out.unionByName(local)
    if out is None:
        return spark.createDataFrame([], RESULT_SCHEMA + ", rank int")
    return top_k_per_group(out, ["qid"], ["dist", "vec_id"], k, rows_per_group=k * parts)


def dual_search(session: DataFrame, long_term: DataFrame, queries: DataFrame, k: int = 5, metric: str = "l2",
                corpus_id: str = "vec_id", corpus_vec: str = "embedding",
                query_id: str = "qid", query_vec: str = "qvec") -> DataFrame:
    """Search a session (recent) index and a long-term index, merge into one top-k.

    Each index is searched exactly on its own (k hits per query each); a vector
    present in both keeps its nearer hit, the session one on ties.  Output:
    (qid, vec_id, dist, rank, tier), at most k rows per query.
    """
    hits = None
    for order, (tier, corpus) in enumerate((("session", session), ("long_term", long_term))):
        h = knn_exact(corpus, queries, k, metric, corpus_id, corpus_vec, query_id, query_vec).select(
            "qid", "vec_id", "dist", F.lit(tier).alias("tier"), F.lit(order).alias("_order"))
        hits = h if hits is None else hits.unionByName(h)
    # <= 2k candidate rows per query: dedupe per (qid, vec_id), then rank per query.
    best = hits.groupBy("qid", "vec_id").agg(F.min_by(F.struct("dist", "_order", "tier"),
                                                      F.struct("dist", "_order")).alias("b"))
    cand = best.select("qid", "vec_id", F.col("b.dist").alias("dist"), F.col("b.tier").alias("tier"))
    return top_k_per_group(cand, ["qid"], ["dist", "vec_id"], k, rows_per_group=2 * k)


def recall_at_k(approx: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """Per query |approx ∩ exact| / k, and the mean over queries."""
    a = approx.groupBy("qid").agg(F.collect_set("vec_id").alias("a"))
    e = exact.groupBy("qid").agg(F.collect_set("vec_id").alias("e"))
    per = e.join(a, "qid", "left").select(
        "qid", (F.size(F.array_intersect("e", F.coalesce("a", F.array().cast("array<bigint>")))) / F.lit(k)).alias("recall"))
    return per


def augment_prompts(prompts: DataFrame, hits: DataFrame, contents: DataFrame, prompt_id: str = "qid",
                    prompt_col: str = "prompt", content_id: str = "vec_id", content_col: str = "content") -> DataFrame:
    """Prompt + "\\n\\nRelevant information:\\n" + "- {content}\\n" per hit in rank order.

    Prompts without hits stay unchanged; the hit ids are kept as citations.  A hit whose content
    is missing keeps its citation and adds no line.
    """
    h = hits.join(contents.select(F.col(content_id).alias("vec_id"), F.col(content_col).alias("_content")), "vec_id", "left")
    per = h.groupBy(F.col("qid").alias(prompt_id)).agg(
        F.array_sort(F.collect_list(F.struct("rank", "vec_id", "_content"))).alias("_hits"))
    j = prompts.join(per, prompt_id, "left")
    with_text = F.filter("_hits", lambda x: x["_content"].isNotNull())
    lines = F.array_join(F.transform(with_text, lambda x: F.concat(F.lit("- "), x["_content"], F.lit("\n"))), "")
    return j.select(
        prompt_id,
        F.when(F.size(with_text) > 0, F.concat(F.col(prompt_col), F.lit("\n\nRelevant information:\n"), lines))
        .otherwise(F.col(prompt_col)).alias("augmented"),
        F.coalesce(F.transform("_hits", lambda x: x["vec_id"]), F.array().cast("array<bigint>")).alias("citations"))


def build_index(spark, cells_jsonl: str, out_path: str, num_features: int = 256, buckets: int = 64,
                encoder=None) -> None:
    """R2 / S8 -> R1 -> S10-S11: read cell JSONL, encode, append (id, content, metadata,
    embedding) to a Parquet vector table partitioned by a hash bucket of the id.
    Content and metadata ride along through the encoder (no join back)."""
    from tessera.operators.corpus import encode_documents
    from tessera.sources.files import read_cells_jsonl
    from tessera.sources.sinks import write_vectors
    cells = read_cells_jsonl(spark, cells_jsonl).withColumn(
        "id", F.xxhash64("notebook_id", "content"))
    rows = encode_documents(cells, "id", "content", num_features, encoder=encoder, keep=("content", "metadata"))
    write_vectors(rows.withColumn("bucket", F.pmod(F.col("id"), F.lit(buckets))), out_path, buckets_col="bucket")
