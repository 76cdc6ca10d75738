"""Registered queries of the training-data operators, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, centroids, collocations, jaccard, language, licenses, lines, neighbours, packing, pages, simhash, substring, suffixes
from tessera.session import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def tokenizer(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f
    return add


@query("op3_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(read_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op4_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return out.select(F.col("id").alias("doc_id"), "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


@query("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    profiles = language.fit(documents.filter(~held_out))
    return language.predict(documents, profiles, [F.col("doc_id"), held_out.alias("held_out")])


def _repeats_sql(words: int) -> str:
    return f"""
WITH texts AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS words FROM documents),
places AS (SELECT doc_id, words, unnest(range(1, len(words) - {words} + 2)) AS p FROM texts),
grams AS (SELECT doc_id, p, array_to_string(words[p:p + {words - 1}], ' ') AS gram FROM places),
firsts AS (SELECT gram, min(doc_id) AS lo FROM grams GROUP BY gram),
gone AS (SELECT DISTINCT doc_id, p + k AS i FROM grams JOIN firsts USING (gram), range(0, {words}) t(k) WHERE doc_id > lo),
numbered AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM texts),
kept AS (SELECT n.doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM numbered n ANTI JOIN gone g ON n.doc_id = g.doc_id AND n.i = g.i GROUP BY n.doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)"""


def _kept_digest(out: DataFrame) -> DataFrame:
    words = F.trim(F.regexp_replace("kept", "[\\x20\\x09-\\x0D]+", " "))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))


@query("op6_substring_dedup", _repeats_sql(substring.MIN_WORDS))
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept_digest(substring.substring_dedup(read_table(spark, sf_dir, "documents")))


@query("op10_suffix_dedup", _repeats_sql(suffixes.MIN_WORDS))
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept_digest(suffixes.suffix_dedup(read_table(spark, sf_dir, "documents")))


@query("op2_license_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.license_scan(read_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@query("op1_simhash")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.fingerprint_documents(read_table(spark, sf_dir, "documents"))
    text = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return out.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", text("fingerprint").alias("fingerprint"),
                      text("edited_fingerprint").alias("edited_fingerprint"), "near_edited", "near_next", "n_near")


@query("op7_jaccard_join", """
WITH texts AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS words FROM documents),
grams AS (SELECT DISTINCT doc_id, array_to_string(words[p:p + 4], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS p FROM texts WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (WITH RECURSIVE r(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM r JOIN links l ON r.b = l.a) SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT t.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(t.doc_id, coalesce(reach.least, t.doc_id))::BIGINT AS component_id
FROM texts t LEFT JOIN sizes s ON s.doc_id = t.doc_id LEFT JOIN reach ON reach.a = t.doc_id""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op9_embedding_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.embedding_components(read_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


@query("op8_line_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.line_dedup(read_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def _centroid_sql(k: int = 16, rounds: int = 3) -> str:
    nearest = ("SELECT vec_id, x, cluster, distance FROM (SELECT v.vec_id, v.x, c.cluster, "
               "list_sum(list_transform(list_zip(v.x, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance FROM v, c{r} c) "
               "QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1")
    steps = []
    for r in range(rounds):
        steps.append(f"a{r} AS ({nearest.format(r=r)})")
        steps.append(f"m{r} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (SELECT cluster, i, sum(e)::HUGEINT AS s, count(*) AS n "
                     f"FROM (SELECT cluster, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY cluster, i) GROUP BY cluster)")
        steps.append(f"c{r + 1} AS (SELECT o.cluster, coalesce(m.c::BIGINT[], o.c) AS c FROM c{r} o LEFT JOIN m{r} m USING (cluster))")
    return f"""
WITH raw AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) = 64),
v AS (SELECT vec_id, list_transform(e, lambda y: floor(64 * y)::BIGINT) AS x FROM raw
      WHERE len(list_filter(e, lambda y: y IS NOT NULL AND isfinite(y))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR)) - 1 AS cluster, x AS c FROM v QUALIFY cluster < {k}),
{", ".join(steps)},
f AS ({nearest.format(r=rounds)}),
s AS (SELECT cluster, sum(distance)::BIGINT AS cluster_inertia FROM f GROUP BY cluster)
SELECT vec_id, f.cluster::INT AS cluster, distance, cluster_inertia, (SELECT sum(distance)::BIGINT FROM f) AS inertia,
       sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM f JOIN s ON s.cluster = f.cluster JOIN c{rounds} c ON c.cluster = f.cluster"""


@query("op11_centroid_clustering", _centroid_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = centroids.centroid_clusters(read_table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return out.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


@query("op12_html_extraction")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pages.extract_pages(read_table(spark, sf_dir, "pages"), keep=("url",))
    return out.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "n_kept")


@query("op13_phrase_collocations", """
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS words FROM pieces),
places AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS p FROM w WHERE len(words) > 0),
f AS (SELECT lang, k, array_to_string(words[p:p + k - 1], ' ') AS phrase, count(*) AS f FROM places, range(1, 6) t(k) WHERE p + k - 1 <= len(words) GROUP BY ALL HAVING count(*) >= 100),
totals AS (SELECT lang, count(*) AS n FROM places GROUP BY lang),
c AS (SELECT lang, phrase, f AS a, k, string_split(phrase, ' ') AS words FROM f WHERE k > 1),
cuts AS (SELECT c.lang, c.phrase, a, j, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score
  FROM c JOIN range(1, 5) t(j) ON j < k JOIN totals ON totals.lang = c.lang
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(words[1:j], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(words[j + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
parts AS (SELECT lang, array_to_string(words[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM c, range(2, 5) t(m), range(1, 5) u(i) WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN parts p ON p.lang = b.lang AND p.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))
