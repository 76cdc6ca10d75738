"""Corpus-level operators declared by the reference's configuration:
domain keyword tags (D1), notebook caps (D3), side-effect cells (D5),
citation gate (D9) and the default text encoder (R1)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Domain keyword lists, in this order (ties go to the earlier domain).
DOMAIN_KEYWORDS = (
    ("cv", ("image", "vision", "cnn", "resnet", "efficientnet", "detection", "segmentation", "classification")),
    ("nlp", ("text", "bert", "transformer", "token", "embedding", "sentiment", "classification", "translation")),
    ("rl", ("reinforcement", "agent", "environment", "reward", "policy", "q-learning", "actor-critic")),
    ("tabular", ("dataframe", "pandas", "feature", "engineering", "regression", "classification", "xgboost")),
)
# Notebook caps.
MAX_CELLS = 20
MAX_CELL_LENGTH = 1000


def _member_of(words):
    return lambda t: t.isin(*words)


def domain_tags(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, domain, hits) whole-word keyword counts, plus best domain per document.

    A document is one row, so everything happens inside that row: the text is
    split once, non-keywords are dropped, each domain's hits are counted with
    ``filter``/``size`` and the best domain is the ``array_min`` of
    (-hits, domain order).  No join, no aggregate, no shuffle.
    """
    words = sorted({w for _, ws in DOMAIN_KEYWORDS for w in ws})
    toks = F.filter(F.split(F.lower(F.col(text_col)), r"[^a-z0-9\-]+"), lambda t: t.isin(*words))
    kw = docs.select(F.col(id_col).alias("id"), toks.alias("_kw"))
    per_domain = F.array(*[
        F.struct(F.lit(-1).alias("neg_hits"), F.lit(i).alias("domain_order"), F.lit(d).alias("domain"))
        .withField("neg_hits", -F.size(F.filter("_kw", _member_of(ws))))
        for i, (d, ws) in enumerate(DOMAIN_KEYWORDS)])
    present = F.filter(per_domain, lambda x: x["neg_hits"] < 0)
    # explode_outer + a filter above it: a plain explode would make the optimizer
    # infer size(_p) > 0 and push it to the scan, tokenising every text again.
    rows = kw.select("id", present.alias("_p")).select(
        "id", F.array_min("_p")["domain"].alias("best_domain"), F.explode_outer("_p").alias("_d")
    ).filter(F.col("_d").isNotNull())
    return rows.select("id", F.col("_d.domain").alias("domain"), (-F.col("_d.neg_hits")).cast("bigint").alias("hits"),
                       "best_domain")


def cap_cells(cells_array: Column, max_cells: int = MAX_CELLS, max_len: int = MAX_CELL_LENGTH) -> Column:
    """D3 inside a notebook row: first ``max_cells`` kept cells, sources cut to ``max_len``."""
    kept = F.filter(cells_array, lambda c: c["kind"].isin("code", "markdown"))
    return F.transform(F.slice(kept, 1, max_cells),
                       lambda c: c.withField("source", F.substring(c["source"], 1, max_len)))


SIDE_EFFECT_RE = r"(?m)^\s*[!%]"


def side_effect_flag(source) -> Column:
    """A code cell with a shell/magic line (``!pip install``, ``%matplotlib``)."""
    c = F.col(source) if isinstance(source, str) else source
    return c.rlike(SIDE_EFFECT_RE)


def citation_gate(hits: DataFrame, max_dist: float) -> DataFrame:
    """A query is cited when its nearest hit is within ``max_dist``, else rejected."""
    return hits.groupBy("qid").agg(F.min("dist").alias("nearest")).withColumn(
        "verdict", F.when(F.col("nearest") <= max_dist, "cited").otherwise("rejected"))


def _encoder_udf(encoder):
    """Arrow-batched wrapper: ``encoder(pandas.Series[str]) -> (n, d) array`` per batch."""
    @F.pandas_udf("array<float>")
    def enc(texts: pd.Series) -> pd.Series:
        m = np.asarray(encoder(texts.fillna("")), dtype=np.float32)
        return pd.Series(list(m.reshape(len(texts), -1)))
    return enc


def encode_documents(docs: DataFrame, id_col: str, text_col: str, num_features: int = 256,
                     encoder=None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, embedding) per document.

    ``encoder`` plugs in a model: a function from a pandas Series of texts to
    an (n, d) array, run as an Arrow-batched pandas UDF (one call per batch,
    the model loaded once per Python worker by the caller's closure).
    Without it the default needs no weights: tokens -> hashed TF -> IDF ->
    L2 normalise, where the IDF fit is one distributed document-frequency
    aggregate.  ``keep`` carries columns through, so callers need no join back.
    """
    if encoder is not None:
        return docs.select(F.col(id_col).alias("id"), *keep, _encoder_udf(encoder)(F.col(text_col)).alias("embedding"))
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array
    from pyspark import StorageLevel
    tf = Pipeline(stages=[
        RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=r"\W+", toLowercase=True),
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features)]).fit(docs).transform(docs)
    # The IDF fit and the transform both need the term frequencies: tokenise once.
    tf = tf.select(id_col, *keep, "_tf").persist(StorageLevel.MEMORY_AND_DISK)
    model = Pipeline(stages=[IDF(inputCol="_tf", outputCol="_idf"),
                             Normalizer(inputCol="_idf", outputCol="_vec", p=2.0)]).fit(tf)
    out = model.transform(tf)
    return out.select(F.col(id_col).alias("id"), *keep, vector_to_array("_vec", "float32").alias("embedding"))


DATASET_TOKEN_RE = r"<dataset>(.*?)</dataset>"


def dataset_token_rate(docs: DataFrame, id_col: str, text_col: str, known: DataFrame,
                       name_col: str = "name") -> DataFrame:
    """Share of ``<dataset>name</dataset>`` tokens that resolve to a known dataset name.

    (id, n_tokens, n_resolved, rate) per document that has tokens.  Tokens are
    extracted from the whole text with ``regexp_extract_all``; names are
    matched after trim + lower.  The name table joins on the token (a shuffle
    join, broadcast at runtime by AQE when small); counts are partial/final.
    """
    toks = docs.select(F.col(id_col).alias("id"),
                       F.explode(F.regexp_extract_all(F.col(text_col), F.lit(DATASET_TOKEN_RE), 1)).alias("tok"))
    toks = toks.withColumn("key", F.lower(F.trim("tok")))
    names = known.select(F.lower(F.trim(F.col(name_col))).alias("key")).distinct().withColumn("hit", F.lit(True))
    j = toks.join(names, "key", "left")
    per = j.groupBy("id").agg(F.count(F.lit(1)).alias("n_tokens"),
                              F.count_if(F.coalesce("hit", F.lit(False))).alias("n_resolved"))
    return per.withColumn("rate", F.col("n_resolved") / F.col("n_tokens"))
