"""Neural-collapse statistics (C1-C3) in one grouped aggregate.

With unit rows x and normalised class means m_c = mean_c / |mean_c|:
  intra = mean over rows of 1 - x.m_label
        = 1 - (sum_c n_c |mean_c|) / N          (since sum_{x in c} x = n_c mean_c)
  inter = mean over class pairs i<j of 1 - m_i.m_j
        = 1 - (|sum_c m_c|^2 - C) / (C (C - 1))  (since |m_c| = 1)
so neither a join back to the rows nor an enumeration of class pairs is
needed: one partial/final aggregate per (label, dimension) does it, and a hot
label is combined map-side like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import norm


def _dim(df: DataFrame, vec_col: str) -> int:
    row = df.select(F.size(vec_col).alias("d")).filter(F.col("d") > 0).first()
    return int(row["d"]) if row else 0


def class_means(df: DataFrame, vec_col: str = "embedding", label_col: str = "label",
                dim: int | None = None) -> DataFrame:
    """(label, n, mean_norm, mean) with unit-normalised rows; mean is re-normalised.

    The per-label mean is Spark ML's ``Summarizer`` (a vector aggregate with
    partial/final merge, O(d) per row).  Zero vectors are skipped (the
    reference would produce NaN).
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    unit = (df.select(F.col(label_col).alias("label"), F.col(vec_col).alias("_v"))
            .withColumn("_n", norm("_v")).filter(F.col("_n") > 0)
            .select("label", array_to_vector(F.transform("_v", lambda x: x.cast("double") / F.col("_n"))).alias("u")))
    agg = unit.groupBy("label").agg(F.count(F.lit(1)).alias("n"), Summarizer.mean(F.col("u")).alias("_m"))
    out = agg.select("label", "n", vector_to_array("_m").alias("raw_mean")).withColumn("mean_norm", norm("raw_mean"))
    return out.select("label", "n", "mean_norm", F.transform("raw_mean", lambda x: x / F.col("mean_norm")).alias("mean"))


def collapse_stats(df: DataFrame, vec_col: str = "embedding", label_col: str = "label",
                   dim: int | None = None) -> DataFrame:
    """One row (intra_class_dist, inter_class_dist, nc_index, n_classes, n_rows).

    One class gives inter 0 and index infinity, as in the reference.
    """
    return collapse_from_means(class_means(df, vec_col, label_col))


def is_collapsed(df: DataFrame, threshold: float = 0.05, **kw) -> DataFrame:
    """The C1 row plus ``collapsed = nc_index <= threshold``."""
    st = collapse_stats(df, **kw)
    return st.withColumn("collapsed", F.col("nc_index") <= F.lit(threshold))


def collapse_from_means(means: DataFrame, dim: int | None = None) -> DataFrame:
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    agg = means.agg(
        F.sum("n").alias("N"), F.count(F.lit(1)).alias("C"),
        F.sum(F.col("n") * F.col("mean_norm")).alias("_wn"),
        Summarizer.sum(array_to_vector("mean")).alias("_s"))
    s2 = F.aggregate(vector_to_array("_s"), F.lit(0.0), lambda acc, x: acc + x * x)
    intra = F.lit(1.0) - F.col("_wn") / F.col("N")
    inter = F.when(F.col("C") > 1, F.lit(1.0) - (s2 - F.col("C")) / (F.col("C") * (F.col("C") - 1))).otherwise(F.lit(0.0))
    return agg.select(
        intra.alias("intra_class_dist"), inter.alias("inter_class_dist"),
        F.when(inter > 0, intra / inter).otherwise(F.lit(float("inf"))).alias("nc_index"),
        F.col("C").alias("n_classes"), F.col("N").alias("n_rows"))
