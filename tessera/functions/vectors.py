"""Array<float> vector scalars with double accumulators (no built-in exists)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    return F.aggregate(
        F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0), lambda acc, v: acc + v,
    )


def sq_norm(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double"))


def norm(a) -> Column:
    return F.sqrt(sq_norm(a))


def l2_distance(a, b) -> Column:
    d = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda acc, v: acc + v * v))


def normalize(a) -> Column:
    n = norm(a)
    return F.transform(_c(a), lambda x: x.cast("double") / n)


def cosine_distance(a, b) -> Column:
    return F.lit(1.0) - dot(a, b) / (norm(a) * norm(b))
