"""Vector scalars and the two training losses, as JVM-side array expressions.

* triplet loss, cosine distance: ``max(0, d(a, p) - d(a, n) + margin)`` with ``d = 1 - cos``
* cosine-similarity loss: ``(cos(u, v) - target)^2``
Both are averaged with ``avg`` per group (partial aggregation, one small shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-8


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(u: Column | str, v: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(u), _c(v), lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(u: Column | str) -> Column:
    return F.sqrt(dot(u, u))


def cosine(u: Column | str, v: Column | str) -> Column:
    """Cosine similarity; the denominator is floored at 1e-8 so a zero vector gives 0."""
    return dot(u, v) / F.greatest(norm(u) * norm(v), F.lit(EPS))


def triplet_term(a: Column | str, p: Column | str, n: Column | str, margin: float = 0.25) -> Column:
    d_ap = F.lit(1.0) - cosine(a, p)
    d_an = F.lit(1.0) - cosine(a, n)
    return F.greatest(d_ap - d_an + F.lit(float(margin)), F.lit(0.0))


def cosine_term(u: Column | str, v: Column | str, target: Column | str) -> Column:
    d = cosine(u, v) - _c(target)
    return d * d


def triplet_loss(df: DataFrame, group_cols: list[str], a: str = "a", p: str = "p", n: str = "n", margin: float = 0.25) -> DataFrame:
    """Mean triplet loss per group, with the number of triplets and of active (loss > 0) ones."""
    t = triplet_term(a, p, n, margin)
    return df.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(t), 6).alias("loss"),
        F.sum((t > 0).cast("int")).cast("bigint").alias("active"),
    )


def cosine_similarity_loss(df: DataFrame, group_cols: list[str], u: str = "u", v: str = "v", target: str = "target") -> DataFrame:
    """Mean squared error between cosine similarity and target per group."""
    return df.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(cosine_term(u, v, target)), 6).alias("loss"),
    )


def mean_vectors(df: DataFrame, group_cols: list[str], vec: str = "embedding", dim: int | None = None, out: str = "centroid") -> DataFrame:
    """Per-group element-wise mean of an array column (posexplode -> avg per (group, i) -> array).

    Partial aggregation folds every map task to at most groups x dim rows before the shuffle.
    """
    cells = df.select(*group_cols, F.posexplode(vec).alias("_i", "_x")).groupBy(*group_cols, "_i").agg(
        F.avg(F.col("_x").cast("double")).alias("_m")
    )
    return cells.groupBy(*group_cols).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias(out)
    )
