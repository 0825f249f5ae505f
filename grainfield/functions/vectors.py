"""Vector algebra over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(doubles(v), lambda x: x * x), F.lit(0.0), lambda s, x: s + x))


def present(v: Column) -> Column:
    """Whether a vector is there: not null and not empty."""
    return F.coalesce(F.size(v) > 0, F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where lengths differ, a vector is absent or its norm is 0."""
    size = norm(a) * norm(b)
    return F.when(present(a) & present(b) & (F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size).otherwise(0.0)


def normalised(v: Column) -> Column:
    """A vector of length one; the zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(doubles(v), lambda x: x / n)).otherwise(doubles(v))


def centroids(vectors: DataFrame, group: str, vector: str, dim: int) -> DataFrame:
    """(group, n, centroid): normalised mean of the vectors of `dim` numbers of each group; sums are combined before the shuffle."""
    good = vectors.filter(F.size(vector) == dim)
    means = [F.avg(F.col(vector)[i].cast("double")).alias(f"_{i}") for i in range(dim)]
    return good.groupBy(group).agg(F.count("*").alias("n"), *means).select(group, "n", normalised(F.array(*[F.col(f"_{i}") for i in range(dim)])).alias("centroid"))


def authority_boost(rank: Column, pages: Column) -> Column:
    return 1 + F.log1p(rank * pages)


def final_score(similarity: Column, rank: Column, pages: Column, quality: Column, compilable: Column) -> Column:
    """Similarity times authority, quality (1 where it is not positive) and 2 for compilable pages."""
    q = F.when(quality > 0, quality).otherwise(1.0)
    return similarity * authority_boost(rank, pages) * q * F.when(compilable, 2.0).otherwise(1.0)
