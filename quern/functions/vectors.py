"""Vectors as array columns: cosine, centroids, a test embedding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(u: Column, v: Column) -> Column:
    return F.aggregate(F.zip_with(u, v, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def unit(v: Column) -> Column:
    """Scaled to length 1; a zero vector stays as it is."""
    return F.transform(v, lambda x: x / F.when(norm(v) == 0, 1.0).otherwise(norm(v)))


def cosine(u: Column, v: Column) -> Column:
    """Cosine in double precision, 0 where one vector is zero."""
    n = norm(u) * norm(v)
    return F.when(n == 0, 0.0).otherwise(dot(u, v) / n)


def literal(v: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def centroids(df: DataFrame, by: str, vec: str) -> DataFrame:
    """(by, centroid): the mean of each group's vectors, part by part. Sums
    combine map-side; a row of the shuffle is one part of one group."""
    parts = df.select(by, F.posexplode(doubles(F.col(vec))).alias("pos", "x"))
    means = parts.groupBy(by, "pos").agg(F.avg("x").alias("x"))
    ordered = means.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("p"))
    return ordered.select(by, F.transform("p", lambda s: s["x"]).alias("centroid"))


def hash_embedding(text: Column) -> Column:
    """Eight numbers from the digest of the stripped text: an identity for
    tests, without meaning."""
    hexed = F.sha2(F.regexp_replace(text, r"(?U)^\s+|\s+$", "").cast("binary"), 256)
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255.0)


def bag_embedding(text: Column, dim: int = 64) -> Column:
    """Counts of the words, hashed to `dim` places."""
    places = F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), lambda w: F.pmod(F.xxhash64(w), F.lit(dim)).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(places, lambda p: p == i)).cast("double"))
