"""Exact cosine search, fused ranking and what follows it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """In doubles, with 1e-10 added to either norm."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    return dot(a, b) / ((F.sqrt(dot(a, a)) + 1e-10) * (F.sqrt(dot(b, b)) + 1e-10))


def search(vectors: DataFrame, query: list[float], k: int = 20, vec: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """(vec_id, score) of the k nearest; those with a score of 0 or less are dropped after the cut."""
    q = F.array(*[F.lit(float(x)) for x in query])
    top = vectors.select(vec_id, cosine(F.col(vec), q).alias("score")).orderBy(F.desc("score"), vec_id).limit(k)
    return top.filter("score > 0")


def hashed_counts(tokens: Column, dim: int) -> Column:
    """Token counts by hashed position, scaled to length 1; the hash is the first 8 hex digits of MD5."""
    slot = F.transform(tokens, lambda t: F.conv(F.substring(F.md5(t.cast("binary")), 1, 8), 16, 10).cast("long") % dim)
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(slot, lambda s: s == i)).cast("double"))
    norm = F.sqrt(dot(counts, counts))
    return F.transform(counts, lambda c: F.when(norm == 0, F.lit(0.0)).otherwise(c / norm))


def fuse(lexical: DataFrame, dense: DataFrame, key: str, weights: tuple[float, float] = (0.3, 0.7)) -> DataFrame:
    """(key, score): both scores scaled to their range (0.001 at least), a missing one being 0 before it is scaled.

    Both are candidates of a search, a few rows, so their ranges are taken in one window and neither is planned twice.
    """
    both = lexical.withColumnRenamed("score", "a").join(dense.withColumnRenamed("score", "b"), key, "full_outer")
    every = Window.partitionBy(F.lit(0))
    low = lambda n: F.coalesce(F.min(n).over(every), F.lit(0.0))
    high = lambda n: F.coalesce(F.max(n).over(every), F.lit(1.0))
    part = lambda n: (F.coalesce(F.col(n), F.lit(0.0)) - low(n)) / F.greatest(high(n) - low(n), F.lit(0.001))
    return both.select(key, (weights[0] * part("a") + weights[1] * part("b")).alias("score"))


def rerank(found: DataFrame, scores: DataFrame, key: str, k: int) -> DataFrame:
    """Scores of a reranker where it gave one; with at most k candidates nothing is asked and all have 10."""
    n = found.agg(F.count("*").alias("__n"))
    joined = found.join(scores.select(key, F.col("score").alias("__new")), key, "left").crossJoin(F.broadcast(n))
    new = F.when(F.col("__n") <= k, F.lit(10.0)).otherwise(F.coalesce(F.col("__new"), F.col("score")))
    return joined.withColumn("score", new).drop("__new", "__n").orderBy(F.desc("score"), key).limit(k)


def context(found: DataFrame, text: Column, most: int, order: list) -> DataFrame:
    """Rows in order as long as their texts fit into ``most`` characters; ends at the first that does not."""
    run = F.sum(F.length(text)).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return found.withColumn("used", run).filter(F.col("used") <= most)


def remembered(entries: DataFrame, query: list[float], vec: str, importance: str, key: str, k: int = 3, least: float = 0.2) -> DataFrame:
    """Similarity times half to full weight by importance; what is not above ``least`` is dropped after the cut to k."""
    q = F.array(*[F.lit(float(x)) for x in query])
    s = cosine(F.col(vec), q) * (0.5 + 0.5 * F.col(importance) / 10)
    return entries.select(key, s.alias("score")).orderBy(F.desc("score"), key).limit(k).filter(F.col("score") > least)
