"""Comparison of groups by feature sets and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import shared


def overlaps(features: DataFrame, item: str, feature: str) -> DataFrame:
    """(a, b, shared, jaccard) of items a < b that share a feature; a set is counted once for either.

    Pairs come from an equality join on the feature and are counted at once, so what is
    shuffled next is a count per pair and task. Pairs without a common feature do not appear.
    """
    f = features.select(F.col(item).alias("i"), F.col(feature).alias("f")).distinct()
    sizes = f.groupBy("i").agg(F.count("*").alias("n"))
    pairs = f.alias("x").join(f.alias("y"), (F.col("x.f") == F.col("y.f")) & (F.col("x.i") < F.col("y.i"))).groupBy(F.col("x.i").alias("a"), F.col("y.i").alias("b")).agg(F.count("*").alias("shared"))
    p = pairs.join(sizes.select(F.col("i").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("i").alias("b"), F.col("n").alias("nb")), "b")
    return p.select("a", "b", "shared", (F.col("shared") / F.greatest(F.col("na") + F.col("nb") - F.col("shared"), F.lit(1))).alias("jaccard"))


def all_pairs(items: DataFrame, found: DataFrame, item: str) -> DataFrame:
    """``found`` of ``overlaps`` with the pairs it lacks, as zero; for few items, whose pairs are all wanted."""
    i = items.select(F.col(item).alias("a")).distinct()
    every = i.join(i.withColumnRenamed("a", "b"), F.col("a") < F.col("b"))
    return every.join(found, ["a", "b"], "left").select("a", "b", F.coalesce("shared", F.lit(0)).alias("shared"), F.coalesce("jaccard", F.lit(0.0)).alias("jaccard"))


def gaps(scores: DataFrame, item: str, dim: str, score: str, top: int = 3) -> DataFrame:
    """(a, b, dim, delta): per pair the dimensions in which it differs most."""
    s = scores.select(F.col(item).alias("i"), F.col(dim).alias("dim"), F.col(score).alias("s"))
    p = s.alias("x").join(s.alias("y"), (F.col("x.dim") == F.col("y.dim")) & (F.col("x.i") < F.col("y.i"))).select(F.col("x.i").alias("a"), F.col("y.i").alias("b"), F.col("x.dim").alias("dim"), F.abs(F.col("x.s") - F.col("y.s")).alias("delta"))
    return p.withColumn("rn", F.row_number().over(Window.partitionBy("a", "b").orderBy(F.desc("delta"), "dim"))).filter(F.col("rn") <= top).drop("rn")


def leaderboard(scores: DataFrame, item: str, score: str, digits: int | None = None, order: str | None = None) -> DataFrame:
    """(item, mean, best, n, spread, place): population spread, ties by item.

    With ``digits`` figures are rounded before places are dealt, so that means which differ only by the order of their sum are a tie.
    With ``order``, a column, as well, a mean that lies so near to half that the order of its sum decides is that of the sum in this order
    (equal ones by score), so no mean hangs on how rows are dealt out.
    Items are dealt by ranges of their order; a place is that in the range and the items of the ranges before.
    """
    size = F.avg(F.abs(score)) * (F.count(score) + 2)
    g = scores.groupBy(item).agg(F.avg(score).alias("mean"), F.max(score).alias("best"), F.count("*").alias("n"), F.stddev_pop(score).alias("spread"), size.alias("__size"))
    if digits is not None:
        g = _settled(scores, shared.keep(g, "means"), item, score, digits, order) if order is not None else g
        g = g.withColumns({c: rounded(F.col(c), digits) for c in ("mean", "best", "spread")})
    by = [F.desc("mean"), F.asc_nulls_last(item)]
    ranged = g.drop("__size").repartitionByRange(*by).sortWithinPartitions(*by).withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    ranged = shared.keep(ranged, "ranged")
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    return ranged.join(F.broadcast(before), "__part").select(item, "mean", "best", "n", "spread", (F.col("__before") + F.col("__at") + 1).alias("place"))


def rounded(x: Column, digits: int) -> Column:
    """A double rounded as SQL does it: the product with the power of ten is, half away from zero, and not the decimal that is shown for x."""
    y = x * 10**digits
    return F.when(F.abs(y) < float("inf"), F.round(y) / 10**digits).otherwise(x)


def _settled(scores: DataFrame, g: DataFrame, item: str, score: str, digits: int, order: str) -> DataFrame:
    """``g`` with the means that rounding leaves open summed one score after another; only rows of these items are shuffled.

    Two sums of n doubles differ by at most n steps of 2^-52 of the sum of their sizes; two steps more are for the division and the product.
    """
    width = F.col("__size") * 10**digits * 2.0**-52
    open_ = g.filter((width >= 0.5) | (F.abs(F.abs("mean") * 10**digits % 1 - 0.5) <= width)).select(F.col(item).alias("__item"))
    rows = scores.select(F.col(item).alias("__item"), F.col(order).alias("__order"), F.col(score).alias("__score"))
    rows = rows.alias("r").join(open_.alias("o"), F.col("r.__item").eqNullSafe(F.col("o.__item")), "left_semi")
    w = Window.partitionBy("__item").orderBy("__order", "__score").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("__item", "__score", F.sum("__score").over(w).alias("__sum"), F.row_number().over(w).alias("__row"))
    means = rows.groupBy("__item").agg((F.max_by("__sum", "__row") / F.count("__score")).alias("__mean"))
    return g.join(means, g[item].eqNullSafe(means["__item"]), "left").withColumn("mean", F.coalesce("__mean", "mean")).drop("__item", "__mean")


def matrix(scores: DataFrame, item: str, dim: str, score: str, dims: list[str], missing: float = 5.0) -> DataFrame:
    """A row per item and a column per dimension."""
    return scores.groupBy(item).pivot(dim, dims).agg(F.first(score)).fillna(missing, dims)


def running(rows: DataFrame, by: str, day: str, tie: str) -> DataFrame:
    """``rows`` with how many of their group there are up to each, by day and then ``tie``."""
    w = Window.partitionBy(by).orderBy(day, tie).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("so_far", F.count("*").over(w))
