"""Connected components of an edge table by alternating star contractions.

Each round rewires edges toward the smallest neighbour (first from larger
neighbours, then among smaller ones) and writes the new edge table, so the
number of rounds grows with the logarithm of the longest path. A vertex's minimum is
pre-aggregated before the shuffle; hubs meet theirs by a broadcast (see ``skew``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .skew import lookup


def _minimum(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("d"))


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return lookup(both, _minimum(both), "u", "d", 2 * n).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _minimum(down)
    moved = lookup(down, low, "u", "d", n).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) to (node, component): the smallest node reachable.

    Only nodes that an edge names appear. Null ends and loops are ignored; an
    empty table gives an empty table. Rounds go on until the edges stay as they are.
    """
    now = scratch.keep(edges.filter("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        mid = scratch.keep(_large_star(now, state[0]), "edges")
        scratch.drop(now)
        now, before = scratch.keep(_small_star(mid, state[0]), "edges"), state
        scratch.drop(mid)
        state = _state(now)
        if state == before:
            break
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
