"""Joins with a table of one row per key where a few keys hold most of the rows.

A key with more rows than a fixed share of all is hot. There are fewer than MOST such
keys whatever the input, so their rows of the table are sent to every task; rows of all
other keys are joined as usual, and none of those keys is too much for a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fewer keys than this can be hot.
MOST = 50_000
#: A key with no more rows than this is never hot.
LEAST = 256


def bound(total: int) -> int:
    return max(LEAST, total // MOST)


def lookup(rows: DataFrame, table: DataFrame, key: str | list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table`` by ``key`` (a column or some), which is unique there.

    ``size`` is the column of ``table`` that counts the rows of a key among the ``total``
    of ``rows``; it is dropped. ``how`` is inner or left; null keys meet nothing.
    """
    most = bound(total)
    hot = table.filter(F.col(size) > most).drop(size)
    rest = table.filter(F.col(size) <= most).drop(size)
    marked = rows.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), key, "left")
    cold = marked.filter("__hot is null").select(*rows.columns).join(rest, key, how)
    return marked.filter("__hot").select(*cold.columns).unionByName(cold)
