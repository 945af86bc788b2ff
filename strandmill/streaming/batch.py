"""What the streaming operators give on closed data, as plain DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """(key, began, ended, events): runs of events of which each follows within ``gap``."""
    w = F.session_window(F.col(ts).cast("timestamp"), gap)
    out = events.groupBy(key, w.alias("w")).agg(F.count("*").alias("events"))
    return out.select(key, F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "events")


def debounced(events: DataFrame, key: str, ts: str, item: str, gap: str) -> DataFrame:
    """(key, flushed): the items of every run, in order, that a timer of ``gap`` would flush together."""
    w = F.session_window(F.col(ts).cast("timestamp"), gap)
    out = events.groupBy(key, w.alias("w")).agg(F.array_sort(F.collect_list(item)).alias("i"))
    return out.select(key, F.array_join(F.transform("i", lambda x: x.cast("string")), ",").alias("flushed"))


def first_seen(events: DataFrame, key: list[str], order: str) -> DataFrame:
    return events.groupBy(*key).agg(F.min(order).alias(order))
