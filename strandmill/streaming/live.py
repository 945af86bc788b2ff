"""Structured Streaming forms of sessions, dedup, coalescing and progress.

Event times are cast to TIMESTAMP first; watermarks need that.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, ts: str, late: str) -> DataFrame:
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def sessions(events: DataFrame, key: str, ts: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions, given out once the watermark has passed their end."""
    w = F.session_window(ts, gap)
    return timed(events, ts, late).groupBy(key, w.alias("w")).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "events")


def dedup(events: DataFrame, ids: list[str], ts: str, late: str = "1 day") -> DataFrame:
    """Drops repeats that come within the watermark; state is bounded by time and not by a count."""
    return timed(events, ts, late).dropDuplicatesWithinWatermark(ids)


def windowed_counts(events: DataFrame, ts: str, by: list[str], width: str, late: str = "1 hour", slide: str | None = None) -> DataFrame:
    return timed(events, ts, late).groupBy(F.window(ts, width, slide) if slide else F.window(ts, width), *by).agg(F.count("*").alias("n"))


def stage_changes(events: DataFrame, key: str, seq: str, stage: str) -> DataFrame:
    """(key, seq, stage) whenever the stage of a key differs from its last one; the last one is the state."""

    def step(k: tuple, frames, state):
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(seq)
        out = []
        for s, v in zip(rows[seq], rows[stage]):
            if v != last:
                out.append((k[0], s, v))
                last = v
        state.update((last,))
        yield pd.DataFrame(out, columns=[key, seq, stage])

    kinds = dict(events.dtypes)
    schema = f"{key} {kinds[key]}, {seq} {kinds[seq]}, {stage} string"
    return events.select(key, seq, stage).groupBy(key).applyInPandasWithState(step, schema, "last string", "append", "NoTimeout")


def coalesced(events: DataFrame, key: str, seq: str, kind: str, text: str, end: str) -> DataFrame:
    """(key, seq, text): consecutive pieces of a key joined until a row of kind ``end`` or of another kind than "delta" comes."""

    def step(k: tuple, frames, state):
        held, at = state.get if state.exists else ("", None)
        rows = pd.concat(list(frames)).sort_values(seq)
        out = []
        for s, what, t in zip(rows[seq], rows[kind], rows[text]):
            if what == "delta":
                held, at = held + t, s if at is None else at
                continue
            if at is not None:
                out.append((k[0], at, held))
                held, at = "", None
            if what != end:
                out.append((k[0], s, t))
        state.update((held, at))
        yield pd.DataFrame(out, columns=[key, seq, text])

    kinds = dict(events.dtypes)
    return events.select(key, seq, kind, text).groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {seq} {kinds[seq]}, {text} string", f"held string, at {kinds[seq]}", "append", "NoTimeout")


def consume(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hands every new batch once to ``handle`` and stops when nothing is left; the checkpoint is the cursor."""
    q = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
