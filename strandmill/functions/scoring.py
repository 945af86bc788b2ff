"""Scores, decay and other arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def retention(days: Column, halflife: float = 7.0) -> Column:
    """1 for no or negative age, halved every ``halflife`` days."""
    import math

    return F.when(days <= 0, F.lit(1.0)).otherwise(F.exp(-days * F.lit(math.log(2) / halflife)))


def days_since(ts: Column, now: Column) -> Column:
    """Days from a time to ``now``; 0 where there is no time."""
    return F.coalesce((F.unix_micros(now) - F.unix_micros(ts)) / F.lit(86_400_000_000), F.lit(0.0))


def advice(ret: Column, importance: Column, least: int = 5) -> Column:
    """What to do with a memory: consolidate, remove, refresh or keep."""
    return (
        F.when((ret < 0.1) & (importance < least), "remove").when((ret < 0.3) & (importance >= least), "consolidate").when((ret < 0.6) & (importance >= 7), "refresh").otherwise("keep")
    )


def next_run(kind: Column, at_ms: Column, every_ms: Column, now_ms: Column) -> Column:
    """For one-time and repeated schedules; null where nothing follows."""
    return F.when((kind == "at") & (at_ms > now_ms), at_ms).when((kind == "every") & (every_ms > 0), now_ms + every_ms)


def parsed_score(text: Column) -> Column:
    """The first number of a text, between 1 and 10; 5 without one."""
    n = F.regexp_extract(text, r"(\d+)", 1).try_cast("long")
    return F.coalesce(F.least(F.lit(10), F.greatest(F.lit(1), n)), F.lit(5)).cast("long")


def synthetic(seed: Column, epochs: Column) -> tuple[Column, Column]:
    """(final, best) scores of a made run, to four places."""
    return F.round(0.6 + (seed % 5) * 0.04 + epochs * 0.01, 4), F.round(0.7 + (seed % 4) * 0.03 + epochs * 0.012, 4)


def share_of_budget(n: Column, total: int = 6000, least: int = 500) -> Column:
    return F.greatest(F.lit(least), F.floor(F.lit(float(total)) / F.sqrt(n))).cast("long")
