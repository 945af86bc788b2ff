"""Keyed changes on tables: upsert, delete, replay of a log. A deleted row is gone from what is read next, too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of every key; rows that are combined before the shuffle, so a busy key is no hot one."""
    cols = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("r")).select(key, "r.*").select(*log.columns)


def replay(log: DataFrame, key: str, order: str, op: str, delete: str = "del") -> DataFrame:
    """The last row of every key whose last operation is not ``delete``."""
    return latest(log, key, order).filter(F.col(op) != delete)


def upsert(old: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """New rows replace old ones of their key but for the columns ``keep``, which stay as they were."""
    stay = [c for c in keep if c in old.columns]
    before = old.select(key, *[F.col(c).alias(f"__{c}") for c in stay])
    fresh = new.join(before, key, "left").withColumns({c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in stay}).drop(*[f"__{c}" for c in stay])
    return old.join(new.select(key), key, "left_anti").unionByName(fresh.select(*old.columns))


def delete(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def update(rows: DataFrame, patch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Sets columns of rows that the patch names, where the patch has a value."""
    p = patch.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    out = rows.join(p, key, "left").withColumns({c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in columns})
    return out.select(*rows.columns)


def toggled(log: DataFrame, key: list[str]) -> DataFrame:
    """Keys that were toggled an odd number of times."""
    return log.groupBy(*key).agg(F.count("*").alias("n")).filter("n % 2 = 1").drop("n")


def preferred(rows: DataFrame, name: str, priority: str) -> DataFrame:
    """Per name the row of the smallest priority."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(name).orderBy(priority))).filter("__rn = 1").drop("__rn")


def unlisted(found: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Index rows and those found elsewhere that it does not list."""
    return index.unionByName(found.join(index.select(key), key, "left_anti"), allowMissingColumns=True)


def first_seen(rows: DataFrame, form: str, order: str) -> DataFrame:
    """Distinct by ``form``; of equal ones the first in ``order``."""
    cols = [c for c in rows.columns if c != form]
    return rows.groupBy(form).agg(F.min_by(F.struct(*cols), order).alias("r")).select(form, "r.*").select(*rows.columns)


def line_ages(changes: DataFrame, file: str, line: str, at: str, now: Column) -> DataFrame:
    """(file, line, changed, age_days): when each line of a file was last changed, and how many days ago."""
    last = changes.groupBy(file, line).agg(F.max(at).alias("changed"))
    return last.withColumn("age_days", F.datediff(now, F.col("changed")))


def expire(updates: DataFrame, key: str, at: str, value: str, now: Column, minutes: int = 10) -> DataFrame:
    """The last value of every key that was updated within ``minutes`` before ``now``."""
    last = updates.groupBy(key).agg(F.max_by(value, at).alias(value), F.max(at).alias(at))
    return last.filter(F.unix_micros(now) - F.unix_micros(F.col(at).cast("timestamp")) <= minutes * 60_000_000)
