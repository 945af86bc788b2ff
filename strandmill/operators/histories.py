"""Windows over conversations: budgets, boundaries, legal suffixes, merged turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by(conv: str, *order) -> Window:
    return Window.partitionBy(conv).orderBy(*order)


def snip(rows: DataFrame, conv: str, seq: str, role: str, tokens: Column, budget: int, last: int = 4) -> DataFrame:
    """The newest turns but system ones whose tokens fit the budget, the newest always, from the first user turn on.

    Without a user turn among them they start at the last user turn of the conversation; without any, the last ``last`` turns stay.
    """
    t = rows.filter(F.col(role) != "system").withColumn("__n", tokens)
    newest = _by(conv, F.desc(seq))
    t = t.withColumns({"__run": F.sum("__n").over(newest.rowsBetween(Window.unboundedPreceding, 0)), "__rn": F.row_number().over(newest)})
    t = t.withColumn("__fit", (F.col("__rn") == 1) | (F.col("__run") <= budget))
    whole = Window.partitionBy(conv)
    first = F.min(F.when(F.col("__fit") & (F.col(role) == "user"), F.col(seq))).over(whole)
    final = F.max(F.when(F.col(role) == "user", F.col(seq))).over(whole)
    t = t.withColumns({"__from": F.coalesce(first, final)})
    keep = F.when(F.col("__from").isNotNull(), F.col(seq) >= F.col("__from")).otherwise(F.col("__rn") <= last)
    return t.filter(keep).drop("__n", "__run", "__rn", "__fit", "__from")


def boundary(rows: DataFrame, conv: str, seq: str, role: str, tokens: Column, target: int, start: int = 0, most: int = 60) -> DataFrame:
    """(conv, boundary): the first user turn behind ``start`` with ``target`` tokens or more before it, else the last user turn; not beyond ``most`` turns."""
    t = rows.filter(F.col(seq) >= start).withColumn("__n", tokens)
    before = F.coalesce(F.sum("__n").over(_by(conv, seq).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = t.withColumn("__before", before)
    user = (F.col(role) == "user") & (F.col(seq) > start)
    found = t.groupBy(conv).agg(F.min(F.when(user & (F.col("__before") >= target), F.col(seq))).alias("a"), F.max(F.when(user, F.col(seq))).alias("b"))
    return found.select(conv, F.least(F.coalesce("a", "b"), F.lit(start + most)).alias("boundary"))


def recent(rows: DataFrame, conv: str, seq: str, role: str, n: int) -> DataFrame:
    """The last ``n`` turns (all for 0), from their first user turn on if there is one."""
    t = rows.withColumn("__rn", F.row_number().over(_by(conv, F.desc(seq))))
    if n:
        t = t.filter(F.col("__rn") <= n)
    first = F.min(F.when(F.col(role) == "user", F.col(seq))).over(Window.partitionBy(conv))
    return t.withColumn("__first", first).filter(F.col("__first").isNull() | (F.col(seq) >= F.col("__first"))).drop("__rn", "__first")


def legal_suffix(rows: DataFrame, conv: str, seq: str, role: str, n: int = 8) -> DataFrame:
    """The last ``n`` turns and what is before them back to the user turn they belong to."""
    t = rows.withColumn("__rn", F.row_number().over(_by(conv, F.desc(seq))))
    whole = Window.partitionBy(conv)
    t = t.withColumn("__cut", F.min(F.when(F.col("__rn") <= n, F.col(seq))).over(whole))
    t = t.withColumn("__from", F.max(F.when((F.col(role) == "user") & (F.col(seq) <= F.col("__cut")), F.col(seq))).over(whole))
    return t.filter(F.col(seq) >= F.coalesce("__from", "__cut")).drop("__rn", "__cut", "__from")


def merge_roles(rows: DataFrame, conv: str, seq: str, role: str, text: str) -> DataFrame:
    """(conv, seq, role, text): neighbours of one role are one turn, their texts joined by blank lines; assistant turns at the end go."""
    new = F.when(F.lag(role).over(_by(conv, seq)).eqNullSafe(F.col(role)), 0).otherwise(1)
    t = rows.withColumn("__new", new).withColumn("__island", F.sum("__new").over(_by(conv, seq)))
    merged = t.groupBy(conv, "__island").agg(F.min(seq).alias(seq), F.min(role).alias(role), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(text).alias("t")))), lambda x: x["t"]), "\n\n").alias(text))
    end = F.max(F.when(F.col(role) != "assistant", F.col("__island"))).over(Window.partitionBy(conv))
    return merged.withColumn("__end", end).filter(F.col("__island") <= F.col("__end")).select(conv, seq, role, text)


def orphans(calls: DataFrame, results: DataFrame, conv: str, call: str, seq: str) -> DataFrame:
    """Results without a declared call before them in their conversation."""
    c = calls.select(F.col(conv).alias("__c"), F.col(call).alias("__id"), F.col(seq).alias("__s"))
    return results.join(c, (F.col(conv) == F.col("__c")) & (F.col(call) == F.col("__id")) & (F.col("__s") < F.col(seq)), "left_anti")


def unanswered(calls: DataFrame, results: DataFrame, conv: str, call: str) -> DataFrame:
    """Declared calls without any result."""
    return calls.join(results.select(conv, call).distinct(), [conv, call], "left_anti")


def compact(rows: DataFrame, conv: str, seq: str, text: str, may: Column, keep: int = 10, least: int = 500, note: str = "[omitted]") -> DataFrame:
    """Long results but the newest ``keep`` become a note."""
    rank = F.row_number().over(Window.partitionBy(conv, may).orderBy(F.desc(seq)))
    return rows.withColumn("__rank", rank).withColumn(text, F.when(may & (F.col("__rank") > keep) & (F.length(text) >= least), note).otherwise(F.col(text))).drop("__rank")


def keep_last(rows: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__rn") <= n).drop("__rn")


def changes(rows: DataFrame, key: str, order: list, value: str) -> DataFrame:
    """Rows whose value differs from the one before."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("__b", before).filter(~F.col(value).eqNullSafe(F.col("__b"))).drop("__b")


def islands(rows: DataFrame, key: str, order: list, flag: Column) -> DataFrame:
    """Rows where ``flag`` holds, with ``island``: the number of rows before in the key where it does not."""
    t = rows.withColumn("__flag", flag)
    return t.withColumn("island", F.sum(F.when(F.col("__flag"), 0).otherwise(1)).over(Window.partitionBy(key).orderBy(*order))).filter("__flag").drop("__flag")
