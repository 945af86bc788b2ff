"""The boundary to model functions: text in, text out, given by the caller.

Distinct inputs are asked once, in batches; what a function cannot answer is null. The
stub answers from the text alone, so that everything around a model can be tested.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ModelFn = Callable[[list[str]], list[str | None]]


def stub(texts: list[str]) -> list[str | None]:
    return [f"{len(t)}:{t[:20]}" for t in texts]


def ask(rows: DataFrame, text: str, to: str, fn: ModelFn = stub, batch: int = 100, most: int | None = None) -> DataFrame:
    """``rows`` with the answer to each text (its first ``most`` characters); a wrong number of answers is an error."""
    asked = F.substring(text, 1, most) if most else F.col(text)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out: list[str | None] = []
            for at in range(0, len(f), batch):
                part = f["__asked"].iloc[at : at + batch].tolist()
                got = fn(part)
                if len(got) != len(part):
                    raise ValueError(f"{len(part)} texts were given and {len(got)} answers came back")
                out += got
            yield f.assign(**{"__answer": out})

    keyed = rows.withColumn("__key", F.sha2(asked.cast("binary"), 256))
    once = keyed.select("__key", asked.alias("__asked")).filter("__asked IS NOT NULL").dropDuplicates(["__key"])
    answers = once.mapInPandas(run, "__key string, __asked string, __answer string").select("__key", F.col("__answer").alias(to))
    return keyed.join(answers, "__key", "left").drop("__key")


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratcliff and Obershelp's likeness, as the standard library has it; no built-in function gives the same."""
    return F.pandas_udf(_ratio, "double")(a, b)


def similarity_matrix(items: DataFrame, item: str, text: str) -> DataFrame:
    """(a, b, value) of all ordered pairs of a few items, with ones on the diagonal; each pair is compared once."""
    x = items.select(F.col(item).alias("a"), F.col(text).alias("ta"))
    y = items.select(F.col(item).alias("b"), F.col(text).alias("tb"))
    half = x.join(y, F.col("a") < F.col("b")).select("a", "b", sequence_ratio(F.col("ta"), F.col("tb")).alias("value"))
    return half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "value")).unionByName(x.select("a", F.col("a").alias("b"), F.lit(1.0).alias("value")))


def register(spark: SparkSession, functions: dict[str, Callable], kinds: dict[str, str]) -> list[str]:
    """Registers functions for SQL by name; returns the names in order."""
    for name, fn in functions.items():
        spark.udf.register(name, F.pandas_udf(fn, kinds[name]))
    return sorted(functions)
