"""Tools with typed parameters."""

import pandas as pd
from pyspark.sql import functions as F

from strandmill.operators.tools import Tool, call, cast, register


def tool() -> Tool:
    def repeated(s: pd.Series, n: pd.Series, loud: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or k != k else (x * int(k)).upper() if y else x * int(k) for x, k, y in zip(s, n, loud)], dtype=object)

    return Tool("repeated", repeated, "string", {"s": {"type": "string", "required": True, "maxLength": 3}, "n": {"type": "integer", "required": True, "minimum": 1}, "loud": {"type": "boolean"}})


def test_calls_are_cast_checked_and_answered(spark):
    rows = ['{"s": "ab", "n": "2", "loud": "YES"}', '{"s": "ab", "n": 2}', '{"s": 7, "n": 1, "loud": false}', '{"n": 0}', '{"s": "abcd", "n": "x"}', "[1]", None, "no json"]
    got = [(r["result"], r["error"]) for r in call(spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, p string").coalesce(1), tool(), "p").orderBy("i").collect()]
    assert [g[0] for g in got] == ["ABAB", "abab", "7"] + [None] * 5
    assert [g[1] for g in got[:3]] == [None] * 3
    why = "Error: Invalid parameters for tool 'repeated': "
    assert got[3][1] == why + "missing required s; n must be >= 1" and got[4][1] == why + "s must be at most 3 chars; n should be integer"
    assert all(g[1].startswith(why) for g in got[3:])


def test_registered_by_name_with_its_definition(spark):
    (found,) = register(spark, tool())
    assert found["function"]["name"] == "repeated" and found["function"]["parameters"]["required"] == ["s", "n"] and "required" not in found["function"]["parameters"]["properties"]["s"]
    assert spark.sql("SELECT repeated('a', 3L, true) AS x").first()["x"] == "AAA"
    got = spark.createDataFrame([("Yes",), ("0",), ("2",)], "t string").select(cast(F.col("t"), "boolean").alias("b")).collect()
    assert [r["b"] for r in got] == [True, False, None]
