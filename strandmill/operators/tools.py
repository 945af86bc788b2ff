"""Tools with typed parameters: a function over columns, its parameters by name, type and rule, and calls given as JSON.

Parameters are cast first and checked then; a call that is wrong gives a text that says why,
and the function is asked only for those that are right.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.notes import faults

TYPES = {"integer": "bigint", "number": "double", "boolean": "boolean", "string": "string"}
#: Words that are true and false.
TRUE, FALSE = ("true", "1", "yes"), ("false", "0", "no")


@dataclass
class Tool:
    """``run`` takes a series per parameter, in order, and gives one of the type ``gives``; missing optional parameters are null."""

    name: str
    run: Callable[..., pd.Series]
    gives: str
    parameters: dict[str, dict] = field(default_factory=dict)

    def function(self):
        return F.pandas_udf(self.run, self.gives)

    def schema(self) -> dict:
        """The tool as a function definition for a model."""
        own = {k: {x: v for x, v in rule.items() if x != "required"} for k, rule in self.parameters.items()}
        need = [k for k, rule in self.parameters.items() if rule.get("required")]
        return {"type": "function", "function": {"name": self.name, "parameters": {"type": "object", "properties": own, "required": need}}}


def register(spark: SparkSession, *tools: Tool) -> list[dict]:
    """Registers the tools for SQL, with their types; returns their definitions by name."""
    for tool in tools:
        spark.udf.register(tool.name, tool.function())
    return sorted((t.schema() for t in tools), key=lambda s: s["function"]["name"])


def cast(value: Column, kind: str) -> Column:
    if kind == "boolean":
        low = F.lower(value)
        return F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False)
    return value.try_cast(TYPES[kind])


def call(rows: DataFrame, tool: Tool, params: str, result: str = "result", error: str = "error") -> DataFrame:
    """``rows`` with ``result`` and ``error`` of the call whose parameters the JSON text ``params`` holds."""
    given = F.from_json(params, "map<string,string>")
    t = rows.withColumn("__given", given)
    values = {k: F.try_element_at("__given", F.lit(k)) for k in tool.parameters}
    wrong = F.when(F.col("__given").isNull(), F.array(F.lit("parameters must be an object"))).otherwise(faults(values, tool.parameters))
    t = t.withColumn("__wrong", wrong)
    asked = [F.when(F.size("__wrong") == 0, cast(values[k], rule.get("type", "string"))) for k, rule in tool.parameters.items()]
    t = t.withColumn("__result", tool.function()(*asked))
    said = F.concat(F.lit(f"Error: Invalid parameters for tool '{tool.name}': "), F.array_join("__wrong", "; "))
    return t.select(*rows.columns, F.when(F.size("__wrong") == 0, F.col("__result")).alias(result), F.when(F.size("__wrong") > 0, said).alias(error))
