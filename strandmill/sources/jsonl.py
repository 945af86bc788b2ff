"""JSON lines and documents: strict and tolerant scans, defaults, appending writers."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_strict(spark: SparkSession, path: str, schema: str, defaults: dict[str, Any] | None = None) -> DataFrame:
    """Every line must parse; missing fields take their defaults; blank lines are no rows."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return with_defaults(df, defaults or {})


def read_tolerant(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows that parse, lines that do not)."""
    text = spark.read.text(path).filter(F.trim("value") != "")
    parsed = text.withColumn("v", F.expr("try_parse_json(value)"))
    good = parsed.filter("v IS NOT NULL").select(F.from_json("value", schema).alias("r")).select("r.*")
    return good, parsed.filter("v IS NULL").select("value")


def with_defaults(df: DataFrame, defaults: dict[str, Any]) -> DataFrame:
    return df.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in defaults.items()})


def parsed(line: Column, schema: str) -> Column:
    """Null where a line is not JSON."""
    return F.when(F.try_parse_json(line).isNotNull(), F.from_json(line, schema))


def true_integers(df: DataFrame, value: str) -> DataFrame:
    """Rows whose JSON value is an integer number, not a boolean or a string."""
    return df.filter(F.schema_of_variant(F.try_parse_json(value)) == "BIGINT")


def read_session(spark: SparkSession, path: str, repair: bool = False) -> tuple[DataFrame, DataFrame]:
    """(header, messages) of a file whose first object has _type "metadata". With ``repair`` broken lines are skipped, else they fail."""
    lines = spark.read.text(path).filter(F.trim("value") != "").withColumn("v", F.try_parse_json("value") if repair else F.parse_json("value"))
    lines = lines.filter("v IS NOT NULL").withColumn("kind", F.expr("try_variant_get(v, '$._type', 'string')"))
    head = lines.filter("kind = 'metadata'").select(*[F.expr(f"try_variant_get(v, '$.{k}', 'string')").alias(k) for k in ("key", "created_at", "updated_at")])
    body = lines.filter("kind IS NULL OR kind <> 'metadata'").select(*[F.expr(f"try_variant_get(v, '$.{k}', 'string')").alias(k) for k in ("role", "content", "timestamp", "tool_call_id", "name")])
    return head, body


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def overwrite(df: DataFrame, path: str) -> None:
    """The old table stays until the new one is committed."""
    df.write.mode("overwrite").json(path)


def extract_object(text: Column) -> Column:
    """The JSON object in a model's answer: without fences, from the first { to the last }, without commas before a closing bracket; null if it does not parse."""
    inner = F.regexp_extract(F.regexp_replace(text, r"```(?:json)?", ""), r"(?s)(\{.*\})", 1)
    return F.try_parse_json(F.regexp_replace(inner, r",(\s*[}\]])", "$1"))
