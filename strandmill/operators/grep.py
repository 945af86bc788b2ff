"""Pattern search over a table of lines: names, counts, or lines with context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def files_with(lines: DataFrame, file: str, line: str, pattern: str) -> DataFrame:
    return lines.filter(F.col(line).rlike(pattern)).select(file).distinct()


def count_by(lines: DataFrame, file: str, line: str, pattern: str) -> DataFrame:
    return lines.filter(F.col(line).rlike(pattern)).groupBy(file).agg(F.count("*").alias("matches"))


def content(lines: DataFrame, file: str, number: str, line: str, pattern: str, around: int = 0) -> DataFrame:
    """Lines within ``around`` of a match, ``hit`` where the line itself matches.

    Instead of a range join every hit names the line numbers around it, which are then joined by equality.
    """
    hits = lines.filter(F.col(line).rlike(pattern)).select(file, number)
    near = hits.select(file, F.explode(F.sequence(F.col(number) - around, F.col(number) + around)).alias(number)).distinct()
    return lines.join(near, [file, number]).select(file, number, line, F.col(line).rlike(pattern).alias("hit"))
