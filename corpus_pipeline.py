"""From raw documents to packed training sequences, one written table after another.

Every stage works on all rows that the stage before kept, and its decisions take effect:
documents without a language go, repeated lines go, of near-duplicates the smallest id
stays, personal data is redacted, and what is left is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandmill.llm import scratch
from strandmill.llm.stages import STAGES

#: The first stage learns, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scratch.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
