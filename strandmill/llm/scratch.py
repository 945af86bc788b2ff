"""Intermediate tables in the folder that driver and executors share.

A written table cuts lineage and survives the loss of executors. The folder is
the one the cluster names in ``spark.checkpoint.dir``; only where that is unset,
as in tests, a temporary one is made.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The shared folder; an error where none is named and executors may run on other machines."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that driver and executors share")
    return _own.setdefault("dir", tempfile.mkdtemp(prefix="strandmill-"))


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return what was written; it is deleted when the application ends."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._strandmill_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``keep`` wrote and that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_strandmill_path", None)
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Rows that go to a Python worker at once: texts are long, so Spark's default of 10,000 is much memory.
BATCH = 1000


def bounded(spark: SparkSession) -> None:
    """From here on the session hands rows to Python in batches of at most BATCH.

    Spark reads the setting when a query runs, which for a returned DataFrame is later than
    here, so it is not set back.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH:
        spark.conf.set(key, str(BATCH))


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
