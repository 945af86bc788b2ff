"""Written tables in a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, deleted when the application ends.

    The folder is that of ``spark.checkpoint.dir``; without one a temporary folder will do
    on one machine, and is an error where executors may run on others.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that driver and executors share")
        root = _own.setdefault("dir", tempfile.mkdtemp(prefix="strandmill-"))
    out = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(out)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return out


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read again, so that what follows does not compute it twice."""
    spark = df.sparkSession
    where = path(spark, name)
    df.write.parquet(where)
    return spark.read.schema(df.schema).parquet(where)


#: Rows and bytes that go to a Python worker at once: Spark's 10,000 rows of whole documents and 64 MB are several times as much memory there.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 500, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def bounded(spark: SparkSession) -> None:
    """From here on the session hands rows to Python in batches of at most BATCH; Spark reads that when a query runs, so it is not set back."""
    for key, most in BATCH.items():
        now = int(spark.conf.get(key).removesuffix("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))
