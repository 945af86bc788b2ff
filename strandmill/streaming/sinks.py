"""Sinks and cursors: each row once, whatever breaks off in between."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stateful import PROVIDER, ROCKS


def once(path: str, then: Callable[[int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` handler that writes a batch to a folder of its own number.

    A batch that is run again after a break replaces what it had written, so no row is
    there twice. ``then`` is called with the number when the batch is written.
    """

    def handle(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")
        if then:
            then(batch)

    return handle


def drain(out: DataFrame, path: str, mode: str = "append", then: Callable[[int], None] | None = None, idle: bool = True) -> None:
    """Runs ``out`` until its source is empty, from where its checkpoint beside ``path`` stands; state lives in RocksDB.

    ``idle`` allows batches without data, in which timers of event time end. State on the
    clock of the machine would ask for them for ever.
    """
    conf = {PROVIDER: ROCKS, "spark.sql.streaming.noDataMicroBatches.enabled": str(idle).lower()}
    spark = out.sparkSession
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        q = out.writeStream.foreachBatch(once(path, then)).outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def drained(spark: SparkSession, out: DataFrame, path: str, mode: str = "append", then: Callable[[int], None] | None = None, idle: bool = True) -> DataFrame:
    """What ``drain`` has written, with the number of the batch."""
    drain(out, path, mode, then, idle)
    return spark.read.schema(T.StructType([*out.schema, T.StructField("batch", T.IntegerType())])).option("basePath", path).parquet(path)


def in_batches(numbered: DataFrame, key: list[str], seq: str, size: int) -> DataFrame:
    """``numbered`` with batch_no: what a reader that takes ``size`` rows after its cursor at a time reads together."""
    from pyspark.sql import Window

    order = Window.partitionBy(*key).orderBy(seq)
    return numbered.withColumn("batch_no", F.floor((F.row_number().over(order) - 1) / size))


def resumed(history: Column, restored: Column) -> Column:
    """``history`` and what of ``restored`` is not yet at its end: the longest end of the one that the other begins with is not added again."""
    longest = F.least(F.size(history), F.size(restored))
    sizes = F.sequence(longest, F.lit(0), F.lit(-1))
    overlap = F.filter(sizes, lambda k: F.slice(history, F.size(history) - k + 1, k) == F.slice(restored, F.lit(1), k))[0]
    return F.concat(history, F.slice(restored, overlap + 1, F.size(restored)))
