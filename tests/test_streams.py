"""Streams drained to their end give what the batch forms give, on closed windows."""

from strandmill.plans import QUERIES
from strandmill.streaming import live

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_dedup_equals_batch(spark):
    want = {(r["user_id"], r["event_type"]) for r in QUERIES["r5_dedup_ids"](spark, SF).collect()}
    got = [tuple(r) for r in QUERIES["r5_stream_dedup"](spark, SF).collect()]
    assert set(got) == want and len(got) == len(want)


def test_closed_sessions_equal_batch(spark):
    from strandmill.plans.registry import table
    from strandmill.streaming import batch

    live_rows = rows(QUERIES["r3_stream_sessions"](spark, SF).select("user_id", "began", "events"))
    all_rows = rows(batch.sessions(table(spark, SF, "events"), "user_id", "ts", "6 hours").select("user_id", "began", "events"))
    assert live_rows and set(live_rows) <= set(all_rows) and len(live_rows) > 0.9 * len(all_rows)


def test_changes_equal_batch(spark):
    from pyspark.sql import functions as F
    from strandmill.operators import histories
    from strandmill.plans.registry import table

    want = rows(histories.changes(table(spark, SF, "events"), "user_id", ["event_id"], "event_type").select("user_id", "event_id", "event_type"))
    assert rows(QUERIES["r8_stream_changes"](spark, SF).select("user_id", "event_id", "event_type")) == want and F


def test_coalesce_and_cursor(spark, tmp_path):
    src = str(tmp_path / "in")
    data = [(1, 1, "delta", "a"), (1, 2, "delta", "b"), (1, 3, "end", ""), (2, 1, "delta", "x"), (2, 2, "message", "m"), (1, 4, "delta", "c"), (1, 5, "end", "")]
    spark.createDataFrame(data, "k long, seq long, kind string, t string").coalesce(1).write.parquet(src)
    seen = []
    stream = spark.readStream.schema("k long, seq long, kind string, t string").parquet(src)
    for _ in range(2):
        live.consume(live.coalesced(stream, "k", "seq", "kind", "t", "end"), lambda df, _: seen.extend(map(tuple, df.collect())), str(tmp_path / "state"))
    assert sorted(seen) == [(1, 1, "ab"), (1, 4, "c"), (2, 1, "x"), (2, 2, "m")]
