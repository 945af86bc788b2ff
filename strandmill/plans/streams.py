"""Queries whose state goes on over several micro-batches; the SQL beside them is the batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import headers, shared
from ..streaming import hooks, sinks, stateful
from .registry import query, table

SLICES = 4
#: Tasks that write files of sessions.
WRITERS = 96
#: Key of the row that comes last and moves the watermark past all others.
BEAT = -(1 << 63)


def sliced(spark, d, rows_a_file: int = 10_000):
    """The events as a stream in SLICES batches by time and a late beat, so keys go on from batch to batch.

    A slice is as many files as the smallest one has ``rows_a_file`` for, at most a file per
    shuffle partition, and a batch is as many files, so batches begin where slices do.
    """
    e = table(spark, d, "events").filter("ts IS NOT NULL AND user_id IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp"))
    p = shared.path(spark, "slices")
    cuts = e.agg(F.percentile_approx("ts", [i / SLICES for i in range(1, SLICES)])).first()[0] or []
    which = sum(((F.col("ts") >= F.lit(c)).cast("int") for c in cuts), F.lit(0))
    counts = {r[0]: r[1] for r in e.groupBy(which.alias("slice")).count().collect()}
    files = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), min((counts.get(i, 0) for i in range(SLICES)), default=0) // rows_a_file))
    for i in range(SLICES):
        e.filter(which == i).repartition(files).write.mode("append").parquet(p)
    beat = e.agg((F.max("ts") + F.expr("INTERVAL 400 DAYS")).alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), "ts", F.lit(BEAT).alias("user_id"), F.lit("beat").alias("event_type"), F.lit(0.0).alias("value"), F.lit("").alias("props"))
    beat.coalesce(1).write.mode("append").parquet(p)
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", files).parquet(p)


def _all(spark, out, idle: bool = True):
    return sinks.drained(spark, out, shared.path(spark, "drained"), idle=idle).filter(F.col("user_id") != BEAT)


GROUPS = "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL {gap} THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS no FROM g) "


@query("r6_stream_debounce", GROUPS.format(gap="9 HOUR") + "SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) AS flushed, count(*)::BIGINT AS entries FROM s GROUP BY user_id, no")
def r6_live(spark, d):
    """Groups that stay open from one batch to the next are flushed by a timer that each arrival sets anew."""
    return _all(spark, stateful.debounced(sliced(spark, d), "user_id", "ts", "event_id", "event_id", 9 * 3600)).select("user_id", "flushed", "entries")


@query("r9_stream_expiry", GROUPS.format(gap="12 HOUR") + "SELECT user_id, event_id AS seq, row_number() OVER w AS updates, lag(event_type) OVER w AS before FROM s WINDOW w AS (PARTITION BY user_id, no ORDER BY ts, event_id)")
def r9_live(spark, d):
    """Entries of users vanish twelve hours after their last update; the next event starts a new one."""
    return _all(spark, stateful.progress(sliced(spark, d), "user_id", "ts", "event_id", "event_type", 12 * 3600)).select("user_id", "seq", "updates", "before")


@query("r9_stream_ttl", "SELECT user_id, event_id AS seq, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS last FROM events")
def r9_ttl(spark, d):
    """State whose store forgets a key an hour of the clock after it was written; within this run none is that old."""
    return _all(spark, stateful.remembered(sliced(spark, d), "user_id", "event_id", 3600), idle=False).select("user_id", "seq", "last")


@query("r2_stream_coalesced", """WITH k AS (SELECT *, CASE event_type WHEN 'view' THEN 'delta' WHEN 'click' THEN 'delta' WHEN 'purchase' THEN 'end' ELSE 'message' END AS kind FROM events),
g AS (SELECT *, CASE WHEN kind <> 'message' AND lag(kind) OVER w = 'delta' AND ts - lag(ts) OVER w < INTERVAL 24 HOUR THEN 0 ELSE 1 END AS new FROM k WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT user_id, arg_min(event_id, ts) AS seq, string_agg('[' || event_id || ']', '' ORDER BY ts, event_id) AS text, count(*)::BIGINT AS merged, bool_or(kind = 'end') AS ended FROM s GROUP BY user_id, no""")
def r2_live(spark, d):
    """Views and clicks are pieces, a purchase ends them, other events are messages of their own; what never ends comes after a day."""
    e = sliced(spark, d)
    kind = F.when(F.col("event_type").isin("view", "click"), "delta").when(F.col("event_type") == "purchase", "end").otherwise("message")
    e = e.withColumns({"kind": kind, "piece": F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit("]"))})
    return _all(spark, stateful.coalesced(e, "user_id", "ts", "event_id", "kind", "piece", 24 * 3600)).select("user_id", "seq", "text", "merged", "ended")


@query("r11_stream_recovery", "SELECT event_id, user_id, event_type FROM events")
def r11_live(spark, d):
    """A run that breaks off when its second batch is written but not yet done, and one that goes on from the checkpoint: each row is there once."""
    out = sliced(spark, d).filter(F.col("user_id") != BEAT).select("event_id", "user_id", "event_type")
    p = shared.path(spark, "recovered")

    def broken(batch: int) -> None:
        if batch == 1:
            raise InterruptedError("broken off on purpose")

    try:
        sinks.drain(out, p, then=broken)
    except Exception as e:  # noqa: BLE001  Spark wraps what the handler raises
        if "broken off on purpose" not in str(e):
            raise
    return sinks.drained(spark, out, p).select("event_id", "user_id", "event_type")


@query("r4_cursor_batches", "SELECT conv_id, batch_no::BIGINT AS batch_no, count(*)::BIGINT AS entries, max(turn) AS cursor FROM (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS batch_no FROM conversations) GROUP BY conv_id, batch_no")
def r4(spark, d):
    """A reader of histories takes three entries after its cursor at a time and always moves on."""
    b = sinks.in_batches(table(spark, d, "conversations"), ["conv_id"], "turn", 3)
    return b.groupBy("conv_id", "batch_no").agg(F.count("*").alias("entries"), F.max("turn").alias("cursor"))


@query("r11_replay", """WITH c AS (SELECT conv_id, list(role || ':' || text[1:8] ORDER BY turn) AS m FROM conversations GROUP BY conv_id),
t AS (SELECT conv_id, m[1 : len(m) - conv_id % 3] AS h, m[greatest(1, len(m) - conv_id % 5) : len(m)] || list_transform(range(conv_id % 2), lambda x: 'tool:Error: Task interrupted before this tool finished.') AS r FROM c),
o AS (SELECT *, list_max(list_filter(range(0, least(len(h), len(r)) + 1), lambda k: h[len(h) - k + 1 : len(h)] = r[1 : k])) AS k FROM t)
SELECT conv_id, k::BIGINT AS overlap, array_to_string(h || r[k + 1 : len(r)], chr(10)) AS history FROM o""")
def r11_replay(spark, d):
    """Histories that broke off, and checkpoints whose first messages they may have: replayed without doubling; calls that were open get an error as their result."""
    said = F.struct("turn", F.concat_ws(":", "role", F.substring("text", 1, 8)).alias("s"))
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(said)), lambda x: x["s"]).alias("m"))
    n, cut, back = F.size("m"), (F.col("conv_id") % 3).cast("int"), (F.col("conv_id") % 5).cast("int")
    at = F.greatest(F.lit(1), n - back)
    open_calls = F.array_repeat(F.lit("tool:Error: Task interrupted before this tool finished."), (F.col("conv_id") % 2).cast("int"))
    t = c.select("conv_id", F.slice("m", F.lit(1), F.greatest(n - cut, F.lit(0))).alias("h"), F.concat(F.slice("m", at, n), open_calls).alias("r"))
    full = sinks.resumed(F.col("h"), F.col("r"))
    return t.select("conv_id", (F.size("h") + F.size("r") - F.size(full)).cast("long").alias("overlap"), F.array_join(full, "\n").alias("history"))


@query("u4_session_headers", "SELECT 'c' || conv_id AS key, 'turns ' || count(*) AS created_at FROM conversations WHERE conv_id IN (3, 5, 13) GROUP BY conv_id")
def u4(spark, d):
    """A file per conversation, with a header and its turns; of three keys only the headers are read. Small tables are written by WRITERS tasks too, as files and not bytes take the time."""
    p = shared.path(spark, "sessions")
    t = table(spark, d, "conversations").filter("conv_id IS NOT NULL")
    head = t.groupBy("conv_id").agg(F.lit(None).cast("long").alias("turn"), F.to_json(F.struct(F.lit("metadata").alias("_type"), F.concat(F.lit("c"), F.first("conv_id")).alias("key"), F.concat(F.lit("turns "), F.count("*")).alias("created_at"))).alias("value"))
    lines = head.unionByName(t.select("conv_id", "turn", F.to_json(F.struct("role", F.col("text").alias("content"))).alias("value")))
    dealt = lines.withColumn("key", F.concat(F.lit("c"), "conv_id")).repartition(WRITERS, "key").sortWithinPartitions("key", F.asc_nulls_first("turn"))
    # Each task puts its own files in place; otherwise the driver does, one after the other.
    dealt.select("key", "value").write.partitionBy("key").option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(p)
    found = headers.session_headers(spark, p, r"key=([^/]+)/part-[^/]*$")
    return found.filter(F.col("key").isin("c3", "c5", "c13")).select("key", "created_at")


@query("u5_listener", "SELECT count(*)::BIGINT AS n_rows, 5::BIGINT AS batches, true AS ended FROM events")
def u5(spark, d):
    """Rows and batches of a stream as hooks are told them; one hook fails every time and stops nothing."""

    class Count:
        rows = batches = 0
        over = False

        def batch(self, run, number, rows):
            self.rows, self.batches = self.rows + rows, self.batches + (rows > 0)

        def ended(self, run, error):
            self.over = error is None

    class Broken:
        def batch(self, run, number, rows):
            raise RuntimeError("a hook that fails")

    told = Count()
    with hooks.hooked(spark, Broken(), told):
        sinks.drain(sliced(spark, d).select("event_id"), shared.path(spark, "heard"))
    return spark.range(1).select(F.lit(told.rows - 1).cast("long").alias("n_rows"), F.lit(told.batches).cast("long").alias("batches"), F.lit(told.over).alias("ended"))
