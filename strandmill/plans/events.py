"""Queries on events and schedules: sessions, repeats, decay, changes of state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import cron
from ..functions import scoring as S
from ..operators import histories as H
from ..streaming import batch as B
from .registry import query, table

NOW = "2024-02-01 00:00:00"
AGE = f"(epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 86400000000.0"
RET = f"CASE WHEN {AGE} <= 0 THEN 1.0 ELSE exp(-({AGE}) * ln(2) / 7) END"


def events(spark, d):
    return table(spark, d, "events")


def _aged(spark, d):
    now = F.lit(NOW).cast("timestamp")
    days = S.days_since(F.col("ts").cast("timestamp"), now)
    return events(spark, d).withColumn("days", days).withColumns({"ret": S.retention(F.col("days")), "importance": (F.col("event_id") % 10 + 1).cast("long")})


@query("n1_n3_retention", f"SELECT event_id, round({AGE}, 6) AS days, round({RET}, 6) AS retention, round((event_id % 10 + 1) * ({RET}), 6) AS effective FROM events")
def n1(spark, d):
    return _aged(spark, d).select("event_id", F.round("days", 6).alias("days"), F.round("ret", 6).alias("retention"), F.round(F.col("importance") * F.col("ret"), 6).alias("effective"))


@query("c24_advice", f"SELECT event_id, CASE WHEN r < 0.1 AND i < 5 THEN 'remove' WHEN r < 0.3 AND i >= 5 THEN 'consolidate' WHEN r < 0.6 AND i >= 7 THEN 'refresh' ELSE 'keep' END AS advice FROM (SELECT event_id, event_id % 10 + 1 AS i, {RET} AS r FROM events)")
def c24(spark, d):
    return _aged(spark, d).select("event_id", S.advice(F.col("ret"), F.col("importance")).alias("advice"))


@query("t8_reminders", f"SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY round({RET}, 9), round(-1 / greatest({AGE}, 0.01), 9), event_id) AS rn FROM events) WHERE rn <= 3")
def t8(spark, d):
    t = _aged(spark, d).withColumns({"r": F.round("ret", 9), "u": F.round(-1 / F.greatest("days", F.lit(0.01)), 9)})
    return H.keep_last(t, ["user_id"], ["r", "u", "event_id"], 3).select("user_id", "event_id")


@query("c4_important", "SELECT event_id FROM events WHERE event_id % 10 + 1 >= 8")
def c4(spark, d):
    return events(spark, d).filter(F.col("event_id") % 10 + 1 >= 8).select("event_id")


@query("c5_unprocessed", "SELECT event_id, user_id FROM events WHERE event_id > 500")
def c5(spark, d):
    return events(spark, d).filter("event_id > 500").select("event_id", "user_id")


@query("t9_j19_candidates", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 10 DESC, event_id) AS rn FROM events) WHERE rn <= 5")
def t9(spark, d):
    return H.keep_last(events(spark, d), ["user_id"], [F.desc(F.col("event_id") % 10), "event_id"], 5).select("user_id", "event_id")


@query("m12_actions", "SELECT event_id, CASE event_type WHEN 'click' THEN 'ignore' WHEN 'view' THEN 'replace' ELSE CASE WHEN event_id % 10 + 1 >= 8 THEN 'keep_old' ELSE 'replace' END END AS action FROM events")
def m12(spark, d):
    t = F.col("event_type")
    return events(spark, d).select("event_id", F.when(t == "click", "ignore").when(t == "view", "replace").when(F.col("event_id") % 10 + 1 >= 8, "keep_old").otherwise("replace").alias("action"))


@query("c22_n4_due", f"SELECT event_id, coalesce(next_run, -1)::BIGINT AS next_run, due FROM (SELECT event_id, CASE WHEN event_type = 'click' THEN CASE WHEN event_id * 1000 > 500000 THEN event_id * 1000 END WHEN event_type = 'view' THEN CASE WHEN event_id % 7 > 0 THEN 500000 + event_id % 7 * 60000 END END AS next_run, value > 5 AND event_id * 1000 <= 500000 AS due FROM events)")
def c22(spark, d):
    kind = F.when(F.col("event_type") == "click", "at").when(F.col("event_type") == "view", "every")
    run = S.next_run(kind, F.col("event_id") * 1000, F.col("event_id") % 7 * 60000, F.lit(500000))
    return events(spark, d).select("event_id", F.coalesce(run.cast("long"), F.lit(-1)).alias("next_run"), ((F.col("value") > 5) & (F.col("event_id") * 1000 <= 500000)).alias("due"))


@query("n4_cron", """SELECT event_id, epoch_ms(CASE WHEN due > ts THEN due ELSE due + INTERVAL 7 DAY END) AS next_run FROM (SELECT event_id, ts,
date_trunc('day', ts) + INTERVAL 1 DAY * ((event_id % 7 - dayofweek(ts) + 7) % 7)::INTEGER + INTERVAL 1 HOUR * (event_id % 24)::INTEGER + INTERVAL 1 MINUTE * (event_id % 60)::INTEGER AS due FROM events)""")
def n4(spark, d):
    """A weekly schedule for every event, at a minute, an hour and a weekday of its own, and when it runs next."""
    n = F.col("event_id")
    expr = F.concat_ws(" ", *[(n % k).cast("string") if k else F.lit("*") for k in (60, 24, 0, 0, 7)])
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    return events(spark, d).select("event_id", cron.next_cron(expr, at, F.lit("UTC")).alias("next_run"))


@query("c23_n5_idle", f"SELECT user_id, ((epoch_us(TIMESTAMP '{NOW}') - epoch_us(max(ts))) // 60000000)::BIGINT AS idle_minutes, epoch_us(TIMESTAMP '{NOW}') - epoch_us(max(ts)) >= 1440 * 60000000::BIGINT AS expired FROM events GROUP BY user_id")
def c23(spark, d):
    g = events(spark, d).groupBy("user_id").agg(F.max("ts").cast("timestamp").alias("last"))
    us = F.unix_micros(F.lit(NOW).cast("timestamp")) - F.unix_micros("last")
    return g.select("user_id", F.floor(us / 60000000).alias("idle_minutes"), (us >= 1440 * 60000000).alias("expired"))


@query("r3_sessions", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT user_id, epoch_us(min(ts)) AS began, count(*)::BIGINT AS events FROM s GROUP BY user_id, no""")
def r3(spark, d):
    return B.sessions(events(spark, d), "user_id", "ts", "6 hours").select("user_id", F.unix_micros("began").alias("began"), "events")


@query("r5_dedup_ids", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def r5(spark, d):
    return B.first_seen(events(spark, d), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


@query("r6_debounce", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS flushed FROM s GROUP BY user_id, no""")
def r6(spark, d):
    return B.debounced(events(spark, d), "user_id", "ts", "event_id", "1 hour")


@query("r8_w18_stage_changes", "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE event_type IS DISTINCT FROM b")
def r8(spark, d):
    return H.changes(events(spark, d), "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type")


@query("t12_last_events", "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 20")
def t12(spark, d):
    return events(spark, d).orderBy(F.desc("event_id")).limit(20).select("event_id", "event_type")


def _titled(rows, docs):
    """Title and language of the document of an event; the id and '?' without one."""
    docs = docs.select(F.col("doc_id").alias("user_id"), F.substring("text", 1, 20).alias("t"), "lang")
    return rows.join(docs, "user_id", "left").select("event_id", F.coalesce("t", F.col("user_id").cast("string")).alias("title"), F.coalesce("lang", F.lit("?")).alias("language"))


@query("j5_events_papers", "SELECT e.event_id, coalesce(d.text[1:20], e.user_id::VARCHAR) AS title, coalesce(d.lang, '?') AS language FROM events e LEFT JOIN documents d ON d.doc_id = e.user_id")
def j5(spark, d):
    """Events of users whose id no document has get the id as title."""
    return _titled(events(spark, d), table(spark, d, "documents"))


@query("j5_events_all_papers", "SELECT e.event_id, coalesce(d.text[1:20], e.user_id::VARCHAR) AS title, coalesce(d.lang, '?') AS language FROM events e LEFT JOIN documents d ON d.doc_id = e.user_id")
def j5_all(spark, d):
    return _titled(events(spark, d), table(spark, d, "documents"))


@query("w_tumbling", "SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS day, event_type, count(*)::BIGINT AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def tumbling(spark, d):
    """Beyond what is asked: fixed windows of a day."""
    w = F.window(F.col("ts").cast("timestamp"), "1 day")
    return events(spark, d).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.unix_micros("w.start").alias("day"), "event_type", "n", "total")


@query("u2_typed_tools", """SELECT event_id, CASE WHEN k <= 80 THEN k * 2 + 1 END::BIGINT AS result, CASE WHEN k IS NULL THEN 'Error: Invalid parameters for tool ''doubled'': missing required k' WHEN k > 80 THEN 'Error: Invalid parameters for tool ''doubled'': k must be <= 80' END AS error
FROM (SELECT event_id, CASE WHEN event_id % 5 <> 4 THEN json_extract(props, '$.k')::BIGINT END AS k FROM events)""")
def u2(spark, d):
    """A tool with a bounded number, called with the properties of every event; every fifth call lacks it."""
    from ..operators import tools

    doubled = tools.Tool("doubled", lambda k, more: 2 * k + more.fillna(True).astype("int64"), "bigint", {"k": {"type": "integer", "required": True, "maximum": 80}, "more": {"type": "boolean"}})
    given = F.when(F.col("event_id") % 5 == 4, F.lit('{"more": "yes"}')).otherwise(F.col("props"))
    return tools.call(events(spark, d).select("event_id", given.alias("params")), doubled, "params").select("event_id", "result", "error")
