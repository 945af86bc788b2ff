"""Queries on conversations: budgets, boundaries, suffixes, merged turns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import token_estimate
from ..operators import histories as H
from .registry import query, table

TOKENS = "greatest(4, length(text) // 4 + 4)"


def conv(spark, d):
    return table(spark, d, "conversations")


@query("w3_snip_history", f"""WITH t AS (SELECT *, sum({TOKENS}) OVER w AS run, row_number() OVER w AS rn FROM conversations WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)),
f AS (SELECT *, rn = 1 OR run <= 400 AS fit FROM t), g AS (SELECT *, coalesce(min(CASE WHEN fit AND role = 'user' THEN turn END) OVER p, max(CASE WHEN role = 'user' THEN turn END) OVER p) AS frm FROM f WINDOW p AS (PARTITION BY conv_id))
SELECT conv_id, turn, role FROM g WHERE CASE WHEN frm IS NOT NULL THEN turn >= frm ELSE rn <= 4 END""")
def w3(spark, d):
    return H.snip(conv(spark, d), "conv_id", "turn", "role", token_estimate(F.col("text")), 400).select("conv_id", "turn", "role")


@query("w4_boundary", f"""WITH t AS (SELECT *, coalesce(sum({TOKENS}) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations)
SELECT conv_id, least(coalesce(min(CASE WHEN role = 'user' AND turn > 0 AND before >= 300 THEN turn END), max(CASE WHEN role = 'user' AND turn > 0 THEN turn END)), 60)::BIGINT AS boundary FROM t GROUP BY conv_id""")
def w4(spark, d):
    return H.boundary(conv(spark, d), "conv_id", "turn", "role", token_estimate(F.col("text")), 300).select("conv_id", F.when(F.col("boundary").isNotNull(), F.col("boundary").cast("long")).otherwise(F.lit(60).cast("long")).alias("boundary"))


@query("w15_recent", """WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations), u AS (SELECT *, min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS f FROM t WHERE rn <= 3)
SELECT conv_id, turn, role FROM u WHERE f IS NULL OR turn >= f""")
def w15(spark, d):
    return H.recent(conv(spark, d), "conv_id", "turn", "role", 3).select("conv_id", "turn", "role")


@query("w16_legal_suffix", """WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations), c AS (SELECT *, min(CASE WHEN rn <= 2 THEN turn END) OVER (PARTITION BY conv_id) AS cut FROM t),
f AS (SELECT *, max(CASE WHEN role = 'user' AND turn <= cut THEN turn END) OVER (PARTITION BY conv_id) AS frm FROM c) SELECT conv_id, turn, role FROM f WHERE turn >= coalesce(frm, cut)""")
def w16(spark, d):
    return H.legal_suffix(conv(spark, d), "conv_id", "turn", "role", 2).select("conv_id", "turn", "role")


@query("w14_merge_roles", """WITH r AS (SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'user' ELSE role END AS role, text FROM conversations),
n AS (SELECT *, CASE WHEN lag(role) OVER w IS NOT DISTINCT FROM role THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), i AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM n),
m AS (SELECT conv_id, island, min(turn) AS turn, min(role) AS role, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM i GROUP BY 1, 2)
SELECT conv_id, turn, role, text FROM (SELECT *, max(CASE WHEN role <> 'assistant' THEN island END) OVER (PARTITION BY conv_id) AS e FROM m) WHERE island <= e""")
def w14(spark, d):
    r = conv(spark, d).withColumn("role", F.when(F.col("role") == "system", "user").otherwise(F.col("role")))
    return H.merge_roles(r, "conv_id", "turn", "role", "text")


CALLS = "c AS (SELECT user_id, event_id, floor(value / 10) AS call FROM events WHERE event_type IN ('click', 'view')), r AS (SELECT user_id, event_id, floor(value / 10) AS call FROM events WHERE event_type = 'purchase')"


def _calls(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.floor(F.col("value") / 10).cast("double").alias("call"), "event_type")
    return e.filter(F.col("event_type").isin("click", "view")).drop("event_type"), e.filter("event_type = 'purchase'").drop("event_type")


@query("j12_orphans", f"WITH {CALLS} SELECT r.user_id, r.event_id, r.call FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.user_id = r.user_id AND c.call = r.call AND c.event_id < r.event_id)")
def j12(spark, d):
    return H.orphans(*_calls(spark, d), "user_id", "call", "event_id")


@query("j13_s4_unanswered", f"WITH {CALLS} SELECT c.user_id, c.event_id, c.call FROM c WHERE NOT EXISTS (SELECT 1 FROM r WHERE c.user_id = r.user_id AND c.call = r.call)")
def j13(spark, d):
    return H.unanswered(*_calls(spark, d), "user_id", "call").select("user_id", "event_id", "call")


@query("w8_compact", """SELECT conv_id, turn, CASE WHEN role = 'assistant' AND rk > 1 AND length(text) >= 500 THEN '[omitted]' ELSE text END AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role = 'assistant' ORDER BY turn DESC) AS rk FROM conversations)""")
def w8(spark, d):
    return H.compact(conv(spark, d), "conv_id", "turn", "text", F.col("role") == "assistant", keep=1).select("conv_id", "turn", "text")


@query("w7_keep_last", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn <= 20")
def w7(spark, d):
    return H.keep_last(table(spark, d, "events"), ["user_id"], [F.desc("event_id")], 20).select("user_id", "event_id")


@query("w17_numbering", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS no, ((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 8)::BIGINT AS batch FROM conversations")
def w17_n19(spark, d):
    rn = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return conv(spark, d).select("conv_id", "turn", rn.cast("long").alias("no"), F.floor((rn - 1) / 8).alias("batch"))


@query("w13_carry_forward", """SELECT doc_id, line_no::BIGINT AS line_no, last_value(CASE WHEN length(line) < 60 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)""")
def w13(spark, d):
    from .texts import exploded

    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return exploded(spark, d).select("doc_id", "line_no", F.last(F.when(F.length("line") < 60, F.col("line")), ignorenulls=True).over(w).alias("section"))


@query("w12_english_runs", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
e AS (SELECT *, length(line) > 0 AND len(regexp_extract_all(line, '[a-zA-Z]')) / length(line) > 0.7 AS eng FROM l), i AS (SELECT *, sum(CASE WHEN eng THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY n) AS island FROM e),
s AS (SELECT *, min(CASE WHEN length(line) > 50 THEN n END) OVER (PARTITION BY doc_id, island) AS start FROM i WHERE eng)
SELECT doc_id, min(n)::BIGINT AS first_line, max(n)::BIGINT AS last_line, CASE WHEN sum(length(line)) + 2 * (count(*) - 1) > 200 THEN 'high' ELSE 'warning' END AS severity FROM s WHERE n >= start GROUP BY doc_id, island""")
def w12(spark, d):
    """A run can only start at a line of more than 50 characters: shorter ones before it are cut off."""
    from .texts import exploded

    size = F.length("line")
    eng = (size > 0) & (F.regexp_count("line", F.lit("[a-zA-Z]")) / size > 0.7)
    i = H.islands(exploded(spark, d), "doc_id", ["line_no"], eng)
    s = i.withColumn("start", F.min(F.when(size > 50, F.col("line_no"))).over(Window.partitionBy("doc_id", "island"))).filter("line_no >= start")
    total = F.sum(F.length("line")) + 2 * (F.count("*") - 1)
    return s.groupBy("doc_id", "island").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.when(total > 200, "high").otherwise("warning").alias("severity")).drop("island")


@query("g19_history_text", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history FROM conversations GROUP BY conv_id")
def g19(spark, d):
    parts = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("s"))))
    return conv(spark, d).groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["s"]), "\n").alias("history"))


@query("a6_sessions", "SELECT conv_id, count(*)::BIGINT AS turns, min(turn)::BIGINT AS first_turn, arg_min(role, turn) AS opened_by FROM conversations GROUP BY conv_id")
def a6(spark, d):
    return conv(spark, d).groupBy("conv_id").agg(F.count("*").alias("turns"), F.min("turn").alias("first_turn"), F.min_by("role", "turn").alias("opened_by"))


@query("a4_last_entry", "SELECT conv_id, arg_max(role, turn) AS role, arg_max(text, turn) AS text, max(turn) AS turn FROM conversations GROUP BY conv_id")
def a4(spark, d):
    return conv(spark, d).groupBy("conv_id").agg(F.max_by(F.struct("role", "text", "turn"), "turn").alias("m")).select("conv_id", "m.role", "m.text", "m.turn")


@query("r2_coalesced_turns", """WITH n AS (SELECT user_id, event_id, event_type, value, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM (SELECT n.*, e.ts FROM n JOIN events e USING (event_id)))
SELECT user_id, min(event_id) AS event_id, event_type, count(*)::BIGINT AS merged, round(sum(value), 6) AS value FROM i GROUP BY user_id, island, event_type""")
def r2(spark, d):
    e = table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.when(F.lag("event_type").over(w).eqNullSafe(F.col("event_type")), 0).otherwise(1)
    i = e.withColumn("new", new).withColumn("island", F.sum("new").over(w))
    return i.groupBy("user_id", "island", "event_type").agg(F.min("event_id").alias("event_id"), F.count("*").alias("merged"), F.round(F.sum("value"), 6).alias("value")).drop("island")
