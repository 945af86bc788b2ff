"""Queries on changes: replay, upsert, delete, toggles, typed unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes as C
from .registry import query, table

OPS = "log AS (SELECT event_id AS seq, user_id AS key, CASE event_type WHEN 'error' THEN 'del' WHEN 'click' THEN 'add' ELSE 'update' END AS op, value FROM events)"


def _log(spark, d):
    op = F.when(F.col("event_type") == "error", "del").when(F.col("event_type") == "click", "add").otherwise("update")
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"), op.alias("op"), "value")


@query("a27_replay", f"WITH {OPS} SELECT seq, key, op, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1 AND op <> 'del'")
def a27(spark, d):
    return C.replay(_log(spark, d), "key", "seq", "op")


@query("m5_latest", f"WITH {OPS} SELECT seq, key, op, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1")
def m5(spark, d):
    return C.latest(_log(spark, d), "key", "seq")


@query("m1_upsert", """SELECT c_custkey, c_name, c_acctbal + 1 AS c_acctbal, c_nationkey::BIGINT AS created_at FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, c_name, c_acctbal, c_nationkey FROM customer WHERE c_custkey % 3 <> 0
UNION ALL SELECT s_suppkey + 10000000, s_name, s_acctbal, -1 FROM supplier""")
def m1(spark, d):
    old = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", F.col("c_nationkey").cast("long").alias("created_at"))
    again = old.filter("c_custkey % 3 = 0").select("c_custkey", "c_name", (F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit(-1).cast("long").alias("created_at"))
    new = table(spark, d, "supplier").select((F.col("s_suppkey") + 10000000).alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal"), F.lit(-1).cast("long").alias("created_at"))
    return C.upsert(old, again.unionByName(new), "c_custkey")


@query("m2_delete", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def m2(spark, d):
    gone = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return C.delete(table(spark, d, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey")


@query("m3_s7_typed_chunks", """SELECT doc_id, 'text' AS chunk_type, substr(text, 1, 300) AS chunk FROM documents UNION ALL SELECT page_id, 'table', substr(html, 1, 500) FROM pages UNION ALL SELECT item_id, 'formula', substr(text, 1, 300) FROM benchmark""")
def m3(spark, d):
    part = lambda t, key, c, kind, n: table(spark, d, t).select(F.col(key).alias("doc_id"), F.lit(kind).alias("chunk_type"), F.substring(c, 1, n).alias("chunk"))
    return part("documents", "doc_id", "text", "text", 300).unionByName(part("pages", "page_id", "html", "table", 500)).unionByName(part("benchmark", "item_id", "text", "formula", 300))


@query("m6_update", "SELECT p_partkey, CASE WHEN p_size < 10 THEN p_retailprice + 5 ELSE p_retailprice END AS p_retailprice FROM part")
def m6(spark, d):
    p = table(spark, d, "part")
    patch = p.filter("p_size < 10").select("p_partkey", (F.col("p_retailprice") + 5).alias("p_retailprice"))
    return C.update(p, patch, "p_partkey", ["p_retailprice"]).select("p_partkey", "p_retailprice")


@query("m7_toggles", "SELECT user_id, event_type FROM events GROUP BY 1, 2 HAVING count(*) % 2 = 1")
def m7(spark, d):
    return C.toggled(table(spark, d, "events"), ["user_id", "event_type"])


@query("m7_last_note", "SELECT user_id, arg_max(event_type, event_id) AS note FROM events GROUP BY user_id")
def m7_note(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("note"))


@query("m8_newest_first", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def m8(spark, d):
    return table(spark, d, "orders").filter("o_orderstatus <> 'F'").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice")


@query("m13_preferred", "SELECT name, key FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY pri) AS rn FROM (SELECT n_name AS name, n_nationkey::BIGINT AS key, 1 AS pri FROM nation UNION ALL SELECT r_name, r_regionkey, 0 FROM region UNION ALL SELECT n_name, n_regionkey, 0 FROM nation WHERE n_nationkey < 9)) WHERE rn = 1")
def m13(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    rows = n.select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("key"), F.lit(1).alias("pri"))
    rows = rows.unionByName(r.select(F.col("r_name").alias("name"), F.col("r_regionkey").cast("long").alias("key"), F.lit(0).alias("pri")))
    rows = rows.unionByName(n.filter("n_nationkey < 9").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("key"), F.lit(0).alias("pri")))
    return C.preferred(rows, "name", "pri").select("name", "key")


@query("a12_j6_unlisted", "SELECT doc_id, quality::BIGINT AS quality FROM labels UNION ALL SELECT doc_id, NULL FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)".replace("quality::BIGINT AS quality", "quality::BIGINT + 1 AS quality").replace("NULL FROM documents", "0 FROM documents"))
def a12(spark, d):
    index = table(spark, d, "labels").select("doc_id", (F.col("quality").cast("long") + 1).alias("quality"))
    return C.unlisted(table(spark, d, "documents").select("doc_id"), index, "doc_id").select("doc_id", F.coalesce("quality", F.lit(0)).alias("quality"))


@query("s6_s9_first_seen", "SELECT text_form, min(doc_id) AS doc_id FROM (SELECT doc_id, regexp_replace(text, '\\s+', ' ', 'g') AS text_form FROM documents) GROUP BY 1")
def s6(spark, d):
    t = table(spark, d, "documents").select(F.regexp_replace("text", r"\s+", " ").alias("text_form"), "doc_id")
    return C.first_seen(t, "text_form", "doc_id")


@query("j14_runs", "SELECT o.o_orderkey, coalesce(c.c_name, 'unknown') AS name, coalesce(n.n_name, 'unknown') AS nation, coalesce(l.total, 0.0) AS total FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o_custkey = c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN (SELECT l_orderkey, round(sum(l_quantity), 6) AS total FROM lineitem WHERE l_quantity > 10 GROUP BY 1) l ON l.l_orderkey = o.o_orderkey")
def j14(spark, d):
    c = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name", F.col("c_nationkey").alias("n_nationkey"))
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    q = table(spark, d, "lineitem").filter("l_quantity > 10").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum("l_quantity"), 6).alias("total"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(c, "o_custkey", "left").join(F.broadcast(n), "n_nationkey", "left").join(q, "o_orderkey", "left")
    return o.select("o_orderkey", F.coalesce("c_name", F.lit("unknown")).alias("name"), F.coalesce("n_name", F.lit("unknown")).alias("nation"), F.coalesce("total", F.lit(0.0)).alias("total"))


@query("j17_positional", "WITH a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations), b AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) SELECT a.conv_id, a.turn, b.value FROM a JOIN b ON a.conv_id = b.user_id AND a.rn = b.rn")
def j17(spark, d):
    from pyspark.sql import Window

    a = table(spark, d, "conversations").select(F.col("conv_id").alias("k"), "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("rn"))
    b = table(spark, d, "events").select(F.col("user_id").alias("k"), "value", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("rn"))
    return a.join(b, ["k", "rn"]).select(F.col("k").alias("conv_id"), "turn", "value")
