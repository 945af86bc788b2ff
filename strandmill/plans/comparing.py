"""Queries on comparison: overlaps, gaps, leaderboards, running counts, set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as X
from ..operators import comparing as C
from .registry import query, table

TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
FEAT = rf"f AS (SELECT DISTINCT lang || '/' || source AS item, feature FROM (SELECT lang, source, unnest({TOK}) AS feature FROM documents) WHERE length(feature) >= 14)"


def _features(spark, d):
    t = table(spark, d, "documents").select(F.concat_ws("/", "lang", "source").alias("item"), F.explode(X.tokens(F.col("text"))).alias("feature"))
    return t.filter(F.length("feature") >= 14)


@query("j7_s2_overlaps", f"""WITH {FEAT}, n AS (SELECT item, count(*) AS n FROM f GROUP BY item), p AS (SELECT x.item AS a, y.item AS b, count(*) AS shared FROM f x JOIN f y ON x.feature = y.feature AND x.item < y.item GROUP BY 1, 2)
SELECT a, b, shared::BIGINT AS shared, round(shared / greatest(na.n + nb.n - shared, 1), 6) AS jaccard FROM p JOIN n na ON na.item = a JOIN n nb ON nb.item = b""")
def j7(spark, d):
    return C.overlaps(_features(spark, d), "item", "feature").select("a", "b", "shared", F.round("jaccard", 6).alias("jaccard"))


@query("j8_s3_shared_customers", """WITH f AS (SELECT DISTINCT n_name AS item, o_orderdate::DATE AS feature FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
i AS (SELECT DISTINCT item FROM f), p AS (SELECT x.item AS a, y.item AS b, count(*) AS shared FROM f x JOIN f y ON x.feature = y.feature AND x.item < y.item GROUP BY 1, 2)
SELECT x.item AS a, y.item AS b, coalesce(shared, 0)::BIGINT AS shared FROM i x JOIN i y ON x.item < y.item LEFT JOIN p ON p.a = x.item AND p.b = y.item""")
def j8(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("item"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey").join(F.broadcast(n), "c_nationkey")
    f = table(spark, d, "orders").join(c, "o_custkey").select("item", F.to_date("o_orderdate").alias("feature"))
    return C.all_pairs(f, C.overlaps(f, "item", "feature"), "item").select("a", "b", "shared")


@query("g16_feature_sets", rf"SELECT lang || '/' || source AS item, count(DISTINCT feature)::BIGINT AS features FROM (SELECT lang, source, unnest({TOK}) AS feature FROM documents) WHERE length(feature) >= 14 GROUP BY 1")
def g16(spark, d):
    return _features(spark, d).groupBy("item").agg(F.countDistinct("feature").alias("features"))


SCORES = "s AS (SELECT source AS item, lang AS dim, avg(n_chars) / 1000 AS score FROM documents GROUP BY 1, 2)"


def _scores(spark, d):
    return table(spark, d, "documents").groupBy(F.col("source").alias("item"), F.col("lang").alias("dim")).agg((F.avg("n_chars") / 1000).alias("score"))


@query("j11_w6_gaps", f"""WITH {SCORES} SELECT a, b, dim, round(delta, 6) AS delta FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY delta DESC, dim) AS rn FROM (SELECT x.item AS a, y.item AS b, x.dim, abs(x.score - y.score) AS delta FROM s x JOIN s y ON x.dim = y.dim AND x.item < y.item)) WHERE rn <= 3""")
def j11(spark, d):
    return C.gaps(_scores(spark, d), "item", "dim", "score").withColumn("delta", F.round("delta", 6))


@query("g20_matrix", f"WITH {SCORES} SELECT item, " + ", ".join(f"coalesce(round(max(CASE WHEN dim = '{k}' THEN score END), 6), 5.0) AS {k}" for k in ("de", "en", "es", "fr", "zh")) + " FROM s GROUP BY item")
def g20(spark, d):
    return C.matrix(_scores(spark, d).withColumn("score", F.round("score", 6)), "item", "dim", "score", ["de", "en", "es", "fr", "zh"])


@query("g8_mean_score", f"WITH {SCORES} SELECT item, round(avg(score), 6) AS mean FROM s GROUP BY item")
def g8(spark, d):
    return _scores(spark, d).groupBy("item").agg(F.round(F.avg("score"), 6).alias("mean"))


@query("g4_w5_leaderboard", "SELECT *, row_number() OVER (ORDER BY mean DESC, user_id)::BIGINT AS place FROM (SELECT user_id, round(avg(value), 6) AS mean, round(max(value), 6) AS best, count(*)::BIGINT AS n, round(stddev_pop(value), 6) AS spread FROM events GROUP BY user_id)")
def g4(spark, d):
    """Places are dealt to groups, whose number is small against the rows; sums that decide a rounding are taken in the order of the table, that of event_id."""
    g = C.leaderboard(table(spark, d, "events"), "user_id", "value", 6, order="event_id")
    return g.withColumn("place", F.col("place").cast("long"))


@query("w1_running_counts", "SELECT event_id, event_type, count(*) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS so_far FROM events")
def w1(spark, d):
    w = Window.partitionBy("event_type", "user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", "event_type", F.count("*").over(w).alias("so_far"))


@query("w1_topics_over_time", "WITH t AS (SELECT lang AS topic, doc_id % 31 AS day, count(*) AS n FROM documents GROUP BY 1, 2), g AS (SELECT * FROM (SELECT DISTINCT topic FROM t), (SELECT DISTINCT day FROM t)) SELECT day, topic, sum(coalesce(n, 0)) OVER (PARTITION BY topic ORDER BY day)::BIGINT AS so_far FROM g LEFT JOIN t USING (topic, day)")
def w1_grid(spark, d):
    """The running count of every topic on every day: a grid of the two with the day's counts, then a running sum."""
    t = table(spark, d, "documents").groupBy(F.col("lang").alias("topic"), (F.col("doc_id") % 31).alias("day")).agg(F.count("*").alias("n"))
    grid = t.select("topic").distinct().crossJoin(F.broadcast(t.select("day").distinct()))
    w = Window.partitionBy("topic").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(t, ["topic", "day"], "left").select("day", "topic", F.sum(F.coalesce("n", F.lit(0))).over(w).alias("so_far"))


@query("g5_category_counts", "SELECT event_type AS category, count(*)::BIGINT AS n FROM events GROUP BY 1")
def g5(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("category")).agg(F.count("*").alias("n"))


@query("g7_totals", "SELECT sum(coalesce(quality, 0))::BIGINT AS quality, sum(coalesce(toxic, 0))::BIGINT AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def g7(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").agg(F.sum(F.coalesce("quality", F.lit(0))).alias("quality"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))


@query("g3_ranges", "SELECT coalesce(min(value), 0) AS low, coalesce(max(value), 1) AS high FROM events WHERE event_type = 'none'")
def g3(spark, d):
    return table(spark, d, "events").filter("event_type = 'none'").agg(F.coalesce(F.min("value"), F.lit(0.0)).alias("low"), F.coalesce(F.max("value"), F.lit(1.0)).alias("high"))


@query("g10_s5_missing_numbers", "SELECT l_orderkey AS order_key, count(*)::BIGINT AS missing FROM (SELECT l_orderkey, unnest(range(min(l_linenumber), max(l_linenumber) + 1)) AS n FROM lineitem GROUP BY 1) r WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = r.l_orderkey AND l.l_linenumber = r.n) GROUP BY 1")
def g10(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("order_key")).agg(F.array_except(F.sequence(F.min("l_linenumber"), F.max("l_linenumber")), F.collect_set("l_linenumber")).alias("m"))
    return g.filter(F.size("m") > 0).select("order_key", F.size("m").cast("long").alias("missing"))


@query("g12_c26_audit", "SELECT source, bool_and(n_chars >= 20) AND avg(n_chars) >= 60 AS passed, count(*) FILTER (WHERE n_chars < 200)::BIGINT AS severe, count(*) FILTER (WHERE n_chars BETWEEN 200 AND 499)::BIGINT AS minor FROM documents GROUP BY source")
def g12(spark, d):
    return table(spark, d, "documents").groupBy("source").agg((F.bool_and(F.col("n_chars") >= 20) & (F.avg("n_chars") >= 60)).alias("passed"), F.count_if(F.col("n_chars") < 200).alias("severe"), F.count_if(F.col("n_chars").between(200, 499)).alias("minor"))


@query("g15_map_merge", "SELECT user_id, 'k' AS name, sum((props->>'k')::BIGINT)::BIGINT AS total FROM events GROUP BY user_id")
def g15(spark, d):
    m = F.from_json("props", "map<string,bigint>")
    return table(spark, d, "events").select("user_id", F.explode(m).alias("name", "v")).groupBy("user_id", "name").agg(F.sum("v").alias("total"))


@query("g18_repeats", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, lower(event_type) ORDER BY event_id) AS rn FROM events) WHERE rn > 2")
def g18(spark, d):
    w = Window.partitionBy("user_id", F.lower("event_type")).orderBy("event_id")
    return table(spark, d, "events").withColumn("rn", F.row_number().over(w)).filter("rn > 2").select("user_id", "event_id")


@query("g21_next_wake", "SELECT min(value) AS wake FROM events WHERE event_type <> 'error' AND value > 1")
def g21(spark, d):
    return table(spark, d, "events").filter("event_type <> 'error' AND value > 1").agg(F.min("value").alias("wake"))


@query("m10_n10_runs", """WITH t AS (SELECT DISTINCT lang AS topic FROM documents), s AS (SELECT unnest([1, 2, 3, 7, 11]) AS seed), r AS (SELECT topic, seed, round(0.6 + (seed % 5) * 0.04 + 8 * 0.01, 4) AS f, round(0.7 + (seed % 4) * 0.03 + 8 * 0.012, 4)::DOUBLE AS b FROM t, s)
SELECT topic, count(*)::BIGINT AS runs, round(avg(f), 6) AS mean_final, max(b) AS best, round(stddev_pop(f), 6) AS spread FROM r GROUP BY topic""")
def m10(spark, d):
    topics = table(spark, d, "documents").select(F.col("lang").alias("topic")).distinct()
    seeds = spark.createDataFrame([(s,) for s in (1, 2, 3, 7, 11)], "seed int")
    f, b = S.synthetic(F.col("seed"), F.lit(8))
    return topics.crossJoin(F.broadcast(seeds)).select("topic", f.alias("f"), b.alias("b")).groupBy("topic").agg(F.count("*").alias("runs"), F.round(F.avg("f"), 6).alias("mean_final"), F.max("b").alias("best"), F.round(F.stddev_pop("f"), 6).alias("spread"))


@query("m11_suggest", "SELECT lang, string_agg(item_title, '; ' ORDER BY doc_id) AS titles FROM (SELECT lang, doc_id, substr(text, 1, 20) AS item_title, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 3 GROUP BY lang")
def m11(spark, d):
    from ..operators.histories import keep_last

    t = keep_last(table(spark, d, "documents"), ["lang"], [F.col("doc_id")], 3)
    return t.groupBy("lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", F.substring("text", 1, 20).alias("t")))), lambda x: x["t"]), "; ").alias("titles"))


@query("j15_j16_citation_edges", """WITH n AS (SELECT DISTINCT p_brand AS id FROM part WHERE p_size > 10), e AS (SELECT DISTINCT p_brand AS source, p_type AS target FROM part), rel AS (SELECT p_type AS target, min(p_size) AS k FROM part WHERE p_retailprice > 950 GROUP BY 1)
SELECT e.source, e.target, coalesce(CASE WHEN k < 10 THEN 'method' ELSE 'compare' END, 'background') AS relation FROM e LEFT JOIN rel USING (target) WHERE e.source IN (SELECT id FROM n)""".replace("coalesce(CASE WHEN k < 10 THEN 'method' ELSE 'compare' END, 'background')", "CASE WHEN k IS NULL THEN 'background' WHEN k < 10 THEN 'method' ELSE 'compare' END"))
def j15(spark, d):
    p = table(spark, d, "part")
    nodes = p.filter("p_size > 10").select(F.col("p_brand").alias("source")).distinct()
    edges = p.select(F.col("p_brand").alias("source"), F.col("p_type").alias("target")).distinct()
    rel = p.filter("p_retailprice > 950").groupBy(F.col("p_type").alias("target")).agg(F.min("p_size").alias("k"))
    relation = F.coalesce(F.when(F.col("k") < 10, "method").when(F.col("k") >= 10, "compare"), F.lit("background"))
    return edges.join(nodes, "source", "left_semi").join(rel, "target", "left").select("source", "target", relation.alias("relation"))


@query("j21_cross_check", "SELECT (SELECT count(*) FROM documents)::BIGINT AS formulas, (SELECT count(*) FROM labels)::BIGINT AS cards, CASE WHEN (SELECT count(*) FROM labels) < (SELECT count(*) FROM documents) * 0.5 THEN 'warn' ELSE 'ok' END AS state")
def j21(spark, d):
    a = table(spark, d, "documents").agg(F.count("*").alias("formulas"))
    b = table(spark, d, "labels").agg(F.count("*").alias("cards"))
    return a.crossJoin(b).withColumn("state", F.when(F.col("cards") < F.col("formulas") * 0.5, "warn").otherwise("ok"))


@query("j10_band_join", """SELECT event_id, near FROM (SELECT a.event_id, b.event_id AS near, row_number() OVER (PARTITION BY a.event_id ORDER BY b.ts, b.event_id) AS rn FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts < a.ts + INTERVAL 70 MINUTE WHERE a.event_type = 'click') WHERE rn = 1""")
def j10(spark, d):
    """The next event within 70 minutes. Times are cut into steps of 70 minutes; a row meets its own step and the next by equality."""
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 4200).alias("step"))
    a = e.filter("event_type = 'click'").withColumn("step", F.explode(F.array(F.col("step"), F.col("step") + 1)))
    b = e.select("user_id", "step", F.col("event_id").alias("near"), F.col("ts").alias("at"))
    j = a.join(b, ["user_id", "step"]).filter("at > ts AND at < ts + INTERVAL 70 MINUTES")
    return j.groupBy("event_id").agg(F.min(F.struct("at", "near")).alias("m")).select("event_id", "m.near")


@query("c28_edits", """WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL AND len(string_split(text, chr(10))) >= 3 AND NOT regexp_matches(text, '[‘’“”]')),
e AS (SELECT doc_id, text, a, doc_id % 4 AS k, a[2] || chr(10) || a[3] AS pair FROM l),
o AS (SELECT *, CASE k WHEN 0 THEN pair WHEN 1 THEN '  ' || a[2] || chr(10) || a[3] || '   ' WHEN 2 THEN ' ' || replace(replace(pair, 'a', '’'), chr(10), '  ' || chr(10)) ELSE replace(a[2], 'a', '’') END AS old,
CASE WHEN k < 2 THEN text ELSE replace(text, 'a', chr(39)) END AS content FROM e),
w AS (SELECT *, string_split(content, chr(10)) AS c, list_transform(string_split(replace(old, '’', chr(39)), chr(10)), lambda x: trim(x, ' ')) AS t FROM o WHERE trim(a[2], ' ') <> '' AND trim(a[3], ' ') <> '' AND text NOT LIKE '%' || chr(10)),
f AS (SELECT *, list_filter(range(1, len(c) - len(t) + 2), lambda i: list_transform(c[i : i + len(t) - 1], lambda x: trim(x, ' ')) = t) AS hit, (length(content) - length(replace(content, replace(old, '’', chr(39)), ''))) // length(old) AS n FROM w)
SELECT doc_id, CASE WHEN contains(content, old) THEN 'exact' WHEN len(hit) > 0 AND k = 1 THEN 'lines' WHEN len(hit) > 0 AND contains(old, '’') THEN 'lines_quotes' WHEN len(hit) > 0 THEN 'lines' WHEN n > 0 THEN 'quotes' END AS way,
(CASE WHEN contains(content, old) THEN n WHEN len(hit) > 0 THEN len(hit) ELSE n END)::BIGINT AS matches FROM f""")
def c28(spark, d):
    """Edits of documents with three lines or more: as they are, with other blanks around, with curly quotes for straight ones, or a line with them."""
    from ..operators import edits

    t = table(spark, d, "documents").filter("text IS NOT NULL AND text NOT RLIKE '[‘’“”]' AND text NOT LIKE '%\n'").withColumn("a", F.split("text", "\n", -1)).filter("size(a) >= 3 AND trim(a[1]) <> '' AND trim(a[2]) <> ''")
    k, a = F.col("doc_id") % 4, F.col("a")
    pair = F.concat(a[1], F.lit("\n"), a[2])
    curly = lambda x: F.replace(x, F.lit("a"), F.lit("’"))
    old = F.when(k == 0, pair).when(k == 1, F.concat(F.lit("  "), pair, F.lit("   "))).when(k == 2, F.concat(F.lit(" "), F.replace(curly(pair), F.lit("\n"), F.lit("  \n")))).otherwise(curly(a[1]))
    content = F.when(k < 2, F.col("text")).otherwise(F.replace("text", F.lit("a"), F.lit("'")))
    return edits.located(t.select("doc_id", content.alias("content"), old.alias("old")), "content", "old").select("doc_id", "way", "matches")
