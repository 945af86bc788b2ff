"""Queries on retrieval: keyword ranking, vectors, fusion, context."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import bm25, vectors
from .registry import query, table

ASKED = "the and which"
TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
BM25 = rf"""t AS (SELECT doc_id, {TOK} AS a FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(a) AS term FROM t) WHERE term IN ('the', 'and', 'which') GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), st AS (SELECT count(*) AS n, sum(len(a)) / greatest(1, count(*)) AS avgdl FROM t),
bm AS (SELECT doc_id AS doc, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(a) / avgdl))) AS score FROM tf JOIN df USING (term) JOIN t USING (doc_id) CROSS JOIN st GROUP BY 1)"""
QV = "qv AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"
COS = f"{QV}, cs AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS score FROM embeddings, qv), top AS (SELECT * FROM (SELECT * FROM cs ORDER BY score DESC, vec_id LIMIT 20) WHERE score > 0)"


def query_vector(spark, d):
    """The vector of row 0, which stands for an embedded question."""
    row = table(spark, d, "embeddings").filter("vec_id = 0").select("embedding").first()
    return list(row[0])


@query("bm25_top20", f"WITH {BM25} SELECT doc AS doc_id, round(score, 6) AS score FROM bm ORDER BY score DESC, doc LIMIT 20")
def g2(spark, d):
    return bm25.search(table(spark, d, "documents"), ASKED).select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


@query("bm25_indexed", f"WITH {BM25} SELECT doc AS doc_id, round(score, 6) AS score FROM bm")
def g2_indexed(spark, d):
    index = bm25.Index.fit(table(spark, d, "documents")).written()
    return bm25.score_indexed(index, ASKED).select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


@query("g1_term_stats", rf"SELECT term, count(DISTINCT doc_id)::BIGINT AS df, count(*)::BIGINT AS cf FROM (SELECT doc_id, unnest({TOK}) AS term FROM documents) GROUP BY term")
def g1(spark, d):
    return bm25.Index.fit(table(spark, d, "documents")).postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query("g1_corpus_stats", rf"SELECT count(*)::BIGINT AS n, round(sum(len({TOK})) / greatest(1, count(*)), 6) AS avgdl FROM documents")
def g1_stats(spark, d):
    return bm25.Index.fit(table(spark, d, "documents")).stats.select("n", F.round("avgdl", 6).alias("avgdl"))


@query("t2_cosine_top20", f"WITH {COS} SELECT vec_id, round(score, 6) AS score FROM top")
def t2(spark, d):
    return vectors.search(table(spark, d, "embeddings"), query_vector(spark, d)).select("vec_id", F.round("score", 6).alias("score"))


def _legs(spark, d):
    lexical = bm25.search(table(spark, d, "documents"), ASKED).select(F.col("doc").alias("id"), "score")
    dense = vectors.search(table(spark, d, "embeddings"), query_vector(spark, d)).select(F.col("vec_id").alias("id"), "score")
    return lexical, dense


FUSE = f"""{BM25}, {COS}, a AS (SELECT doc AS id, score FROM bm ORDER BY score DESC, doc LIMIT 20), b AS (SELECT vec_id AS id, score FROM top),
ra AS (SELECT coalesce(min(score), 0) AS lo, coalesce(max(score), 1) AS hi FROM a), rb AS (SELECT coalesce(min(score), 0) AS lo, coalesce(max(score), 1) AS hi FROM b),
fused AS (SELECT coalesce(a.id, b.id) AS id, 0.3 * (coalesce(a.score, 0) - ra.lo) / greatest(ra.hi - ra.lo, 0.001) + 0.7 * (coalesce(b.score, 0) - rb.lo) / greatest(rb.hi - rb.lo, 0.001) AS score FROM a FULL JOIN b ON a.id = b.id CROSS JOIN ra CROSS JOIN rb)"""


@query("j1_n9_fuse", f"WITH {FUSE} SELECT id, round(score, 6) AS score FROM fused")
def j1(spark, d):
    return vectors.fuse(*_legs(spark, d), "id").select("id", F.round("score", 6).alias("score"))


@query("j2_c2_hybrid_search", f"""WITH {FUSE} SELECT f.id, round(f.score, 6) AS score, d.lang, substr(d.text, 1, 1200) AS text FROM (SELECT * FROM fused ORDER BY score DESC, id LIMIT 20) f JOIN documents d ON d.doc_id = f.id WHERE d.lang = 'en' ORDER BY f.score DESC, f.id LIMIT 5""")
def j2(spark, d):
    """The tag filter comes after the coarse cut, as part of what is asked."""
    top = vectors.fuse(*_legs(spark, d), "id").orderBy(F.desc("score"), "id").limit(20)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", F.substring("text", 1, 1200).alias("text"))
    return docs.join(F.broadcast(top), "id").filter("lang = 'en'").orderBy(F.desc("score"), "id").limit(5).select("id", F.round("score", 6).alias("score"), "lang", "text")


@query("s1_union_ids", f"WITH {BM25}, {COS} SELECT doc AS id FROM (SELECT doc FROM bm ORDER BY score DESC, doc LIMIT 20) UNION SELECT vec_id FROM top")
def s1(spark, d):
    a, b = _legs(spark, d)
    return a.select("id").union(b.select("id")).distinct()


@query("w2_context", f"""WITH {FUSE}, r AS (SELECT f.id, f.score, substr(d.text, 1, 1200) AS text FROM fused f JOIN documents d ON d.doc_id = f.id),
s AS (SELECT id, text, sum(length(text)) OVER (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS used FROM r) SELECT id, used::BIGINT AS used, text FROM s WHERE used <= 4000""")
def w2(spark, d):
    """At most forty rows are ordered, so one task is enough."""
    f = vectors.fuse(*_legs(spark, d), "id")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 1200).alias("text"))
    r = docs.join(F.broadcast(f), "id")
    return vectors.context(r, F.col("text"), 4000, [F.desc("score"), "id"]).select("id", "used", "text")


@query("j4_t4_t11_rerank", f"""WITH {COS}, rr AS (SELECT vec_id, (label + 1)::DOUBLE AS score FROM embeddings WHERE label < 5)
SELECT vec_id, round(score, 6) AS score FROM (SELECT top.vec_id, coalesce(rr.score, top.score) AS score FROM top LEFT JOIN rr USING (vec_id)) ORDER BY score DESC, vec_id LIMIT 5""")
def j4(spark, d):
    e = table(spark, d, "embeddings")
    found = vectors.search(e, query_vector(spark, d))
    given = e.filter("label < 5").select("vec_id", (F.col("label") + 1).cast("double").alias("score"))
    return vectors.rerank(found, given, "vec_id", 5).select("vec_id", F.round("score", 6).alias("score"))


@query("t10_j18_remembered", f"WITH {QV}, s AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], q) * (0.5 + 0.5 * label / 10) AS score FROM embeddings, qv ORDER BY score DESC, vec_id LIMIT 3) SELECT vec_id, round(score, 6) AS score FROM s WHERE score > 0.2")
def t10(spark, d):
    return vectors.remembered(table(spark, d, "embeddings"), query_vector(spark, d), "embedding", "label", "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query("n7_hashed_vector", rf"""WITH t AS (SELECT item_id, unnest({TOK}) AS tok FROM benchmark), c AS (SELECT item_id, (('0x' || substr(md5(tok), 1, 8))::BIGINT % 16)::BIGINT AS slot, count(*) AS n FROM t GROUP BY ALL)
SELECT item_id, slot, round(n / sqrt(sum(n * n) OVER (PARTITION BY item_id)), 6) AS value FROM c""")
def n7(spark, d):
    v = vectors.hashed_counts(X.tokens(F.col("text")), 16)
    return table(spark, d, "benchmark").select("item_id", F.posexplode(v).alias("slot", "value")).filter("value > 0").select("item_id", F.col("slot").cast("long").alias("slot"), F.round("value", 6).alias("value"))


@query("a24_vector_load", "SELECT vec_id, label::BIGINT AS label, len(embedding)::BIGINT AS dim, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
def a24(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), F.size("embedding").cast("long").alias("dim"), F.round(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("g6_snapshot", "SELECT count(*)::BIGINT AS papers, sum(len(string_split(text, chr(10))))::BIGINT AS chunks FROM documents")
def g6(spark, d):
    return table(spark, d, "documents").agg(F.count("*").alias("papers"), F.sum(F.size(X.lines(F.col("text")))).cast("long").alias("chunks"))


@query("g23_chunk_count", "SELECT doc_id, len(string_split(text, chr(10)))::BIGINT AS chunk_count FROM documents")
def g23(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(X.lines(F.col("text"))).cast("long").alias("chunk_count"))


@query("c1_projection", "SELECT doc_id, round(n_chars / 7.0, 6) AS score, substr(text, 1, 1200) AS text FROM documents")
def c1(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(F.col("n_chars") / 7.0, 6).alias("score"), F.substring("text", 1, 1200).alias("text"))


@query("n15_parse_scores", r"SELECT item_id, coalesce(least(10, greatest(1, try_cast(regexp_extract(text, '(\d+)', 1) AS BIGINT))), 5)::BIGINT AS score FROM benchmark")
def n15(spark, d):
    from ..functions.scoring import parsed_score

    return table(spark, d, "benchmark").select("item_id", parsed_score(F.col("text")).alias("score"))


def _by_length(texts):
    """Answers a rerank by the length of each candidate, leaves out every fourth, and fails on batches of many."""
    import re

    if len(texts) > 3:
        raise TimeoutError
    return ["\n".join(f"<{i}>: {len(body) % 12}" for i, body in re.findall(r"<(\d+)>(.*?)</\1>", t, re.DOTALL) if int(i) % 4 != 3) for t in texts]


@query("l9_rerank", """WITH n AS (SELECT count(*) AS n FROM benchmark), c AS (SELECT item_id, doc_id, least(length(coalesce(d.text, '')), 500) AS len, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) - 1 AS no FROM documents d, benchmark b, n WHERE d.doc_id % n.n = b.item_id),
k AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS size FROM c WHERE no < 20),
s AS (SELECT *, CASE WHEN size <= 2 THEN 10.0 WHEN no % 4 = 3 THEN 5.0 ELSE least(10.0, greatest(1.0, len % 12)) END::DOUBLE AS score FROM k)
SELECT item_id, doc_id AS doc, score, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, no) AS place FROM s) WHERE place <= 2""")
def l9(spark, d):
    """Items of the benchmark as queries, each with the documents of its remainder as candidates; the stub rates them by length."""
    from ..operators import calls

    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("asked"))
    c = table(spark, d, "documents").select("doc_id", F.coalesce(F.translate("text", "<>", "  "), F.lit("")).alias("text"), (F.col("doc_id") % F.lit(b.count())).alias("item_id"))
    return calls.rerank(c.join(F.broadcast(b), "item_id"), "item_id", "asked", "doc_id", "text", "doc_id", _by_length, top=2)


@query("l8_scores", """SELECT conv_id, dimension, CASE WHEN len % 7 <> 0 THEN least(10.0, greatest(1.0, len % 13))::DOUBLE END AS score, CASE WHEN len % 7 = 0 THEN 'missing score' END AS error
FROM (SELECT conv_id, x AS dimension, length('Score ' || x || ' from 1 to 10:' || chr(10)) + least(3000, sum(length(text))) AS len FROM conversations, (VALUES ('novelty'), ('method')) v(x) GROUP BY conv_id, x)""")
def l8(spark, d):
    """Conversations scored in two dimensions by a stub that gives no number for every seventh length."""
    from ..operators import calls

    t = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.collect_list("text"), "").alias("t"))
    fn = lambda texts: [f"I say {len(x) % 13}" if len(x) % 7 else "cannot say" for x in texts]
    return calls.scored(t, "conv_id", "t", ["novelty", "method"], fn)
