"""Queries on formulas, sequential rules, model functions and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formula as M
from ..functions import text as X
from ..operators import folds, models
from ..sources import shared
from ..streaming import live
from . import texts  # noqa: F401  its SQL is used below
from .registry import ORACLES, query, table


@query("c16_math_font", "SELECT p_partkey, regexp_matches(p_name || '-' || p_type, '(?i)CM(?:MI|SY|EX|BX|R|TT|SS|IT)|Math|Symbol|XITS|STIX|Asana|Libertinus|MT(?:Pro|Extra)') AS math FROM part")
def c16(spark, d):
    return table(spark, d, "part").select("p_partkey", M.is_math_font(F.concat_ws("-", "p_name", "p_type")).alias("math"))


@query("c14_substantial", r"""SELECT item_id, coalesce(length(text) >= 5 AND (regexp_matches(text, '[=+<>≤≥≠≈≡∈⊂⊆∪∩∫∑∏∇∂⋅×±−_^]') OR length(regexp_replace(regexp_replace(text, '\\[a-zA-Z]+(?:\{[^}]*\})*', ' ', 'g'), '[\s,.;:()\[\]{}|−]', '', 'g')) > 0
OR len(regexp_extract_all(text, '\\[a-zA-Z]+')) >= 2 OR regexp_matches(text, '\\(?:frac|dfrac|tfrac|sqrt|binom|sum|prod|int|iint|iiint|oint|begin)(?:[^A-Za-z]|$)')), false) AS ok FROM benchmark""")
def c14(spark, d):
    return table(spark, d, "benchmark").select("item_id", M.is_substantial(F.col("text")).alias("ok"))


@query("i9_i10_latex", "SELECT item_id, replace(replace(text, 'Σ', '\\Sigma'), '×', '\\times') AS latex FROM benchmark")
def i9(spark, d):
    return table(spark, d, "benchmark").select("item_id", M.to_latex(F.col("text")).alias("latex"))


@query("c12_c13_formulas")
def c12(spark, d):
    """Lines without any mark of mathematics are left out first; the rest is judged in the row, so nothing is shuffled."""
    marked = F.filter(X.lines(F.col("text")), lambda x: x.rlike(M.MARKS))
    t = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", marked.alias("m"))
    return t.select("doc_id", F.size(F.filter("m", M.looks_like_formula)).cast("long").alias("looks"), F.size(F.filter("m", M.is_formula)).cast("long").alias("valid"))


@query("i14_extract_formulas")
def i14(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(M.extract(F.col("text"))).alias("f")).select("doc_id", "f.latex", "f.number", "f.display")


@query("i11_i15_i17_repair")
def i11(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(M.wrap_commands(M.close_braces(M.merge_dollars(F.col("text")))).cast("binary"), 256).alias("repaired"))


@query("w9_dedup_paragraphs")
def w9(spark, d):
    return table(spark, d, "documents").select("doc_id", folds.dedup_paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n"))).alias("kept"))


@query("w10_dedup_boundaries", f"""WITH RECURSIVE f AS MATERIALIZED ({ORACLES["i7_normal_paragraph"]}), low AS (SELECT doc_id, min(line_no) AS n FROM f GROUP BY doc_id),
r AS (SELECT doc_id, n, '' AS tail, 0 AS kept FROM low UNION ALL SELECT f.doc_id, f.line_no + 1, CASE WHEN r.tail <> '' AND left(f.form, 30) = r.tail THEN r.tail ELSE right(f.form, 30) END,
r.kept + CASE WHEN r.tail <> '' AND left(f.form, 30) = r.tail THEN 0 ELSE 1 END FROM r JOIN f ON f.doc_id = r.doc_id AND f.line_no = r.n)
SELECT doc_id, arg_max(kept, n)::INT AS kept FROM r GROUP BY doc_id""")
def w10(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(folds.dedup_boundaries(X.lines(F.col("text")))).alias("kept"))


@query("i3_i4_paragraph_chunks")
def i3(spark, d):
    t = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    return table(spark, d, "documents").select("doc_id", F.explode(folds.pack_paragraphs(folds.merge_paragraphs(t), 3000)).alias("chunk"))


@query("i5_split_message", r"""WITH RECURSIVE r AS (SELECT conv_id, turn, -1 AS no, '' AS part, coalesce(text, '') AS rest FROM conversations
UNION ALL SELECT conv_id, turn, no + 1, CASE WHEN length(rest) <= 400 THEN rest ELSE left(rest, cut) END, CASE WHEN length(rest) <= 400 THEN '' ELSE ltrim(substr(rest, cut + 1), ' ' || chr(10)) END
FROM (SELECT *, CASE WHEN at_line > 0 THEN at_line WHEN at_blank > 0 THEN at_blank ELSE 400 END AS cut FROM (SELECT *, length(regexp_extract(left(rest, 400), '(?s)^(.+)\n', 1)) AS at_line, length(regexp_extract(left(rest, 400), '(?s)^(.+) ', 1)) AS at_blank FROM r WHERE rest <> '')))
SELECT conv_id, turn, no::INT AS no, part FROM r WHERE no >= 0""")
def i5(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(folds.split_message(F.col("text"), 400)).alias("no", "part"))


@query("j20_sequence_overlap", "SELECT conv_id, (CASE WHEN count(*) > 1 THEN count(*) - 1 ELSE 0 END)::BIGINT AS overlap FROM conversations GROUP BY conv_id")
def j20(spark, d):
    """Of a conversation without its first and one without its last turn all others overlap."""
    t = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("t"))
    return t.select("conv_id", F.greatest(folds.sequence_overlap(F.col("t"), F.slice("t", 2, 1 << 20)), F.lit(0)).cast("long").alias("overlap"))


@query("j9_similarity_matrix")
def j9(spark, d):
    return models.similarity_matrix(table(spark, d, "benchmark").select("item_id", "text"), "item_id", "text")


@query("l_model_answers", "SELECT conv_id, turn, length(substr(text, 1, 800)) || ':' || substr(text, 1, 20) AS answer FROM conversations")
def answers(spark, d):
    return models.ask(table(spark, d, "conversations").select("conv_id", "turn", "text"), "text", "answer", most=800).select("conv_id", "turn", "answer")


def _stream(spark, d):
    one = table(spark, d, "events")
    p = shared.path(spark, "stream")
    one.write.parquet(p)
    return spark.readStream.schema(one.schema).parquet(p)


def _drained(spark, out, mode: str = "append"):
    """Everything a stream gives until its source is empty, as a table."""
    p = shared.path(spark, "drained")
    schema = out.schema
    q = out.writeStream.format("parquet").outputMode(mode).option("path", p).option("checkpointLocation", p + "-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(p)


@query("r5_stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def r5_live(spark, d):
    s = _stream(spark, d).select("user_id", "event_type", "ts")
    return _drained(spark, live.dedup(s, ["user_id", "event_type"], "ts", "60 days")).select("user_id", "event_type")


@query("r3_stream_sessions")
def r3_live(spark, d):
    """Sessions still open at the end stay behind the watermark."""
    return _drained(spark, live.sessions(_stream(spark, d), "user_id", "ts", "6 hours"))


@query("r3_stream_closed", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT user_id, epoch_us(min(ts)) AS began, epoch_us(max(ts)) + 21600000000 AS ended, count(*)::BIGINT AS events FROM s GROUP BY user_id, no HAVING max(ts) + INTERVAL 6 HOUR <= date_trunc('millisecond', (SELECT max(ts) FROM events)) - INTERVAL 1 HOUR""")
def r3_closed(spark, d):
    """The same with times in microseconds."""
    return r3_live(spark, d).select("user_id", F.unix_micros("began").alias("began"), F.unix_micros("ended").alias("ended"), "events")


@query("r8_stream_changes", "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE event_type IS DISTINCT FROM b")
def r8_live(spark, d):
    return _drained(spark, live.stage_changes(_stream(spark, d), "user_id", "event_id", "event_type"))
