"""The queries opN_<name> and, where SQL can say it, their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import documents


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import dedup_lines

    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP1_SQL = """
WITH lines AS (
  SELECT doc_id, u.line, u.n FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents) d,
    LATERAL (SELECT unnest(d.a) AS line, generate_subscripts(d.a, 1) AS n) u),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
repeated AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT y.doc_id, y.line, y.n, r.k IS NOT NULL AND r.keeper <> y.doc_id AS gone FROM keyed y LEFT JOIN repeated r ON y.k = r.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import hexed, near_duplicates

    out = near_duplicates(documents(spark, sf_dir))
    return out.select(F.col("doc").alias("doc_id"), hexed(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, detect, joined

    out = detect(documents(spark, sf_dir).select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(pii, x -> x.kind = {k})) as bigint)").alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    return out.select("doc_id", *counts, F.sha2(joined("pii", base=True).cast("binary"), 256).alias("base_sha256"), joined("pii").alias("spans"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify

    out = identify(documents(spark, sf_dir), keep=["doc_id", "text"])
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, of the model's scheme and of the best path, and what the ids decode to."""
    from .pieces import decode, encode

    ids = encode(documents(spark, sf_dir).select("doc_id", "text"))
    out = decode(ids.select("doc_id", "n_ids", "ids", F.crc32("ids").alias("ids_crc32"), "n_best", F.crc32("best_ids").alias("best_crc32"), "best_score"))
    return out.select("doc_id", "n_ids", "ids_crc32", "n_best", "best_crc32", "best_score", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(documents(spark, sf_dir))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import KINDS, find_secrets, joined

    out = find_secrets(documents(spark, sf_dir).select("doc_id", "text"))
    counts = [F.size(F.expr(f"filter(secrets, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return out.select("doc_id", *counts, F.sha2(joined(F.col("secrets"), KINDS[:3]).cast("binary"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spans import fingerprints

    return fingerprints(documents(spark, sf_dir))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import digests, read_back, windows

    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.sql(f"SELECT -1L AS conv_id, turn, role, '{said}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    rows = documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digests(read_back(windows(rows)))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_duplicates

    return near_duplicates(documents(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x for x in embedding if x <> 0]) > 0),
pairs AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM usable a JOIN usable b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach(n, r) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.n, pairs.v FROM reach JOIN pairs ON reach.r = pairs.u),
least AS (SELECT n, min(r) AS component_id FROM reach GROUP BY n),
links AS (SELECT u, count(*) AS n_links FROM pairs GROUP BY u)
SELECT e.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least ON e.vec_id = least.n LEFT JOIN links ON e.vec_id = links.u
"""


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repair import damaged, repair_conversations

    rows = documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = repair_conversations(damaged(rows))
    every = rows.select("conv_id").distinct().withColumn("k", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(found, "k", "left").select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


#: crc32 by its rule, bit by bit; then a fold over the turns of a conversation with the cheapest
#: (cost, audit, text) of each grammar state: 1 nothing yet, 2 after s, 3 after u, 4 after a.
OP11_SQL = """
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
hurt AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda c: ord(c)::BIGINT)),
    lambda h, b: list_reduce(list_prepend(xor(h, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295::BIGINT) % 20 AS what FROM named),
damaged AS (
  SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN what = 1 THEN '' WHEN what = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN what = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM hurt WHERE what <> 0),
dealt AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said FROM damaged),
rated AS (
  SELECT *, role[1:1] AS r, CASE WHEN said = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN said[-1:] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) AS r0 FROM dealt),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE i > 1 AND r0 || r NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM rated GROUP BY conv_id),
at_start AS (
  SELECT conv_id, n, 0 AS i, {'c': 0, 'a': '', 't': ''} AS s1, NULL::STRUCT(c INTEGER, a VARCHAR, t VARCHAR) AS s2, {'c': 5, 'a': 'I', 't': chr(10) || 'user:'} AS s3,
    {'c': 10, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'} AS s4 FROM counts),
fold AS (
  SELECT * FROM at_start
  UNION ALL
  SELECT conv_id, n, i, s1, s2, least(b3, CASE WHEN b1 IS NOT NULL THEN {'c': b1.c + 5, 'a': b1.a || 'I', 't': b1.t || chr(10) || 'user:'} END,
      CASE WHEN b2 IS NOT NULL THEN {'c': b2.c + 5, 'a': b2.a || 'I', 't': b2.t || chr(10) || 'user:'} END,
      CASE WHEN b4 IS NOT NULL THEN {'c': b4.c + 5, 'a': b4.a || 'I', 't': b4.t || chr(10) || 'user:'} END),
    least(b4, CASE WHEN b3 IS NOT NULL THEN {'c': b3.c + 5, 'a': b3.a || 'I', 't': b3.t || chr(10) || 'assistant:'} END,
      CASE WHEN b1 IS NOT NULL THEN {'c': b1.c + 10, 'a': b1.a || 'II', 't': b1.t || chr(10) || 'user:' || chr(10) || 'assistant:'} END,
      CASE WHEN b2 IS NOT NULL THEN {'c': b2.c + 10, 'a': b2.a || 'II', 't': b2.t || chr(10) || 'user:' || chr(10) || 'assistant:'} END)
  FROM (SELECT *, b1 AS s1, b2 AS s2 FROM (
    SELECT f.conv_id, f.n, f.i + 1 AS i,
      {'c': s1.c + 2, 'a': s1.a || 'D', 't': s1.t} AS b1,
      least(CASE WHEN s2 IS NOT NULL THEN {'c': s2.c + 2, 'a': s2.a || 'D', 't': s2.t} END,
        CASE WHEN r = 's' AND fault IN ('', 'truncated') THEN {'c': s1.c + CASE fault WHEN '' THEN 0 ELSE 5 END, 'a': s1.a || 'K', 't': s1.t || chr(10) || role || ':' || text} END) AS b2,
      list_min(list_filter([CASE WHEN s3 IS NOT NULL THEN {'c': s3.c + 2, 'a': s3.a || 'D', 't': s3.t} END] || flatten([[
        CASE WHEN p IS NOT NULL AND fault IN ('', 'truncated') AND r = 'u' THEN {'c': p.c + more, 'a': p.a || 'K', 't': p.t || chr(10) || role || ':' || text} END,
        CASE WHEN p IS NOT NULL AND fault IN ('', 'truncated') THEN {'c': p.c + more + 1, 'a': p.a || 'R', 't': p.t || chr(10) || 'user:' || text} END] for p in [s1, s2, s4]]), lambda x: x IS NOT NULL)) AS b3,
      list_min(list_filter([CASE WHEN s4 IS NOT NULL THEN {'c': s4.c + 2, 'a': s4.a || 'D', 't': s4.t} END,
        CASE WHEN s3 IS NOT NULL AND fault IN ('', 'truncated') AND r = 'a' THEN {'c': s3.c + more, 'a': s3.a || 'K', 't': s3.t || chr(10) || role || ':' || text} END,
        CASE WHEN s3 IS NOT NULL AND fault IN ('', 'truncated') THEN {'c': s3.c + more + 1, 'a': s3.a || 'R', 't': s3.t || chr(10) || 'assistant:' || text} END], lambda x: x IS NOT NULL)) AS b4
    FROM fold f JOIN (SELECT *, CASE fault WHEN '' THEN 0 ELSE 5 END AS more FROM rated) d ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND d.i = f.i + 1))),
ended AS (SELECT conv_id, least(s1, s4) AS b FROM fold WHERE i = n)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(b.t[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended e ON o.conv_id IS NOT DISTINCT FROM e.conv_id
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .negatives import mine

    moved = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END").alias("label")
    return mine(documents(spark, sf_dir, "embeddings").select("vec_id", moved, "embedding"), F.expr("vec_id % 100 = 0"))


OP12_SQL = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) for x in embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM usable a JOIN usable b ON len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same AND id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.id)::INTEGER AS rank, n.id AS negative_id, positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same AND 30 * positive_score <= 100 * n.score AND 100 * n.score <= 90 * positive_score
QUALIFY rank <= 10
"""


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import dedup_substrings

    out = dedup_substrings(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP13_SQL = """
WITH words AS (
  SELECT doc_id, [w for w in string_split(translate(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' ') if w <> ''] AS w FROM documents),
windows AS (SELECT doc_id, unnest(range(len(w) - 34)) AS s, w FROM words WHERE len(w) >= 35),
keyed AS (SELECT doc_id, s, array_to_string(w[s + 1 : s + 35], ' ') AS k FROM windows),
repeated AS (SELECT k FROM keyed GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS i FROM keyed JOIN repeated USING (k)),
lost AS (SELECT doc_id, list(i) AS g, count(*) AS n FROM gone GROUP BY doc_id),
parts AS (SELECT d.doc_id, u.x, u.i, l.i IS NULL AS stays FROM (SELECT doc_id, w FROM words) d, LATERAL (SELECT unnest(d.w) AS x, generate_subscripts(d.w, 1) - 1 AS i) u LEFT JOIN gone l ON l.doc_id = d.doc_id AND l.i = u.i)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words w LEFT JOIN lost USING (doc_id) LEFT JOIN (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM parts WHERE stays GROUP BY doc_id) USING (doc_id)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_pii": op2_pii,
    "op3_language_id": op3_language_id,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_pack": op5_pack,
    "op6_secrets": op6_secrets,
    "op7_fingerprints": op7_fingerprints,
    "op8_chat": op8_chat,
    "op9_simhash": op9_simhash,
    "op10_embeddings": op10_embeddings,
    "op11_repair": op11_repair,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_substring_dedup": op13_substring_dedup,
}

ORACLES: dict[str, str] = {"op1_line_dedup": OP1_SQL, "op10_embeddings": OP10_SQL, "op11_repair": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_substring_dedup": OP13_SQL}
