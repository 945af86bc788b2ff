"""Queries on translated papers: chunks, fragments, braces and formulas with their surroundings.

The documents have hardly any formulas, so their words are made into some: which ones, how
long they are and what stands between them follows the text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fragments, latex, validators
from ..functions.text import bound
from ..operators import folds
from ..sources import shared
from .registry import query, table

#: Words of two letters from o, i or e on become indexed symbols, neighbours of four letters fractions with a number behind, every fifth comma an open brace.
_MADE = (
    (r"\b([oie])([a-z])\b", r"\$$1_$2\$"),
    (r"\b([a-z]{4}) ([a-z]{4})\b", r"\$\$\\frac{$1}{$2} = x_$1\$\$ (7)"),
    (r"(?:([A-Za-z]{5,}), )", r"\$y^{$1 = \\alpha + 1\$, "),
)


def _documents(spark, d):
    """For what Python functions read: in batches of bounded size."""
    shared.bounded(spark)
    return table(spark, d, "documents")


def made(text):
    for what, by in _MADE:
        text = F.regexp_replace(text, what, by)
    return text


@query("i12_merge_fragments")
def i12(spark, d):
    """Whole documents, as digests of what their formulas become, with the number of formulas before and after."""
    t = _documents(spark, d).select("doc_id", made(F.col("text")).alias("t"))
    t = t.withColumn("m", fragments.merged_fragments(F.col("t")))
    n = lambda c: F.regexp_count(c, F.lit(r"\$+")).cast("long")
    return t.select("doc_id", n(F.col("t")).alias("marks"), n(F.col("m")).alias("marks_left"), F.sha2(F.col("m").cast("binary"), 256).alias("merged"))


@query("i4_chunks")
def i4(spark, d):
    """Chunks of about 1,500 characters of whole documents; lines are paragraphs."""
    parts = F.filter(F.transform(F.split(made(F.col("text")), "\n", -1), lambda x: F.trim(x)), lambda p: p != "")
    t = _documents(spark, d).select("doc_id", F.posexplode(fragments.chunked(parts, 1500)).alias("no", "chunk"))
    return t.select("doc_id", "no", F.length("chunk").alias("size"), F.sha2(F.col("chunk").cast("binary"), 256).alias("chunk"))


@query("i4_plain_chunks", """WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, '$', ''), chr(10)), lambda x: trim(x)), lambda x: x <> '' AND length(x) <= 3000) AS ps FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, ps, 0 AS i, 0 AS no, []::INTEGER[] AS held, 0 AS size, NULL::INTEGER[] AS done FROM p
UNION ALL SELECT doc_id, ps, i + 1, CASE WHEN full_ THEN no + 1 ELSE no END, CASE WHEN NOT full_ THEN held || [i + 1] WHEN over THEN [held[len(held)], i + 1] ELSE [i + 1] END,
CASE WHEN NOT full_ THEN size + n WHEN over THEN length(ps[held[len(held)]]) + n ELSE n END, CASE WHEN full_ THEN CASE WHEN over THEN held[1 : len(held) - 1] ELSE held END END
FROM (SELECT *, len(held) > 0 AND size + n > 1500 AS full_, len(held) > 1 AND NOT regexp_matches(ps[held[len(held)]], '[.。!！?？]\\s*$') AS over FROM (SELECT *, length(ps[i + 1]) AS n FROM r WHERE i < len(ps)))),
e AS (SELECT doc_id, no - 1 AS no, ps, done AS d FROM r WHERE done IS NOT NULL UNION ALL SELECT doc_id, no, ps, held FROM r WHERE i = len(ps) AND len(held) > 0)
SELECT doc_id, no::INTEGER AS no, sha256(array_to_string(list_transform(d, lambda x: ps[x]), chr(10) || chr(10))) AS chunk FROM e""".replace("\\\\s", "\\s"))
def i4_plain(spark, d):
    """The same without marks and without lines of over twice the size: what fills a chunk and what rolls over."""
    parts = F.filter(F.transform(F.split(F.replace("text", F.lit("$"), F.lit("")), "\n", -1), lambda x: F.trim(x)), lambda p: (p != "") & (F.length(p) <= 3000))
    t = _documents(spark, d).filter("text IS NOT NULL").select("doc_id", F.posexplode(fragments.chunked(parts, 1500)).alias("no", "chunk"))
    return t.select("doc_id", "no", F.sha2(F.col("chunk").cast("binary"), 256).alias("chunk"))


@query("i15_balance")
def i15(spark, d):
    """Cards of whole documents: sentences between dollars and braces of their own, some left open, balanced in explanations and formulas."""
    card = lambda t: F.concat(F.lit('<div class="fexpr"> '), F.substring(F.regexp_replace(t, r"\$", ""), 1, 400), F.lit(' & x</div> <div class="fmean">'), F.regexp_replace(t, "</?div[^>]*>", ""), F.lit("</div>"))
    out = latex.balance_expressions(latex.balance_meanings(bound(made(F.col("text")), card)))
    t = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", out.alias("out"))
    return t.select("doc_id", F.length("out").alias("size"), F.sha2(F.col("out").cast("binary"), 256).alias("balanced"))


@query("i15_braces", r"SELECT doc_id, (CASE WHEN net > 0 THEN t || repeat('}', net) WHEN net < 0 THEN array_to_string(p[1 : len(p) + net], '}') || array_to_string(p[len(p) + net + 1 : len(p)], '') ELSE t END)[-60:] AS tail FROM (SELECT *, length(t) - length(replace(t, '{', '')) - length(t) + length(replace(t, '}', '')) AS net, string_split(t, '}') AS p FROM (SELECT doc_id, replace(replace(regexp_replace(replace(replace(replace(text, '{', ''), '}', ''), chr(92), ''), '\.', '{', 'g'), ',', '}'), '?', '}') || repeat('}', (length(text) // 7)::INTEGER) AS t FROM documents WHERE text IS NOT NULL))")
def i15_braces(spark, d):
    """Points as opening, commas and question marks as closing braces, and many closing ones behind: the last ones go."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"[{}\\]", ""), r"\.", "{"), "[,?]", "}")
    whole = F.concat(t, F.repeat(F.lit("}"), F.floor(F.length("text") / 7).cast("int")))
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.right(latex.balance_braces(whole), F.lit(60)).alias("tail"))


@query("i14_formulas")
def i14_all(spark, d):
    """All formulas of whole documents with number and context."""
    return latex.formulas(table(spark, d, "documents"), made(F.col("text")), ["doc_id"])


#: A candidate for every line: its first 80 characters, some words as commands, points and commas as braces, some blanks as operators or indices.
_LINE = """CASE doc_id % 5 WHEN 0 THEN replace(replace(replace(s, '.', '{'), ',', '}'), 'th', '{b}alpha ') WHEN 1 THEN replace(replace(s, 'an', '{b}foo '), 'er', '{b}frac') WHEN 2 THEN replace(s, ' ', ' = ') WHEN 3 THEN replace(substr(s, 1, 9), ' ', ' + ') ELSE substr(replace(s, 'e', ' '), 1, 30) || CASE WHEN doc_id % 2 = 0 THEN '_1' ELSE '' END END"""
_LINES = f"SELECT doc_id, {_LINE.replace('{b}', chr(92))} AS x FROM (SELECT doc_id, substr(translate(string_split(text, chr(10))[1], chr(92) || '{{}}', ''), 1, 80) AS s FROM documents WHERE text IS NOT NULL)"


def _candidates(spark, d):
    first = F.substring(F.translate(F.split("text", "\n", 2)[0], "\\{}", ""), 1, 80)
    t = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", first.alias("s"))
    return t.select("doc_id", F.expr(_LINE.replace('{b}', chr(92) * 2)).alias("x"))


def _told(spark, d, check):
    found = check(F.col("x"))
    return _candidates(spark, d).select("doc_id", F.size(found).cast("long").alias("n"), F.array_join(found, ",").alias("found"))


_BARE = r"regexp_replace(x, '\\[a-zA-Z]+(\{[^}]*\})*', ' ', 'g')"
_SIGN = r"[\[\]{}()|,.;:+*/=<>≤≥≠≈≡∈⊂⊆∪∩∫∑∏∇∂⋅×±−-]"
_WORDS = rf"list_filter(regexp_split_to_array(regexp_replace({_BARE}, '{_SIGN}', ' ', 'g'), '\s+'), lambda t: t <> '')"


@query("i31_braces", f"""WITH RECURSIVE c AS ({_LINES}), t AS (SELECT doc_id, regexp_extract_all(x, '\\\\.|[{{}}]') AS a FROM c),
r AS (SELECT doc_id, a, 0 AS i, 0 AS depth, 0 AS over FROM t UNION ALL SELECT doc_id, a, i + 1, greatest(0, depth + s), over + (depth + s < 0)::INT FROM (SELECT *, CASE a[i + 1] WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END AS s FROM r WHERE i < len(a)))
SELECT doc_id, (over + (depth > 0)::INT)::BIGINT AS n, array_to_string(list_transform(range(over), lambda k: 'unexpected') || CASE WHEN depth > 0 THEN ['unclosed:' || depth] ELSE [] END, ',') AS found FROM r WHERE i = len(a)""")
def i31_braces(spark, d):
    return _told(spark, d, validators.braces)


@query("i31_commands", f"WITH c AS ({_LINES}), t AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(x, '\\\\[a-zA-Z][a-zA-Z]+'), lambda t: t[2:]), lambda t: NOT list_contains(string_split('{' '.join(validators.COMMANDS)}', ' '), t)) AS a FROM c) SELECT doc_id, len(a) AS n, array_to_string(a, ',') AS found FROM t")
def i31_commands(spark, d):
    return _told(spark, d, validators.commands)


@query("i31_garbled")
def i31_garbled(spark, d):
    return _told(spark, d, validators.garbled)


@query("i31_prose")
def i31_prose(spark, d):
    return _told(spark, d, validators.prose)


@query("i31_naked_operator", f"WITH c AS ({_LINES}), t AS (SELECT doc_id, regexp_extract_all({_BARE}, '[=+*/<>≤≥≠≈≡∈⊂⊆∪∩-]') AS o, len(regexp_extract_all({_BARE}, '[a-zA-Z0-9]')) AS n FROM c) SELECT doc_id, (CASE WHEN len(o) = 1 AND n < 2 THEN 1 ELSE 0 END)::BIGINT AS n, CASE WHEN len(o) = 1 AND n < 2 THEN o[1] ELSE '' END AS found FROM t")
def i31_naked(spark, d):
    return _told(spark, d, validators.naked_operator)


@query("i31_lost_index", f"WITH c AS ({_LINES}), t AS (SELECT doc_id, x, {_WORDS} AS w FROM c), s AS (SELECT *, list_filter(w, lambda t: length(regexp_replace(t, '[^a-zA-Z0-9]', '', 'g')) BETWEEN 1 AND 2) AS o FROM t), k AS (SELECT doc_id, CASE WHEN NOT regexp_matches(x, '[_^]') AND len(o) >= 2 AND len(w) >= 3 THEN o ELSE [] END AS o FROM s) SELECT doc_id, len(o)::BIGINT AS n, array_to_string(o, ',') AS found FROM k")
def i31_index(spark, d):
    return _told(spark, d, validators.lost_index)


@query("i31_report")
def i31_report(spark, d):
    """What speaks against each candidate, of all validators."""
    found = validators.errors(F.col("x"))
    return _candidates(spark, d).select("doc_id", (F.size(found) == 0).alias("passed"), found.alias("errors"))
