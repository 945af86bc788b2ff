"""Queries on texts: cleaning, tokens, languages, topics, lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from .registry import query, table

WS = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"
LINES = f"SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents"


def exploded(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(X.lines(F.col("text"))).alias("p", "line")).select("doc_id", "line", (F.col("p") + 1).cast("long").alias("line_no"))


@query("i1_tokens", r"SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))::BIGINT AS n_tokens, len(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')))::BIGINT AS n_terms FROM documents")
def i1(spark, d):
    t = X.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_terms"))


@query("i2_sections", f"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\n{{2,}}'), lambda x: trim(x, {WS})), lambda x: x <> '') AS a FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(a) = 0 THEN [NULL] ELSE a END) AS part, unnest(range(1, greatest(len(a), 1) + 1)) AS section_no FROM p),
h AS (SELECT *, string_split(part, chr(10))[1] AS first FROM s)
SELECT doc_id, section_no, coalesce(substr(first, 1, 40), '全文') AS head, coalesce(length(CASE WHEN trim(substr(part, length(first) + 1), {WS}) = '' THEN part ELSE trim(substr(part, length(first) + 1), {WS}) END), 0)::BIGINT AS body_chars FROM h""")
def i2(spark, d):
    """All sections of all documents; a null text is an empty one."""
    t = X.sections(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", F.posexplode(t).alias("p", "s")).select("doc_id", (F.col("p") + 1).cast("long").alias("section_no"), F.col("s.head").alias("head"), F.length("s.body").cast("long").alias("body_chars"))


@query("i6_truncate", r"""SELECT doc_id, CASE WHEN length(text) > 1200 THEN substr(text, 1, 1200) || chr(10) || '... (truncated)' ELSE text END AS cut,
CASE WHEN length(text) <= 200 THEN text WHEN length(regexp_extract(substr(text, 1, 200), '(?s)^(.*[。.!?！？])', 1)) > 100 THEN regexp_extract(substr(text, 1, 200), '(?s)^(.*[。.!?！？])', 1) ELSE substr(text, 1, 200) || '…' END AS sentence FROM documents""")
def i6(spark, d):
    return table(spark, d, "documents").select("doc_id", X.truncate(F.col("text"), 1200).alias("cut"), X.truncate_at_sentence(F.col("text"), 200).alias("sentence"))


@query("i7_normal_paragraph", rf"""SELECT doc_id, line_no::BIGINT AS line_no, lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(line, {WS}), '^#{{1,4}}\s*', ''),
'(?s)\$\$.*?\$\$', '█MATH█', 'g'), '\$[^$\n]*?\$', '█INLINE█', 'g'), '◈[A-Z]+_\d+◈', '█PH█', 'g'), '\s+', ' ', 'g'), '[，。！？、；：（）《》【】,.!?:;\-]', '', 'g'), {WS})) AS form FROM ({LINES})""")
def i7(spark, d):
    return exploded(spark, d).select("doc_id", "line_no", X.normal_paragraph(F.col("line")).alias("form"))


def _chain(expr: str, steps) -> str:
    for p in steps:
        expr = f"regexp_replace({expr}, '{p}', '', 'g')"
    return expr


@query("i8_remarks", f"SELECT doc_id, trim({_chain('text', X.REMARKS)}, {WS}) AS plain FROM documents")
def i8(spark, d):
    return table(spark, d, "documents").select("doc_id", X.strip_remarks(F.col("text")).alias("plain"))


_NO_LOOK = [p for p in X.THINKING if "(?!" not in p]


@query("i19_thinking", f"SELECT conv_id, turn, trim({_chain('text', _NO_LOOK)}, {WS}) AS said FROM conversations")
def i19(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.strip_thinking(F.col("text")).alias("said"))


_TAGS = _chain("html", (r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", "<[^>]+>"))
for _n, _c in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&nbsp;", "chr(160)"), ("&amp;", "'&'")):
    _TAGS = f"replace({_TAGS}, '{_n}', {_c})"


@query("i21_strip_tags", f"SELECT page_id, trim({_TAGS}, {WS}) AS plain FROM pages")
def i21(spark, d):
    return table(spark, d, "pages").select("page_id", X.strip_tags(F.col("html")).alias("plain"))


@query("i22_squeeze", rf"SELECT page_id, trim(regexp_replace(regexp_replace(html, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), {WS}) AS plain FROM pages")
def i22(spark, d):
    return table(spark, d, "pages").select("page_id", X.squeeze(F.col("html")).alias("plain"))


_MD = r"""regexp_replace(html, '(?is)<a\s+[^>]*href=["'']([^"'']+)["''][^>]*>(.*?)</a>', '[\2](\1)', 'g')"""
for _n in range(1, 7):
    _MD = rf"regexp_replace({_MD}, '(?is)<h{_n}[^>]*>(.*?)</h{_n}>', chr(10) || '{'#' * _n} \1' || chr(10), 'g')"
_MD = rf"regexp_replace({_MD}, '(?is)<li[^>]*>(.*?)</li>', chr(10) || '- \1', 'g')"
_MD = rf"regexp_replace({_MD}, '(?i)</(?:p|div|section|article)>', chr(10) || chr(10), 'g')"
_MD = rf"regexp_replace({_MD}, '(?i)<(?:br|hr)\s*/?>', chr(10), 'g')"


@query("i23_markdown", rf"SELECT page_id, trim(regexp_replace(regexp_replace(plain, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), {WS}) AS markdown FROM (SELECT page_id, trim({_TAGS.replace('html', 'md')}, {WS}) AS plain FROM (SELECT page_id, {_MD} AS md FROM pages))")
def i23(spark, d):
    return table(spark, d, "pages").select("page_id", X.to_markdown(F.col("html")).alias("markdown"))


@query("i24_table", r"""SELECT l_orderkey AS order_key, '| line | part | quantity |' || chr(10) || '| --- | --- | --- |' || chr(10) ||
string_agg('| ' || l_linenumber || ' | ' || l_partkey || ' | ' || l_quantity::BIGINT || ' |', chr(10) ORDER BY l_linenumber, l_partkey, l_quantity) AS markdown FROM lineitem GROUP BY 1""")
def i24(spark, d):
    from ..functions.tables import markdown_table

    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("order_key")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("q")))).alias("r"))
    cells = F.transform("r", lambda x: F.array(x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"), x["q"].cast("string")))
    return rows.select("order_key", markdown_table(["line", "part", "quantity"], cells).alias("markdown"))


@query("i27_escape", r"""SELECT item_id, replace(replace(replace(text, chr(92), chr(92) || chr(92)), chr(39), chr(92) || chr(39)), chr(10), chr(92) || 'n') AS quoted, regexp_replace(substr(text, 1, 60), '[^A-Za-z0-9 _-]', '', 'g') AS safe FROM benchmark""")
def i27(spark, d):
    t = F.col("text")
    for a, b in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return table(spark, d, "benchmark").select("item_id", t.alias("quoted"), F.regexp_replace(F.substring("text", 1, 60), "[^A-Za-z0-9 _-]", "").alias("safe"))


_TOPIC_SQL = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS topic FROM documents WHERE regexp_matches(lower(text), '{'|'.join(p.lower() for p in pats)}')" for n, pats in X.TOPICS.items())


@query("i28_topics", _TOPIC_SQL)
def i28(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(X.topics(F.col("text"))).alias("topic"))


@query("i29_category", "SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for p, n in X.CATEGORIES) + f" ELSE '{X.NO_CATEGORY}' END AS category FROM documents")
def i29(spark, d):
    return table(spark, d, "documents").select("doc_id", X.category(F.col("text")).alias("category"))


@query("i32_shrunk", "SELECT conv_id, turn, length(text)::BIGINT AS before, length(regexp_replace(text, '[aeiou ]', '', 'g'))::BIGINT AS after, length(text) > 500 AND length(regexp_replace(text, '[aeiou ]', '', 'g')) < 0.4 * length(text) AS short FROM conversations")
def i32(spark, d):
    after = F.length(F.regexp_replace("text", "[aeiou ]", ""))
    return table(spark, d, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("before"), after.cast("long").alias("after"), ((F.length("text") > 500) & (after < 0.4 * F.length("text"))).alias("short"))


@query("g13_language", r"SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]')) >= 200 AND len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]')) > 0.2 * (len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]')) + len(regexp_extract_all(text, '[a-zA-Z]'))) THEN 'zh' ELSE 'en' END AS language FROM documents")
def g13(spark, d):
    return table(spark, d, "documents").select("doc_id", X.language(F.col("text")).alias("language"))


_PLAIN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '(?s)\$\$.*?\$\$', '', 'g'), '\$[^$\n]*?\$', '', 'g'), '◈[A-Z]+_\d+◈', '', 'g'), '</?[^>]+>', '', 'g')"


@query("g14_english_ratio", rf"SELECT doc_id, line_no::BIGINT AS line_no, round(CASE WHEN length(trim(p, {WS})) = 0 THEN 0.0 ELSE len(regexp_extract_all(p, '[a-zA-Z]')) / length(trim(p, {WS})) END, 6) AS ratio, (CASE WHEN length(trim(p, {WS})) = 0 THEN 0 ELSE len(regexp_extract_all(p, '[\x{{4e00}}-\x{{9fff}}\x{{3400}}-\x{{4dbf}}]')) END)::BIGINT AS cjk FROM (SELECT doc_id, line_no, {_PLAIN} AS p FROM ({LINES}))")
def g14(spark, d):
    e = exploded(spark, d).select("doc_id", "line_no", X.english_ratio(F.col("line")).alias("e"))
    return e.select("doc_id", "line_no", F.round("e.ratio", 6).alias("ratio"), F.col("e.cjk").cast("long").alias("cjk"))


@query("g17_dollars", r"SELECT doc_id, len(regexp_extract_all(text, '\$\$'))::BIGINT AS pairs, len(regexp_extract_all(text, '\$'))::BIGINT AS marks FROM documents")
def g17(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit(r"\$\$")).cast("long").alias("pairs"), F.regexp_count("text", F.lit(r"\$")).cast("long").alias("marks"))


_META = "|".join(f"(?:{p})" for p in X.METADATA)
_AFF = "|".join(f"(?:{p})" for p in X.AFFILIATION)


@query("c9_metadata_lines", rf"SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE length(s) >= 3 AND NOT regexp_matches(s, '{_META}') AND NOT (length(s) < 120 AND regexp_matches(s, '{_AFF}'))), '') AS kept FROM (SELECT *, trim(line, {WS}) AS s FROM ({LINES})) GROUP BY doc_id")
def c9(spark, d):
    return table(spark, d, "documents").select("doc_id", X.without_metadata_lines(F.col("text")).alias("kept"))


@query("c11_diagram_labels", rf"""WITH l AS (SELECT *, trim(line, {WS}) AS s FROM ({LINES})),
p AS (SELECT *, list_filter([trim(x, {WS}) for x in string_split(s, '/')], lambda x: x <> '') AS parts, list_filter(regexp_split_to_array(s, '\s+'), lambda x: x <> '') AS words FROM l),
m AS (SELECT *, s <> '' AND ((len(parts) >= 3 AND len(list_filter(parts, lambda x: length(x) > 25)) = 0 AND NOT regexp_matches(s, '[.。!！?？]\s+[A-Z\x{{4e00}}-\x{{9fff}}]')) OR (len(words) BETWEEN 3 AND 6 AND len(list_distinct(words)) < len(words))
 OR (len(words) >= 5 AND len(list_filter(words, lambda x: length(x) <= 3)) >= 4 AND len(list_filter(words, lambda x: regexp_matches(x, '[\x{{4e00}}-\x{{9fff}}]'))) > 0 AND len(list_filter(words, lambda x: regexp_matches(x, '^[a-zA-Z0-9,]+$'))) > 0 AND NOT regexp_matches(s, '[。.，,！!？?]'))) AS label FROM p)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT label), '') AS kept FROM m GROUP BY doc_id""")
def c11(spark, d):
    return table(spark, d, "documents").select("doc_id", X.without_diagram_labels(F.col("text")).alias("kept"))


@query("c10_w11_page_numbers", rf"""WITH l AS (SELECT *, trim(line, {WS}) AS s, lower(lag(line) OVER w) AS b, lower(lead(line) OVER w) AS a FROM ({LINES}) WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
SELECT doc_id, line_no::BIGINT AS line_no, line FROM l WHERE NOT (regexp_matches(s, '^\d{{3,4}}$') AND coalesce(try_cast(s AS BIGINT), 0) BETWEEN 100 AND 9999 AND (regexp_matches(coalesce(b, ''), 'volume|ieee|transactions|journal|vol\.|received|accepted') OR regexp_matches(coalesce(a, ''), 'volume|ieee|transactions|journal|vol\.|received|accepted')))""")
def c10(spark, d):
    from pyspark.sql import Window

    near = r"volume|ieee|transactions|journal|vol\.|received|accepted"
    w = Window.partitionBy("doc_id").orderBy("line_no")
    s = X.strip(F.col("line"))
    number = s.rlike(r"^\d{3,4}$") & F.coalesce(s.try_cast("long"), F.lit(0)).between(100, 9999)
    t = exploded(spark, d).withColumns({"b": F.lower(F.lag("line").over(w)), "a": F.lower(F.lead("line").over(w))})
    beside = F.coalesce(F.col("b"), F.lit("")).rlike(near) | F.coalesce(F.col("a"), F.lit("")).rlike(near)
    return t.filter(~(number & beside)).select("doc_id", "line_no", "line")


@query("c25_row_kinds", rf"SELECT doc_id, line_no::BIGINT AS line_no, regexp_matches(trim(line, {WS}), '^\|.*\|$') AS table_row, regexp_matches(trim(line, {WS}), '^\d{{3,4}}$') AS page_number FROM ({LINES})")
def c25(spark, d):
    s = X.strip(F.col("line"))
    return exploded(spark, d).select("doc_id", "line_no", s.rlike(r"^\|.*\|$").alias("table_row"), s.rlike(r"^\d{3,4}$").alias("page_number"))


_GREP = r"\b(the|der|les|las) [a-z]+"


@query("c7_g11_grep_count", rf"SELECT doc_id, count(*)::BIGINT AS matches FROM ({LINES}) WHERE regexp_matches(line, '{_GREP}') GROUP BY doc_id")
def c7_count(spark, d):
    from ..operators.grep import count_by

    return count_by(exploded(spark, d), "doc_id", "line", _GREP)


@query("c7_grep_files", rf"SELECT DISTINCT doc_id FROM ({LINES}) WHERE regexp_matches(line, '{_GREP}')")
def c7_files(spark, d):
    from ..operators.grep import files_with

    return files_with(exploded(spark, d), "doc_id", "line", _GREP)


@query("c7_grep_content", rf"""WITH l AS ({LINES}), h AS (SELECT doc_id, line_no FROM l WHERE contains(line, '@'))
SELECT l.doc_id, l.line_no::BIGINT AS line_no, l.line, bool_or(h.line_no = l.line_no) AS hit FROM l JOIN h ON l.doc_id = h.doc_id AND l.line_no BETWEEN h.line_no - 2 AND h.line_no + 2 GROUP BY 1, 2, 3""")
def c7_content(spark, d):
    from ..operators.grep import content

    return content(exploded(spark, d), "doc_id", "line_no", "line", "@", around=2)


@query("c6_glob", r"SELECT page_id, url, regexp_matches(url, '^https://[^/]*/.*$') AS any_path, regexp_matches(url, '^(?:.*/)?[^/]*[^/]/[^/]*\.html$') AS html FROM pages")
def c6(spark, d):
    return table(spark, d, "pages").select("page_id", "url", F.col("url").rlike(X.glob_to_regex("https://*/**")).alias("any_path"), F.col("url").rlike(X.glob_to_regex("**/*?/*.html")).alias("html"))


@query("c18_url", r"SELECT page_id, url, regexp_matches(url, '^https?://[^/?#]+') AS ok, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages")
def c18(spark, d):
    return table(spark, d, "pages").select("page_id", "url", F.col("url").rlike(r"^https?://[^/?#]+").alias("ok"), F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")).alias("host"))


@query("n8_content_hash", "SELECT doc_id, substr(sha256(text), 1, 32) AS content_hash FROM documents")
def n8(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 32).alias("content_hash"))


@query("r12_once_per_content", "SELECT min(doc_id) AS doc_id, sha256(text) AS content_hash, count(*)::BIGINT AS copies FROM documents GROUP BY 2")
def r12(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("n12_token_estimate", "SELECT conv_id, turn, greatest(4, length(text) // 4 + 4)::BIGINT AS tokens FROM conversations")
def n12(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.token_estimate(F.col("text")).alias("tokens"))


@query("a16_read_lines", f"SELECT doc_id, line_no::BIGINT AS line_no, line FROM ({LINES}) WHERE line_no BETWEEN 2 AND 6")
def a16(spark, d):
    return exploded(spark, d).filter(F.col("line_no").between(2, 6))


@query("a21_title", rf"""SELECT doc_id, substr(CASE WHEN length(f[1]) < 10 AND len(f) > 1 THEN f[2] ELSE f[1] END, 1, 300) AS title FROM (SELECT doc_id, list_filter([trim(x, {WS}) for x in string_split(substr(text, 1, 800), chr(10))], lambda x: x <> '') AS f FROM documents)""")
def a21(spark, d):
    return table(spark, d, "documents").select("doc_id", X.title(F.col("text")).alias("title"))


@query("a20_text_document", r"""SELECT doc_id, greatest(1, length(text) // 3000)::BIGINT AS page_count, len(regexp_extract_all(text, '\$[^$\n]+\$'))::BIGINT AS formula_count, len(regexp_extract_all(text, '(?m)^#{1,6} '))::BIGINT AS section_count FROM documents""")
def a20(spark, d):
    from ..sources.files import text_document

    return text_document(table(spark, d, "documents"), "text").select("doc_id", "page_count", "formula_count", "section_count")


@query("s6_chunks", "SELECT doc_id, (n / 7500)::BIGINT AS chunk_no, substr(text, n + 1, 8000) AS chunk FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 7500)) AS n FROM documents)")
def s6(spark, d):
    from ..operators.folds import overlapping

    return table(spark, d, "documents").select("doc_id", F.posexplode(overlapping(F.col("text"), 8000, 500)).alias("chunk_no", "chunk")).withColumn("chunk_no", F.col("chunk_no").cast("long"))
