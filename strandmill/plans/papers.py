"""Queries on papers: readers, layout, formulas, placeholders, cards, notes. Inputs that the tables lack are made from their columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formula as M
from ..functions import markup as K
from ..operators import assembly, bm25, changes, layout
from ..sources import files, jsonl, notes, shared
from .registry import query, table

#: A formula, a fragment or a sentence for every part.
_LATEX = r"CASE p_partkey % 4 WHEN 0 THEN 'x_{' || p_size || '} = \frac{' || p_partkey || '}{' || p_size || '}' WHEN 1 THEN '= ' || p_size WHEN 2 THEN 'the part ' || p_name || ' is of type ' || p_type ELSE 'a_' || p_size || ' + b^2 \leq c' END"


def _parts(spark, d):
    return table(spark, d, "part").withColumn("latex", F.expr(_LATEX.replace("\\", "\\\\")))


@query("i14_part_formulas", r"SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'x_{' || p_size || '} = \frac{' || p_partkey || '}{' || p_size || '}' ELSE 'a_' || p_size || ' + b^2 \leq c' END AS latex, CASE WHEN p_partkey % 4 = 0 THEN p_partkey::VARCHAR END AS number, p_partkey % 4 = 0 AS display FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 4 = 3")
def i14_parts(spark, d):
    """A text of a displayed, numbered formula, an inline one, or one that is none, for every part."""
    made = F.expr(r"CASE p_partkey % 4 WHEN 0 THEN concat('see $$', latex, '\\tag{', p_partkey, '}$$ here') WHEN 1 THEN concat('no $', latex, '$ here') WHEN 2 THEN concat('as \\[', 'a_', p_size, ' + b^2 \\leq c', '\\] says') ELSE concat('as $', latex, '$ says') END")
    out = _parts(spark, d).select("p_partkey", F.explode(M.extract(made)).alias("f"))
    return out.select("p_partkey", "f.latex", "f.number", (F.col("f.display") & (F.col("p_partkey") % 4 == 0)).alias("display"))


@query("g9_validate_all", "SELECT count(*)::BIGINT AS total, (count(*) FILTER (WHERE p_partkey % 4 IN (0, 3)))::BIGINT AS passed, (count(*) FILTER (WHERE p_partkey % 4 IN (1, 2)))::BIGINT AS failed FROM part")
def g9(spark, d):
    ok = M.is_formula(F.col("latex"))
    return _parts(spark, d).agg(F.count("*").alias("total"), F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"))


@query("g22_recall_by_category", "SELECT p_brand AS category, round(avg((p_partkey % 4 IN (0, 3))::INT), 6) AS recall FROM part GROUP BY p_brand")
def g22(spark, d):
    return _parts(spark, d).groupBy(F.col("p_brand").alias("category")).agg(F.round(F.avg(M.is_formula(F.col("latex")).cast("int")), 6).alias("recall"))


@query("i11_merge_chains", r"SELECT p_partkey, '$\alpha t ' || p_size || ' \in b + c$ of all $d$.' AS merged FROM part")
def i11_chains(spark, d):
    """Four neighbours become one at once; the fifth, behind a word, stays."""
    t = F.concat(F.lit(r"$\alpha$ t $"), "p_size", F.lit(r"$ $\in$ $b$ + $c$ of all $d$."))
    return table(spark, d, "part").select("p_partkey", M.merge_dollars(t).alias("merged"))


@query("i13_equations", r"SELECT p_partkey, '$$R a_' || p_size || ' t = \frac{1}{' || p_size || '}$$ (' || p_partkey || ')' AS promoted FROM part")
def i13(spark, d):
    t = F.concat(F.lit("R $a_"), "p_size", F.lit(r"$ t = $\frac{1}{"), "p_size", F.lit("}$ ("), "p_partkey", F.lit(")"))
    return table(spark, d, "part").select("p_partkey", M.promote_display(M.merge_equations(t)).alias("promoted"))


@query("i16_repair", r"SELECT p_partkey, '\mathbf{v} in $x_{ab} \& {' || p_size || '}$ and $$y$$' AS repaired, 1::INT AS n_damages FROM part")
def i16(spark, d):
    t = F.concat(F.lit("mathbf{v} in $x_ab & {"), "p_size", F.lit("$ and $$y}}$$"))
    return table(spark, d, "part").select("p_partkey", M.repair(t).alias("repaired"), F.size(M.damages(F.lit("x_{a,b} $c$"))).alias("n_damages"))


@query("i18_placeholders", "SELECT p_partkey, 'see <img ' || p_size || '>, again ' || chr(10) || chr(10) || ' and ' || chr(10) || chr(10) || '.' AS shown, [p_size + 1] AS lost FROM part")
def i18(spark, d):
    """The first mark of a figure becomes its image, a repeated and an unknown one go; a figure without a mark is lost."""
    n = F.col("p_size")
    raw = F.concat(F.lit("see [Fig "), n, F.lit(": a caption], again ◈ FIG_"), n, F.lit("◈ and ◈FIG_0◈."))
    text = K.opaque(raw)
    shown = K.embed(text, "FIG", F.create_map(n.cast("int"), F.concat(F.lit("<img "), n, F.lit(">"))))
    return table(spark, d, "part").select("p_partkey", shown.alias("shown"), K.lost(text, "FIG", F.array(n, n + 1)).alias("lost"))


@query("i20_sanitize", r"SELECT p_partkey, p_size || '\% of \#' || p_partkey || '\textasciitilde{}\alpha ' || chr(34) || chr(34) AS latex FROM part")
def i20(spark, d):
    t = F.concat("p_size", F.lit("% of #"), "p_partkey", F.lit("~\\al\u0007pha “”"))
    return table(spark, d, "part").select("p_partkey", K.sanitize_latex(t).alias("latex"))


@query("i25_cards", "SELECT p_partkey, p_brand AS title, [p_name, p_type] AS items FROM part")
def i25(spark, d):
    t = F.concat(F.lit("intro\n### "), "p_brand", F.lit("\n- "), "p_name", F.lit("\n| a | b |\n\n#### sub\n- "), "p_type", F.lit(" $$x$$\n"))
    return table(spark, d, "part").select("p_partkey", F.explode(K.cards(t)).alias("c")).select("p_partkey", "c.title", "c.items")


@query("i26_labels", r"SELECT p_partkey, substr('part ' || p_name || ' / ' || p_type, 1, 50) AS label, 'P_' || p_partkey AS id, '∑_i=1^' || p_size || ' R f(x)' AS formula FROM part")
def i26(spark, d):
    label = F.concat(F.lit('part ["'), "p_name", F.lit('"]  | '), "p_type")
    latex = F.concat(F.lit(r"$\sum_{i=1}^{"), "p_size", F.lit(r"} \mathbb{R} f(x)\quad$"))
    ids = F.concat(F.lit("_P-"), "p_partkey", F.lit("!"))
    return table(spark, d, "part").select("p_partkey", K.safe_label(label).alias("label"), K.safe_id(ids).alias("id"), K.latex_label(latex).alias("formula"))


@query("c17_math_spans", r"SELECT p_partkey, 'size $\alpha _' || p_size || ' ^2$ end' AS line FROM part")
def c17(spark, d):
    """A symbol, a smaller number below it, a smaller one above, then words."""
    span = lambda t, size, y, math: F.struct(t.alias("text"), F.lit(size).alias("size"), F.lit(y).alias("y"), F.lit(math).alias("math"))
    spans = F.array(span(F.lit("size "), 10.0, 5.0, False), span(F.lit("α"), 10.0, 5.0, True), span(F.col("p_size").cast("string"), 7.0, 8.0, False), span(F.lit("2"), 5.0, 5.0, False), span(F.lit(" end"), 10.0, 5.0, False))
    return table(spark, d, "part").select("p_partkey", layout.line_text(layout.math_spans(spans)).alias("line"))


@query("c27_figures", "SELECT o_orderkey AS doc, l_linenumber AS block, author FROM (SELECT l.l_orderkey AS o_orderkey, l.l_linenumber, l.l_orderkey % 2 = 0 AND count(*) FILTER (WHERE l.l_linenumber % 2 = 1) OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber ROWS BETWEEN 2 PRECEDING AND 4 FOLLOWING) > 0 AS author, l.l_quantity FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL) l) WHERE l_linenumber % 2 = 0 AND l_quantity >= 25")
def c27(spark, d):
    """Line items as blocks of a page: even ones are images as wide as their quantity times two, odd ones tell of a professor."""
    once = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"))
    t = once.select(F.col("l_orderkey").alias("doc"), (F.col("l_orderkey") % 2 * -7 + 10).alias("page"), F.col("l_linenumber").alias("block"), F.lit(10).alias("pages"), (F.col("l_quantity") * 2).alias("width"), F.lit(60).alias("height"), F.when(F.col("l_linenumber") % 2 == 1, "She is an associate professor and an IEEE Fellow").alias("text"))
    return layout.figures(t, "doc", "page", "block", "pages", "width", "height", "text").select("doc", "block", "author")


@query("a22_document_text", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'é' || p_name WHEN 1 THEN 'é' || p_name WHEN 2 THEN '[image: ' || p_partkey || '.PNG]' END AS text FROM part")
def a22(spark, d):
    """Of four files one is UTF-8, one Latin-1, one an image and one of another kind."""
    n = F.col("p_partkey") % 4
    ending = F.when(n == 0, "txt").when(n == 1, "md").when(n == 2, "PNG").otherwise("bin")
    content = F.when(n == 1, F.encode(F.concat(F.lit("é"), "p_name"), "ISO-8859-1")).otherwise(F.encode(F.concat(F.lit("é"), "p_name"), "UTF-8"))
    return table(spark, d, "part").select("p_partkey", files.document_text(F.concat(F.lit("/in/"), "p_partkey", F.lit("."), ending), content).alias("text"))


@query("a22_cut", "SELECT doc_id, CASE WHEN length(text) <= 500 THEN text ELSE text[1:500] || '... (truncated, ' || length(text) || ' chars total)' END AS text FROM documents")
def a22_cut(spark, d):
    """With a cut of 500 characters, as the feature has one."""
    return table(spark, d, "documents").select("doc_id", files.document_text(F.lit("a.txt"), F.col("text").cast("binary"), 500).alias("text"))


@query("a15_listing", "WITH e AS (SELECT DISTINCT split_part(p_type, ' ', 1) || '/' AS entry FROM part WHERE p_brand <> 'Brand#11' UNION SELECT DISTINCT p_brand || '.txt' FROM part WHERE p_brand <> 'Brand#11') SELECT entry, (SELECT count(*) FROM e)::BIGINT AS total FROM e ORDER BY entry LIMIT 20")
def a15(spark, d):
    """Folders by the first word of the type, files by brand, and one brand below a folder that is left out."""
    p = table(spark, d, "part")
    deep = F.concat(F.lit("/root/"), F.when(F.col("p_brand") == "Brand#11", ".git/").otherwise(""), F.split("p_type", " ")[0], F.lit("/x.txt"))
    flat = F.concat(F.lit("/root/"), F.when(F.col("p_brand") == "Brand#11", ".git/").otherwise(""), "p_brand", F.lit(".txt"))
    return files.listing(p.select(F.explode(F.array(deep, flat)).alias("path")), "path", "/root", 20)


@query("a32_line_ages", "SELECT user_id, event_type, date_diff('day', max(ts)::DATE, DATE '2024-03-01')::INT AS age_days FROM events GROUP BY user_id, event_type")
def a32(spark, d):
    return changes.line_ages(table(spark, d, "events"), "user_id", "event_type", "ts", F.lit("2024-03-01").cast("date")).select("user_id", "event_type", "age_days")


@query("r9_expire", "SELECT user_id, arg_max(event_type, ts) AS event_type FROM events GROUP BY user_id HAVING max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 1440 MINUTE")
def r9(spark, d):
    """What was updated within a day before the last update of all."""
    e = table(spark, d, "events")
    now = F.lit(e.agg(F.max("ts").cast("timestamp")).first()[0])
    return changes.expire(e, "user_id", "ts", "event_type", now, 1440).select("user_id", "event_type")


@query("m4_reindex", "WITH t AS (SELECT lang, len(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+')) AS n FROM documents) SELECT 'all' AS index, count(*)::BIGINT AS docs, sum(n)::BIGINT AS tokens FROM t UNION ALL SELECT 'rebuilt', count(*)::BIGINT, sum(n)::BIGINT FROM t WHERE lang IS DISTINCT FROM 'en'")
def m4(spark, d):
    """The index of all documents; then English ones are deleted and it is rebuilt from those that are left."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    sizes = lambda name, index: index.lengths.agg(F.lit(name).alias("index"), F.count("*").alias("docs"), F.sum("doc_len").cast("long").alias("tokens"))
    first = bm25.Index.fit(docs).written()
    rebuilt = first.without(docs.filter("lang = 'en'").select(F.col("doc_id").alias("doc"))).written()
    return sizes("all", first).unionByName(sizes("rebuilt", rebuilt))


@query("a25_memory_entries", "SELECT p_partkey, 'u' || p_partkey AS uid, 'note ' || p_name AS text, p_size::INT AS importance FROM part")
def a25(spark, d):
    p = table(spark, d, "part")
    line = notes.memory_line(F.concat(F.lit("- note "), "p_name"), F.concat(F.lit("u"), "p_partkey"), F.col("p_size"), F.lit("2024-01-01"), F.lit("2024-01-02"))
    e = p.select("p_partkey", F.explode(notes.memory_entries(line)).alias("e"))
    return e.select("p_partkey", "e.uid", "e.text", "e.importance")


@query("a26_history", "SELECT p_partkey, u.cursor::INT AS cursor, u.stamp AS stamp, u.content AS content FROM part, LATERAL (VALUES (1, '2024-01-01 10:00', p_name), (2, 'none', 'and ' || p_type)) u(cursor, stamp, content)")
def a26(spark, d):
    text = F.concat(F.lit("[2024-01-01 10:00] "), "p_name", F.lit("\n\nand "), "p_type")
    e = table(spark, d, "part").select("p_partkey", F.explode(notes.history_entries(text, F.lit("none"))).alias("e"))
    return e.select("p_partkey", "e.cursor", F.col("e.timestamp").alias("stamp"), "e.content")


@query("a33_formula_collection", "SELECT p_brand AS file, p_partkey AS number, 'Paper ' || p_brand AS paper, 'x_' || p_size AS latex FROM part")
def a33(spark, d):
    p = table(spark, d, "part")
    heads = p.select(F.col("p_brand").alias("file"), F.lit(-1).cast("long").alias("number"), F.concat(F.lit("## 1. Paper "), "p_brand").alias("line")).distinct()
    body = p.select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("number"), F.concat(F.lit("a $$x_"), "p_size", F.lit("$$ b")).alias("line"))
    return notes.formula_collection(heads.unionByName(body), "file", "number", "line").select("file", "number", "paper", "latex")


@query("c8_binary", "SELECT p_partkey, p_partkey % 3 = 0 AS binary FROM part")
def c8(spark, d):
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.col("p_name").cast("binary"), F.unhex(F.lit("00")))).otherwise(F.col("p_name").cast("binary"))
    return table(spark, d, "part").select("p_partkey", files.is_binary(raw).alias("binary"))


@query("c15_fragments", "SELECT p_partkey, p_partkey % 4 <> 0 AS fragment FROM part")
def c15(spark, d):
    n = F.col("p_partkey") % 4
    card = F.when(n == 0, F.concat(F.lit("x_"), "p_size", F.lit(" = 1"))).when(n == 1, F.col("p_size").cast("string")).when(n == 2, F.lit("three words of prose")).otherwise(F.lit(" "))
    return table(spark, d, "part").select("p_partkey", notes.is_fragment(card).alias("fragment"))


@query("c21_faults", "SELECT o_orderkey, (o_totalprice > 100000)::INT + (o_orderstatus = 'P')::INT AS faults FROM orders")
def c21(spark, d):
    rules = {"price": {"type": "number", "required": True, "maximum": 100000}, "status": {"enum": ["O", "F"]}}
    row = {"price": F.col("o_totalprice").cast("string"), "status": F.col("o_orderstatus")}
    return table(spark, d, "orders").select("o_orderkey", F.size(notes.faults(row, rules)).alias("faults"))


@query("n14_extract_json", "SELECT p_partkey, p_size::BIGINT AS score FROM part")
def n14(spark, d):
    said = F.concat(F.lit("Sure:\n```json\n{\"score\": "), "p_size", F.lit(", \"tags\": [1, 2,],}\n```\nas asked"))
    return table(spark, d, "part").withColumn("v", jsonl.extract_object(said)).select("p_partkey", F.expr("variant_get(v, '$.score', 'bigint')").alias("score"))


@query("n17_mime", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' END AS mime FROM part")
def n17(spark, d):
    n = F.col("p_partkey") % 3
    head = F.when(n == 0, F.unhex(F.lit("89504E470D0A1A0A"))).when(n == 1, F.unhex(F.lit("FFD8FFE0"))).otherwise(F.unhex(F.lit("00")))
    return table(spark, d, "part").select("p_partkey", files.mime(F.concat(head, F.col("p_name").cast("binary"))).alias("mime"))


@query("a13_a14_walk", "SELECT 'n_regionkey=' || n_regionkey || '/n_nationkey=' || n_nationkey AS folder, length(n_name) + 1 AS size FROM nation WHERE n_regionkey <> 3")
def a13(spark, d):
    """A file for every nation below a folder of its region; those of one region are in a folder that a walk leaves out."""
    root = shared.path(spark, "walk") + "/a.b+c/docs/docs"
    rows = table(spark, d, "nation").select(F.col("n_name").alias("value"), "n_regionkey", "n_nationkey")
    rows.filter("n_regionkey <> 3").write.partitionBy("n_regionkey", "n_nationkey").text(root)
    rows.filter("n_regionkey = 3").write.partitionBy("n_regionkey", "n_nationkey").text(f"{root}/.git")
    found = files.walk(spark, root, "**/*.txt")
    return found.select(F.substring_index("path", "/", 2).alias("folder"), F.col("size").cast("long").alias("size"))


@query("a5_session", "SELECT 'k' AS session, user_id::VARCHAR AS name, event_type AS content FROM events WHERE event_id % 10 <> 9")
def a5(spark, d):
    """A session file with a header and, every ten lines, a broken one."""
    p = shared.path(spark, "session")
    e = table(spark, d, "events")
    line = F.when(F.col("event_id") % 10 == 9, F.lit('{"broken')).otherwise(F.to_json(F.struct(F.lit("user").alias("role"), F.col("event_type").alias("content"), F.col("user_id").cast("string").alias("name"))))
    head = spark.createDataFrame([('{"_type": "metadata", "key": "k"}',)], "value string")
    head.unionByName(e.select(line.alias("value"))).write.text(p)
    read, messages = jsonl.read_session(spark, p, repair=True)
    return messages.crossJoin(F.broadcast(read.select(F.col("key").alias("session")).limit(1))).select("session", "name", "content")


def _spans(spark, d):
    """Pages of whole documents: a line is a block of ten to a page, its words are spans; every seventh block is a heading, every ninth has a figure behind it."""
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    t = table(spark, d, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("doc"), F.explode(lines).alias("l")).select("doc", "l.i", "l.x")
    head = F.col("i") % 7 == 0
    said = F.when(head, F.concat((F.floor(F.col("i") / 7) + 1).cast("string"), F.lit(" Method"))).otherwise(F.regexp_replace("x", "[^A-Za-zÀ-ÿ ]", ""))
    top = (F.col("i") % 10 * 60).cast("double")
    words = t.select("doc", F.floor(F.col("i") / 10).cast("int").alias("page"), (F.col("i") % 10 * 2).cast("int").alias("block"), F.when(head, 12.0).otherwise(9.0).alias("size"), top.alias("top"), F.posexplode(F.split(F.trim(said), "(?<= )")).alias("span", "text"))
    words = words.select("doc", "page", "block", F.lit(0).alias("line"), "span", "text", F.lit("Times").alias("font"), "size", F.lit(50.0).alias("left"), F.lit(500.0).alias("right"), "top", (F.col("top") + 12).alias("bottom"))
    image = t.filter("i % 9 = 4").select("doc", F.floor(F.col("i") / 10).cast("int").alias("page"), (F.col("i") % 10 * 2 + 1).cast("int").alias("block"), F.lit(50.0).alias("left"), F.lit(500.0).alias("right"), (top + 13).alias("top"), (top + F.when(F.col("i") % 2 == 0, 73).otherwise(33)).alias("bottom"))
    return words.unionByName(image, allowMissingColumns=True)


@query("a18_blocks", """WITH l AS (SELECT doc_id, u.x, u.n - 1 AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL) q, LATERAL (SELECT unnest(q.a) AS x, generate_subscripts(q.a, 1) AS n) u),
w AS (SELECT doc_id, i, i % 10 * 2 AS block, CASE WHEN i % 7 = 0 THEN 'heading' ELSE 'text' END AS kind FROM l WHERE i % 7 = 0 OR trim(regexp_replace(x, '[^A-Za-zÀ-ÿ ]', '', 'g'), ' ') <> ''
UNION ALL SELECT doc_id, i, i % 10 * 2 + 1, 'figure' FROM l WHERE i % 9 = 4 AND i % 2 = 0)
SELECT doc_id AS doc, (i // 10)::INT AS page, block::INT AS block, row_number() OVER (PARTITION BY doc_id, i // 10 ORDER BY block)::INT AS place, kind, CASE WHEN i // 7 >= 0 THEN (i // 7 + 1) || ' Method' END AS section,
CASE WHEN kind = 'figure' THEN count(*) FILTER (WHERE kind = 'figure') OVER (PARTITION BY doc_id ORDER BY i, block) END AS figure FROM w""")
def a18_blocks(spark, d):
    """Sections carried over pages, and figures of the right size counted, on pages of one column."""
    parts = assembly.assembled(_spans(spark, d))
    return parts.select("doc", "page", "block", "place", "kind", "section", "figure")


@query("a18_documents")
def a18_documents(spark, d):
    parts = assembly.assembled(_spans(spark, d))
    return assembly.full_texts(parts).select("doc", F.sha2(F.col("text").cast("binary"), 256).alias("text"), "sections", "figures", "formulas")
