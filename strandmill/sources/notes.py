"""Notes kept in plain text: tagged memory lines, dated history, formula collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Fixed value: the tag behind a memory line.
TAG = r"<!--\s*uid:(\S+)\s+imp:(\d+)\s+ts:(\S+)\s+acc:(\S+)\s*-->"
STAMP = r"^\s*\[?(\d{4}-\d{2}-\d{2} \d{2}:\d{2})\]?"


def memory_line(text: Column, uid: Column, importance: Column, created: Column, used: Column) -> Column:
    return F.format_string("%s <!-- uid:%s imp:%d ts:%s acc:%s -->", text, uid, importance, created, used)


def memory_entries(text: Column) -> Column:
    """Array of (uid, text, importance, created_at, last_accessed): a tag belongs to the text before it on its line or, if there is none, to the lines since the tag before."""
    parts = F.regexp_extract_all(text, F.lit(rf"(?s)(.*?{TAG})"), 1)

    def one(p: Column) -> Column:
        get = lambda i: F.regexp_extract(p, TAG, i)
        return F.struct(get(1).alias("uid"), F.regexp_replace(X.strip(F.regexp_replace(p, TAG, "")), r"^- ", "").alias("text"), get(2).cast("int").alias("importance"), get(3).alias("created_at"), get(4).alias("last_accessed"))

    return F.transform(parts, one)


def history_entries(text: Column, fallback: Column) -> Column:
    """Array of (cursor, timestamp, content): chunks that begin with a date or behind a blank line."""
    plain = X.strip(F.regexp_replace(text, r"\r\n?", "\n"))
    marked = F.regexp_replace(plain, r"\n(?=\[?\d{4}-\d{2}-\d{2} \d{2}:\d{2})|\n[ \t]*\n\s*", "\u0000")
    chunks = F.filter(F.transform(F.split(marked, "\u0000"), X.strip), lambda c: c != "")

    def one(c: Column, i: Column) -> Column:
        at = F.regexp_extract(c, STAMP, 1)
        rest = F.ltrim(F.regexp_replace(c, STAMP, ""), F.lit(X.WS))
        return F.struct((i + 1).alias("cursor"), F.when(at == "", fallback).otherwise(at).alias("timestamp"), F.when((at == "") | (rest == ""), c).otherwise(rest).alias("content"))

    return F.transform(chunks, one)


def formula_collection(lines: DataFrame, file: str, number: str, line: str) -> DataFrame:
    """(file, number, paper, section, category, latex): formulas between $$ under the headings "## n. name" and "### n.m title" that stand above them."""
    w = Window.partitionBy(file).orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    head = lambda p, i: F.nullif(F.regexp_extract(line, p, i), F.lit(""))
    paper = F.last(head(r"^##\s+(\d+)\.\s+(.+)$", 2), ignorenulls=True).over(w)
    section = F.last(head(r"^###\s+(\d+\.\d+)\s+(.+)$", 2), ignorenulls=True).over(w)
    under = lines.select(file, number, line, paper.alias("paper"), section.alias("section"))  # before lines without formulas fall away
    named = under.withColumn("latex", F.explode(F.regexp_extract_all(line, F.lit(r"\$\$(.+?)\$\$"), 1)))
    return named.select(file, number, "paper", "section", X.category(F.coalesce("section", F.lit(""))).alias("category"), F.trim("latex").alias("latex"))


def is_fragment(card: Column) -> Column:
    """Whether the expression of a card is none: empty, a placeholder, numbers, a short name, or prose."""
    c = X.strip(card)
    letters = F.regexp_replace(c, r"[\s,.;:()\[\]{}|0-9+\-*/×⋅±]", "")
    words = F.filter(F.split(c, r"\s+"), lambda w: w.rlike("^[a-zA-Z]{2,}$"))
    bare = ~c.rlike(r"[\\_^=+<>≤≥≠≈≡∈⊂⊆∪∩∫∑∏∇∂]")
    return (c == "") | c.contains("◈") | (bare & ((F.length(letters) <= 1) | letters.rlike("^[a-zA-Z]{2,3}$") | (F.size(words) >= 3)))


def faults(row: dict[str, Column], rules: dict[str, dict]) -> Column:
    """What is wrong with the fields of a row under rules like JSON Schema's: type, required, enum, minimum, maximum, minLength, maxLength."""
    out = []
    for name, rule in rules.items():
        c, kind = row[name], rule.get("type")
        if rule.get("required"):
            out.append(F.when(c.isNull(), f"missing required {name}"))
        typed = {"integer": c.try_cast("long"), "number": c.try_cast("double"), "boolean": c.try_cast("boolean")}.get(kind, c)
        if kind in ("integer", "number", "boolean"):
            out.append(F.when(c.isNotNull() & typed.isNull(), f"{name} should be {kind}"))
        for key, test, said in (("minimum", lambda v: typed < v, ">="), ("maximum", lambda v: typed > v, "<=")):
            if key in rule:
                out.append(F.when(test(rule[key]), f"{name} must be {said} {rule[key]}"))
        for key, test, said in (("minLength", lambda v: F.length(c) < v, "at least"), ("maxLength", lambda v: F.length(c) > v, "at most")):
            if key in rule:
                out.append(F.when(test(rule[key]), f"{name} must be {said} {rule[key]} chars"))
        if "enum" in rule:
            out.append(F.when(c.isNotNull() & ~c.isin(*rule["enum"]), f"{name} must be one of {rule['enum']}"))
    return F.array_compact(F.array(*out))
