"""Braces, dollars and formulas with their surroundings, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import formula as M
from .text import bound, strip

#: A brace behind an even number of backslashes; a closing one that may go has not exactly one backslash before it.
_OPEN, _CLOSE = r"(?<!\\)(?:\\\\)*+\{", r"(?<!\\)(?:\\\\)*+\}"
_LOOSE = r"(?<!(?:^|[^\\])\\)\}"
_INLINE = r"(?<!\$)\$(?!\$)(?:.+?)(?<!\$)\$(?!\$)"
#: Words that no formula has outside of \text, as a translation may put a sentence between dollars.
PROSE = """the and for are was not but all has had have can may our their this that with from they were been will would using based given
shown found used made taken seen said proposed defined described obtained derived computed method system model result paper figure table
section problem approach algorithm scheme strategy technique performance simulation experiment analysis scenario respectively therefore
however moreover furthermore denotes represents indicates corresponds follows satisfies line lines Algorithm Run respect regard terms order""".split()


def in_matches(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """``text`` with every match of ``pattern`` changed; the text between stays."""

    def rebuilt(t: Column) -> Column:
        hits = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), change)
        return F.array_join(F.zip_with(F.split(t, pattern, -1), hits, lambda gap, hit: F.concat(gap, F.coalesce(hit, F.lit("")))), "")

    return bound(text, lambda t: F.when(t.rlike(pattern), rebuilt(t)).otherwise(t))


def balance_braces(latex: Column) -> Column:
    """Adds the closing braces that are missing at the end, or takes those too many, the last ones first; escaped braces do not count."""

    def balanced(f: Column) -> Column:
        t, net = f["t"], f["net"]

        def fewer(parts: Column) -> Column:
            keep = F.greatest(F.size(parts) + net, F.lit(1))
            return F.concat(F.array_join(F.slice(parts, F.lit(1), keep), "}"), F.array_join(F.slice(parts, keep + 1, F.size(parts)), ""))

        return F.when(net >= 0, F.concat(t, F.repeat(F.lit("}"), net))).otherwise(bound(F.split(t, _LOOSE, -1), fewer))

    net = F.regexp_count(latex, F.lit(_OPEN)) - F.regexp_count(latex, F.lit(_CLOSE))
    return bound(F.struct(latex.alias("t"), net.alias("net")), balanced)


def escape_unmatched_dollars(text: Column) -> Column:
    """With an odd number of dollars outside of pairs the last one that stands alone is escaped."""
    odd = F.length(F.regexp_replace(F.replace(text, F.lit("$$"), F.lit("")), r"[^$]", "")) % 2 == 1
    return F.when(odd, F.regexp_replace(text, r"(?s)^(.*)(?<!\$)\$(?!\$)", r"$1\\\$")).otherwise(text)


def _within(tag: str, body: Callable[[Column], Column]) -> Callable[[Column], Column]:
    open_, close = f'<div class="{tag}">', "</div>"
    return lambda hit: F.concat(F.lit(open_), bound(F.substring(hit, F.lit(len(open_) + 1), F.length(hit) - len(open_) - len(close)), body), F.lit(close))


def balance_meanings(html: Column) -> Column:
    """In every explanation (div fmean) dollars are paired and the braces of its formulas balanced."""
    inner = lambda m: F.concat(F.lit("$"), balance_braces(F.substring(m, F.lit(2), F.length(m) - 2)), F.lit("$"))
    return in_matches(html, r'(?s)<div class="fmean">.*?</div>', _within("fmean", lambda b: in_matches(escape_unmatched_dollars(b), _INLINE, inner)))


def balance_expressions(html: Column) -> Column:
    """In every formula (div fexpr) braces are balanced, and & escaped where no environment has columns."""
    columns = rf"\\begin\{{(?:{M.COLUMNS})\*?\}}"
    amp = lambda t: F.when(t.contains("&") & ~t.rlike(columns), F.replace(t, F.lit("&"), F.lit(r"\&"))).otherwise(t)
    return in_matches(html, r'(?s)<div class="fexpr">.*?</div>', _within("fexpr", lambda b: bound(balance_braces(strip(b)), amp)))


def placed(text: Column, pattern: str) -> Column:
    """Array of (start, end, hit) of all matches, in code points; lengths are summed in blocks of 64."""

    def at(f: Column) -> Column:
        lens = f["lens"]
        before = lambda i: F.get(f["offs"], F.floor(i / 64).cast("int")) + F.aggregate(F.slice(lens, (F.floor(i / 64) * 64 + 1).cast("int"), (i % 64).cast("int")), F.lit(0), lambda s, x: s + x)
        start = lambda h, i: before(i) + F.length(F.get(f["gaps"], i))
        return F.transform(f["hits"], lambda h, i: bound(start(h, i), lambda s: F.struct(s.alias("start"), (s + F.length(h)).alias("end"), h.alias("hit"))))

    def summed(f: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor(F.greatest(F.size(f["hits"]) - 1, F.lit(0)) / 64).cast("int"))
        offs = F.transform(blocks, lambda b: F.aggregate(F.slice(f["lens"], F.lit(1), b * 64), F.lit(0), lambda s, x: s + x))
        return F.struct(f["hits"].alias("hits"), f["gaps"].alias("gaps"), f["lens"].alias("lens"), offs.alias("offs"))

    def measured(f: Column) -> Column:
        return F.struct(f["hits"].alias("hits"), f["gaps"].alias("gaps"), F.transform(f["hits"], lambda h, i: F.length(h) + F.length(F.get(f["gaps"], i))).alias("lens"))

    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps"))
    return bound(bound(bound(found, measured), summed), at)


#: Characters of a block of ``blocks``.
BLOCK = 256


def blocks(text: Column) -> Column:
    """The text in blocks of BLOCK code points, so that a place in it is reached without reading what is before."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0))


def part_of(parts: Column, start: Column, size: Column) -> Column:
    """``size`` code points, at most BLOCK, of the text of ``blocks`` from ``start`` (from 0) on."""
    at = F.floor(start / BLOCK).cast("int")
    two = F.concat(F.coalesce(F.get(parts, at), F.lit("")), F.coalesce(F.get(parts, at + 1), F.lit("")))
    return two.substr((start % BLOCK + 1).cast("int"), size)


def _is_prose(latex: Column) -> Column:
    """Words joined by a dash or five sequences of two letters without a command, or a word of a sentence outside of \\text."""
    parts = lambda t: F.transform(F.split(F.replace(t, F.lit(" "), F.lit("")), "[-—–]", -1), lambda p: p)
    dashed = latex.rlike("[-—–]") & F.forall(parts(latex), lambda p: p != "") & (F.size(F.filter(parts(latex), lambda p: F.length(F.regexp_replace(p, "[^a-zA-Z]", "")) >= 2)) >= 2)
    words = F.regexp_count(latex, F.lit("[a-zA-Z]{2,}")) >= 5
    said = F.regexp_replace(latex, r"\\text\{[^}]*\}", "").rlike(r"(?i)(?<![\p{L}\p{N}_])(?:" + "|".join(PROSE) + r")(?![\p{L}\p{N}_])")
    return (~latex.contains("\\") & (dashed | words)) | said


def candidates(text: Column) -> Column:
    """Array of (start, raw, number, context, display): what stands between $$, \\[ \\] or $, whatever it is.

    The number comes from a tag or stands in parentheses behind; the context is up to 80
    characters before and 30 behind.
    """

    def of(f: Column) -> Column:
        t, parts = f["t"], f["parts"]

        def one(kind: str, size: int, display: bool):
            def made(m: Column) -> Column:
                inner = strip(F.substring(m["hit"], F.lit(size + 1), F.length(m["hit"]) - 2 * size))
                tag = F.regexp_extract(m["hit"], r"\\tag\{(\d+[a-z]?)\}", 1)
                behind = F.regexp_extract(part_of(parts, m["end"], F.lit(20)), r"^\s*\((\d+[a-z]?)\)", 1)
                start = F.greatest(m["start"] - 120, F.lit(0))
                before = F.right(strip(part_of(parts, start, m["start"] - start)), F.lit(80))
                after = F.left(strip(part_of(parts, m["end"], F.lit(30))), F.lit(30))
                number = F.coalesce(F.nullif(tag, F.lit("")), F.nullif(behind, F.lit("")))
                return F.struct(m["start"].alias("start"), inner.alias("raw"), number.alias("number"), strip(F.concat(before, F.lit(" "), after)).alias("context"), F.lit(display).alias("display"))

            return F.transform(placed(t, kind), made)

        return F.concat(one(r"(?s)\$\$.+?\$\$", 2, True), one(r"(?s)\\\[.+?\\\]", 2, True), one(_INLINE, 1, False))

    whole = bound(bound(bound(text, M.merge_dollars), M.merge_equations), M.promote_display)
    return bound(bound(whole, lambda t: F.struct(t.alias("t"), blocks(t).alias("parts"))), of)


def formulas(docs: DataFrame, text: Column, keep: list[str]) -> DataFrame:
    """Rows (``keep``, start, latex, number, context, display) of the formulas of ``text``.

    Neighbours and two sides of an equation are put together first and displays promoted;
    ``start`` is the place in the text after that. Between single dollars only substantial
    formulas count. A null text has none.
    """
    raw = F.col("raw")
    ideographs = F.regexp_replace(raw, r"\\text\{[^}]*\}", "").rlike(M.CJK)
    out = docs.select(*keep, F.explode(candidates(text)).alias("__c")).select(*keep, "__c.*")
    out = out.filter((F.length(raw) >= 5) & ~raw.contains("◈") & ~ideographs).filter(F.col("display") | M.is_substantial(raw)).filter(M.is_formula(raw))
    latex = bound(balance_braces(strip(F.regexp_replace(raw, r"\\tag\{\d+[a-z]?\}", ""))), lambda x: F.struct(x.alias("x"), _is_prose(x).alias("prose")))
    # Exploded, so that a filter is not put before it with the whole expression again.
    out = out.withColumn("__l", F.explode(F.filter(F.array(latex), lambda x: ~x["prose"])))
    return out.select(*keep, "start", F.col("__l.x").alias("latex"), "number", "context", "display")
