"""Where an edit applies: the text that it replaces, looked for in ever looser ways.

The first way that finds anything counts: the text itself; its lines without the blanks
around them; the same with straight quotes; the text with straight quotes. What no way
finds gets the window of lines that is most like it, with what differs.
"""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound

WAYS = ("exact", "lines", "lines_quotes", "quotes")
#: Quotes that are made straight.
CURLY, STRAIGHT = "‘’“”", "''\"\""


def straight(text: Column) -> Column:
    return F.translate(text, CURLY, STRAIGHT)


def _lines(text: Column) -> Column:
    """Lines without their ends; a last empty one is none."""
    parts = F.split(text, "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def _hit(way: str, n: Column, line: Column) -> Column:
    """(way, n, line), null without a match."""
    return F.when(n > 0, F.struct(F.lit(way).alias("way"), n.cast("long").alias("n"), line.cast("long").alias("line")))


def _in_text(content: Column, old: Column, way: str) -> Column:
    """Matches that do not overlap."""
    n = (F.octet_length(content) - F.octet_length(F.replace(content, old, F.lit("")))) / F.octet_length(old)
    ahead = F.call_function("substring_index", content, old, F.lit(1))
    line = F.octet_length(ahead) - F.octet_length(F.replace(ahead, F.lit("\n"), F.lit(""))) + 1
    return F.when((old != "") & F.contains(content, old), _hit(way, n, line))


def _in_lines(content: Column, old: Column, way: str) -> Column:
    """Windows that equal the lines of ``old``; they are compared where the first line does."""
    n = F.size(old)
    starts = F.sequence(F.lit(1), F.greatest(F.size(content) - n + 1, F.lit(1)))
    fits = F.filter(starts, lambda i: F.get(content, i - 1).eqNullSafe(F.get(old, F.lit(0))) & (F.slice(content, i, F.greatest(n, F.lit(1))) == old))
    return F.when((n > 0) & (F.size(content) >= n), bound(fits, lambda at: _hit(way, F.size(at), F.get(at, F.lit(0)))))


def _both(content: Column, old: Column, then: Callable[[Column, Column], Column]) -> Column:
    """``then`` of two values that are computed once, not anew for every line that it looks at."""
    return bound(F.struct(content.alias("c"), old.alias("o")), lambda b: then(b["c"], b["o"]))


def _pruned_best(content: str, old: str) -> tuple[float, int]:
    """Likeness and first line of the best window; windows whose lines in common cannot be more are not compared."""
    lines, want = content.splitlines(keepends=True), old.splitlines(keepends=True)
    size = max(1, len(want))
    best, at, need = -1.0, 0, Counter(want)
    for i in range(max(1, len(lines) - size + 1)):
        window = lines[i : i + size]
        most = 2 * sum((need & Counter(window)).values()) / max(1, len(want) + len(window))
        if most > best:
            ratio = difflib.SequenceMatcher(None, want, window).ratio()
            if ratio > best:
                best, at = ratio, i
    return best, at + 1


def located(edits: DataFrame, content: str, old: str) -> DataFrame:
    """``edits`` with way (null if none), matches, and line: that of the first match."""
    trimmed = lambda t: F.transform(_lines(t), lambda x: F.trim(x))
    quoted = lambda a: F.transform(a, straight)
    c, o = F.col(content), F.col(old)
    in_quoted = lambda a, b: _both(quoted(a), quoted(b), lambda x, y: _in_lines(x, y, WAYS[2]))
    in_trimmed = _both(trimmed(c), trimmed(o), lambda a, b: F.coalesce(_in_lines(a, b, WAYS[1]), in_quoted(a, b)))
    in_straight = _both(straight(c), straight(o), lambda a, b: _in_text(a, b, WAYS[3]))
    t = edits.withColumn("__hit", F.coalesce(_in_text(c, o, WAYS[0]), in_trimmed, in_straight))  # a way is tried where none before it has found anything
    return t.select(*edits.columns, "__hit.way", F.coalesce("__hit.n", F.lit(0).cast("long")).alias("matches"), "__hit.line")


def nearest(edits: DataFrame, content: str, old: str) -> DataFrame:
    """``edits`` with ratio, line and hints of the most alike window: for edits that ``located`` has not found."""

    @F.pandas_udf("ratio double, line long")
    def rated(c: pd.Series, o: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_pruned_best(a or "", b or "") for a, b in zip(c, o)], columns=["ratio", "line"])

    squeezed = lambda t: F.regexp_replace(F.regexp_replace(t, r"(?m)^[ \t]+|[ \t]+$", ""), r"[ \t]+", " ")
    n = F.greatest(F.size(_lines(F.col(old))), F.lit(1))
    t = edits.withColumn("__n", rated(F.col(content), F.col(old)))
    actual = F.array_join(F.slice(F.split(content, "\n", -1), F.col("__n.line").cast("int"), n), "\n")
    want = F.regexp_replace(F.col(old), r"\n+$", "")
    t = t.withColumn("__a", F.regexp_replace(actual, r"\n+$", ""))
    a = F.col("__a")
    tests = {"letter case differs": F.lower(a) == F.lower(want), "whitespace differs": squeezed(a) == squeezed(want), "quote style differs": straight(a) == straight(want)}
    hints = F.array_compact(F.array(*[F.when(x & (a != want), F.lit(k)) for k, x in tests.items()]))
    return t.select(*edits.columns, F.round("__n.ratio", 6).alias("ratio"), F.col("__n.line").alias("line"), hints.alias("hints"))
