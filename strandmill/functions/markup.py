"""Placeholders, cards and labels made from texts with mathematics and Markdown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, strip


def opaque(text: Column) -> Column:
    """[Fig 3: caption] and [Table 2] become ◈FIG_3◈ and ◈TBL_2◈."""
    figures = F.regexp_replace(text, r"(?i)\[Fig\s+(\d+)\s*:?\s*[^\]]*\]", "◈FIG_$1◈")
    return F.regexp_replace(figures, r"(?i)\[Table\s+(\d+)\s*\]", "◈TBL_$1◈")


def embed(text: Column, kind: str, shown: Column) -> Column:
    """The first ◈kind_n◈ of every n becomes what the map ``shown`` has for n; later ones, and such without an entry, go.

    Blanks inside a mark are let pass. Where a mark goes a blank line stays.
    """
    mark = rf"◈\s*{kind}\s*_(\d+)\s*◈"

    def placed(t: Column) -> Column:
        hits = F.regexp_extract_all(t, F.lit(mark), 1)
        around = F.split(t, rf"◈\s*{kind}\s*_\d+\s*◈", -1)
        first = F.transform(hits, lambda h, i: F.when((F.array_position(hits, h) == i + 1) & F.map_contains_key(shown, h.cast("int")), shown[h.cast("int")]))
        gone = F.lit("\n\n")
        out = F.array_join(F.zip_with(around, first, lambda a, f: F.concat(a, F.coalesce(f, gone))), "")
        # zip_with runs to the longer side, so the last piece has got one mark too many
        whole = F.substring(out, F.lit(1), F.length(out) - F.length(gone))
        return F.regexp_replace(whole, r"\n{3,}", "\n\n")

    return F.when(text.rlike(mark), bound(text, placed)).otherwise(text)


def lost(text: Column, kind: str, numbers: Column) -> Column:
    """Those of ``numbers`` for which no mark is in the text."""
    there = F.regexp_extract_all(text, F.lit(rf"◈\s*{kind}\s*_(\d+)\s*◈"), 1)
    return F.filter(numbers, lambda n: ~F.array_contains(there, n.cast("string")))


def cards(text: Column, most: int = 5, items: int = 3) -> Column:
    """Array of (title, items) from "### " sections: lines that are neither headings nor table rows, without bullets and display mathematics."""
    clean = lambda s: strip(F.regexp_replace(F.regexp_replace(s, r"(?s)\$\$.*?\$\$|\\\[.*?\\\]", ""), r"\s+", " "))

    def one(part: Column) -> Column:
        found = F.split(part, "\n", 2)
        rows = F.filter(F.split(F.coalesce(F.get(found, F.lit(1)), F.lit("")), "\n"), lambda x: (strip(x) != "") & ~x.startswith("#"))
        shown = F.filter(F.transform(rows, lambda x: strip(F.regexp_replace(x, r"^[- ]+|[- ]+$", ""))), lambda x: ~x.rlike(r"^\|.*\|$"))
        return F.struct(clean(F.get(found, F.lit(0))).alias("title"), F.slice(F.transform(shown, clean), 1, items).alias("items"))

    parts = F.split(text, r"(?m)^### ")
    return F.slice(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), one), 1, most)


def safe_label(text: Column, most: int = 50) -> Column:
    """A node's label: without the characters that end one, bars as slashes, one line."""
    return F.left(strip(F.regexp_replace(F.replace(F.regexp_replace(text, r"""["#&<>(){}\[\];]""", ""), F.lit("|"), F.lit("/")), r"\s+", " ")), F.lit(most))


def safe_id(text: Column) -> Column:
    """Letters, digits and ideographs; all else is an underscore, none at the ends; G if nothing is left."""
    out = F.regexp_replace(F.regexp_replace(text, "[^a-zA-Z0-9_一-鿿]", "_"), "^_+|_+$", "")
    return F.when(out == "", "G").otherwise(out)


def latex_label(latex: Column, most: int = 40) -> Column:
    """A formula as plain text: sums and products as signs, alphabets and accents as their letters, other commands gone."""
    out = F.regexp_replace(latex, r"\\[()\[\]]|\$\$?", "")
    for command, sign in (("sum", "∑"), ("prod", "∏"), ("int", "∫")):
        out = F.regexp_replace(out, rf"\\{command}_\{{([^}}]+)\}}\^\{{([^}}]+)\}}", sign + "_{$1}^{$2}")
    out = F.regexp_replace(out, r"\\(min|max)\b", "$1")
    out = F.regexp_replace(out, r"\\(?:mathbb|mathbf|mathcal|boldsymbol)\{([^}]+)\}", "$1")
    for command, accent in (("hat", "\u0302"), ("tilde", "\u0303"), ("bar", "\u0304")):
        out = F.regexp_replace(out, rf"\\{command}\{{([^}}]+)\}}", "$1" + accent)
    out = F.regexp_replace(F.regexp_replace(out, r"\\[a-zA-Z]+(?:\{[^}]*\})?", ""), r"[{}\\]", "")
    return F.left(strip(F.regexp_replace(out, r"\s+", " ")), F.lit(most))


def sanitize_latex(text: Column) -> Column:
    """For a typesetter: control characters go, # and % are escaped, tildes spelt out, curly quotes and hard blanks made plain."""
    out = F.regexp_replace(F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""), "([#%])", r"\\$1")
    out = F.replace(out, F.lit("~"), F.lit("\\textasciitilde{}"))
    return F.replace(F.regexp_replace(F.regexp_replace(out, "[“”]", '"'), "[‘’]", "'"), F.lit("\u00a0"), F.lit(" "))
