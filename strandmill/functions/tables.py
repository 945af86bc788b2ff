"""Markdown tables to and from arrays of cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def markdown_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def markdown_table(header: list[str], rows: Column) -> Column:
    """``rows``: array of arrays of strings; each is padded with empty cells or cut to the width of the header."""
    n = len(header)
    fit = lambda r: F.slice(F.concat(F.transform(r, lambda x: F.coalesce(x, F.lit(""))), F.array_repeat(F.lit(""), n)), 1, n)
    body = F.transform(rows, lambda r: markdown_row(fit(r)))
    head = F.array(markdown_row(F.array(*map(F.lit, header))), markdown_row(F.array_repeat(F.lit("---"), n)))
    return F.array_join(F.concat(head, body), "\n")


def table_rows(markdown: Column) -> Column:
    """Cells of the rows of a table, without its header and rule."""
    kept = F.filter(F.split(markdown, "\n", -1), lambda x: F.trim(x).rlike(r"^\|.*\|$"))
    cells = F.transform(kept, lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|", -1), lambda c: F.trim(c)))
    return F.slice(F.filter(cells, lambda r: ~F.forall(r, lambda c: c.rlike("^:?-+:?$"))), 2, 1 << 20)
