"""Rules over the layout of a page, given as rows of spans and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formula import to_latex
from ..functions.text import bound

#: What a biography beside a photo says.
BIOGRAPHY = (
    r"(?i)(?:received|obtained|earned)\s+(?:the|his|her)\s+(?:B\.S\.|M\.S\.|Ph\.D\.|Bachelor|Master|Doctor)",
    r"(?i)(?:is|was)\s+(?:an?\s+)?(?:assistant|associate|full)\s+professor",
    r"(?i)research\s+interests?\s+(?:include|are|focus|lie)",
    r"(?i)(?:IEEE|ACM)\s+(?:Senior\s+)?(?:Member|Fellow)",
)


def math_spans(spans: Column) -> Column:
    """Array of (math, latex) for an array of (text, size, y, math) in reading order.

    A span behind a mathematical one is mathematical too if it is smaller by a quarter and
    stands higher or lower by more than 1; with 0.3 and 1.5 it is an index or an exponent.
    Sizes and heights are compared with the last mathematical span of an unbroken run.
    """

    def after(spans: Column, i: Column) -> tuple[Column, Column, Column]:
        """Of a span and the one before: whether both have a size, by how much it is smaller, and how much lower it stands."""
        x, last = F.get(spans, i), F.get(spans, i - 1)
        return (last["size"] > 0) & (x["size"] > 0), last["size"] / F.greatest(x["size"], F.lit(0.5)), x["y"] - last["y"]

    def kind(spans: Column) -> Column:
        """A letter a span: A for mathematics, M if it is that behind mathematics, N for neither; an M behind an N is turned into one."""

        def one(x: Column, i: Column) -> Column:
            run, ratio, down = after(spans, i)
            return F.when(x["math"], "A").when((i > 0) & run & (ratio >= 1.25) & (F.abs(down) > 1.0), "M").otherwise("N")

        return F.split(F.regexp_replace(F.array_join(F.transform(spans, one), ""), r"(?:(?<=N)|\G)M", "N"), "")

    def told(f: Column) -> Column:
        spans, kinds = f["spans"], f["kinds"]

        def one(x: Column, i: Column) -> Column:
            math = F.get(kinds, i) != "N"
            run, ratio, down = after(spans, i)
            run = (i > 0) & (F.get(kinds, i - 1) != "N") & run & (ratio >= 1.3)
            sign = F.when(run & (down > 1.5), "_").when(run & (down < -1.5), "^").otherwise("")
            return F.struct(math.alias("math"), F.when(math, F.concat(sign, to_latex(x["text"]))).otherwise(x["text"]).alias("latex"))

        return F.transform(spans, one)

    # Whether a run goes on is told by its last span alone, so all spans are judged at once, whatever the length of the line.
    return bound(bound(spans, lambda s: F.struct(s.alias("spans"), kind(s).alias("kinds"))), told)


def line_text(classified: Column) -> Column:
    """The text of a line: runs of mathematics between dollars, their spans apart by blanks."""
    joined = F.array_join(F.transform(classified, lambda x: F.when(x["math"], F.concat(F.lit("\u0001"), x["latex"], F.lit("\u0002"))).otherwise(x["latex"])), "")
    return F.regexp_replace(F.regexp_replace(F.replace(joined, F.lit("\u0002\u0001"), F.lit(" ")), "\u0001", r"\$"), "\u0002", r"\$")


def figures(blocks: DataFrame, doc: str, page: str, block: str, pages: str, width: str, height: str, text: str, least: int = 50) -> DataFrame:
    """Image blocks (null text) of at least ``least`` in both directions, with ``author``: whether it is a photo beside a biography.

    On the last three pages a photo is one whose neighbours, two blocks before and four behind, match two of the patterns.
    """
    near = Window.partitionBy(doc, page).orderBy(block)
    around = F.concat_ws(" ", F.collect_list(text).over(near.rowsBetween(-2, -1)), F.collect_list(text).over(near.rowsBetween(1, 4)))
    hits = sum((F.col("__near").rlike(p).cast("int") for p in BIOGRAPHY), F.lit(0))
    found = blocks.withColumn("__near", around).filter(F.col(text).isNull() & (F.col(width) >= least) & (F.col(height) >= least))
    return found.withColumn("author", (F.col(page) > F.col(pages) - 3) & (hits >= 2)).drop("__near")
