"""Sequential rules over the parts of one text, as folds inside a row.

A rule that depends on what was kept before is an ``aggregate`` with a small state; no
rows are moved and no Python is involved.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import bound, normal_paragraph, strip


def overlapping(text: Column, size: int, overlap: int) -> Column:
    """Pieces of ``size`` characters, each starting ``size - overlap`` behind the one before."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size - overlap))
    return F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(size)))


def dedup_paragraphs(text: Column, within: int = 5, short: int = 20) -> Column:
    """Drops a paragraph whose form was kept at most ``within`` places before. Short ones stay and count as kept; a dropped one is not seen again.

    A text without equal forms is left as it is; of others the fold gathers the places that are dropped.
    """
    indexed = F.transform(F.split(text, "\n\n", -1), lambda p, i: F.struct(i.alias("i"), p.alias("p"), strip(p).alias("s"), normal_paragraph(p).alias("form")))
    empty = F.struct(F.array().cast("array<int>").alias("dropped"), F.array().cast("array<struct<form:string,i:int>>").alias("seen"))

    def step(acc: Column, x: Column) -> Column:
        blank = x["s"] == ""
        tiny = (F.length(x["form"]) < short) & ~x["s"].rlike(r"^◈\s*[A-Z]+\s*_\d+\s*◈$")
        again = ~tiny & F.exists(acc["seen"], lambda y: (y["form"] == x["form"]) & (x["i"] - y["i"] <= within))
        recent = F.filter(acc["seen"], lambda y: (x["i"] - y["i"] < within) & (y["form"] != x["form"]))
        dropped = F.when(again & ~blank, F.concat(acc["dropped"], F.array(x["i"]))).otherwise(acc["dropped"])
        seen = F.when(again | blank, acc["seen"]).otherwise(F.concat(recent, F.array(F.struct(x["form"].alias("form"), x["i"].alias("i")))))
        return F.struct(dropped.alias("dropped"), seen.alias("seen"))

    def without_repeats(parts: Column) -> Column:
        dropped = F.aggregate(parts, empty, step, lambda acc: acc["dropped"])
        kept = bound(dropped, lambda out: F.filter(parts, lambda x: ~F.array_contains(out, x["i"])))
        distinct = F.size(F.array_distinct(parts["form"])) == F.size(parts)
        return F.when(distinct, text).otherwise(F.array_join(kept["p"], "\n\n"))

    return bound(indexed, without_repeats)


def dedup_boundaries(chunks: Column, most: int = 30) -> Column:
    """Drops a chunk whose normal form begins with the last ``most`` characters of the form of the chunk kept before."""
    empty = F.struct(F.array().cast("array<string>").alias("kept"), F.lit("").alias("tail"))

    def step(acc: Column, x: Column) -> Column:
        form = normal_paragraph(x)
        again = (acc["tail"] != "") & (F.substring(form, 1, most) == acc["tail"])
        kept = F.when(again, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(x)))
        return F.struct(kept.alias("kept"), F.when(again, acc["tail"]).otherwise(F.right(form, F.lit(most))).alias("tail"))

    return F.aggregate(chunks, empty, step, lambda acc: acc["kept"])


def merge_paragraphs(text: Column, tiny: int = 60, full: int = 200) -> Column:
    """Paragraphs, of which short ones join what stands before: below ``tiny`` with a line break, otherwise until ``full`` is reached; a heading starts anew."""
    parts = F.filter(F.transform(F.split(text, r"\n\s*\n", -1), strip), lambda p: p != "")
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))

    def close(acc: Column) -> Column:
        return F.when(acc["held"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["held"])))

    def step(acc: Column, p: Column) -> Column:
        head = p.startswith("#")
        join = ~head & (acc["held"] != "") & ((F.length(p) < tiny) | (F.length(acc["held"]) < full))
        glue = F.when(F.length(p) < tiny, "\n").otherwise("\n\n")
        return F.struct(F.when(join, acc["done"]).otherwise(close(acc)).alias("done"), F.when(join, F.concat(acc["held"], glue, p)).otherwise(p).alias("held"))

    return F.aggregate(parts, empty, step, close)


def pack_paragraphs(parts: Column, most: int) -> Column:
    """Joins parts by blank lines into chunks of at most ``most`` characters; a longer part is one chunk, and no chunk ends within $$ ... $$."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))

    def close(acc: Column) -> Column:
        return F.when(acc["held"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["held"])))

    def step(acc: Column, p: Column) -> Column:
        inside = F.regexp_count(acc["held"], F.lit(r"\$\$")) % 2 == 1
        join = (acc["held"] != "") & (inside | (F.length(acc["held"]) + F.length(p) + 2 <= most))
        return F.struct(F.when(join, acc["done"]).otherwise(close(acc)).alias("done"), F.when(join, F.concat(acc["held"], F.lit("\n\n"), p)).otherwise(p).alias("held"))

    return F.aggregate(parts, empty, step, close)


def split_message(text: Column, most: int) -> Column:
    """Cuts at the last line break within ``most`` characters, else at the last blank, else hard; what is around a cut is trimmed."""
    rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.length(text) * 2 / most) + 1).cast("int"))
    first = F.struct(F.array().cast("array<string>").alias("done"), text.alias("rest"))

    def step(acc: Column, _: Column) -> Column:
        rest = acc["rest"]
        head = F.substring(rest, 1, most)
        at_line, at_blank = F.length(F.regexp_extract(head, r"(?s)^(.+)\n", 1)), F.length(F.regexp_extract(head, r"(?s)^(.+) ", 1))
        cut = F.when(at_line > 0, at_line).when(at_blank > 0, at_blank).otherwise(F.lit(most))
        last = F.length(rest) <= most
        done = F.when(rest == "", acc["done"]).when(last, F.concat(acc["done"], F.array(rest))).otherwise(F.concat(acc["done"], F.array(F.substring(rest, F.lit(1), cut))))
        return F.struct(done.alias("done"), F.when(last, F.lit("")).otherwise(F.ltrim(rest.substr(cut + 1, F.length(rest)), F.lit(" \n"))).alias("rest"))

    return F.aggregate(rounds, first, step, lambda acc: F.when(acc["rest"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["rest"]))))


def sequence_overlap(before: Column, after: Column) -> Column:
    """The largest n for which the last n items of ``before`` are the first n of ``after``."""
    sizes = F.sequence(F.least(F.size(before), F.size(after)), F.lit(0), F.lit(-1))
    fits = F.filter(sizes, lambda n: (n == 0) | (F.slice(before, F.size(before) - n + 1, F.greatest(n, F.lit(1))) == F.slice(after, F.lit(1), F.greatest(n, F.lit(1)))))
    return F.get(fits, F.lit(0))
