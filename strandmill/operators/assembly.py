"""Documents put together from the spans of their pages.

Spans become lines, lines blocks, and blocks go in reading order: where a page has two
columns, what is in the left one comes before the right one, between blocks that go over
both. Every step groups by line, block or page; only what is carried from page to page
(sections, numbers of figures and formulas) goes by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formula as M
from ..functions.text import strip
from . import layout

#: What a heading looks like besides being larger than HEAD, and what a caption begins with.
HEADINGS = (
    r"(?i)^(?:\d+(?:\.\d+)*\s+)?(?:Abstract|摘要|Introduction|引言|绪论|Related\s+Work|相关工作|System\s+Model|系统模型|Problem\s+Formulation|问题表述|Conclusion|总结|结论)$",
    r"^(?:\d+(?:\.\d+)*\s+)?(?:Experiment|实验|仿真)",
    r"^(?:\d+(?:\.\d+)*\s+)?[A-Z][A-Za-z\s]{2,50}$",
)
HEAD = 10
CAPTION = r"(?i)(?:^Fig\.?|^Figure|^图)\s*\d+"
#: A caption's distance below its figure and its length at most; least width and height of a figure.
BELOW, LONG, LEAST = 70, 300, 50


def text_blocks(spans: DataFrame) -> DataFrame:
    """(doc, page, block, text, size, math, left, right, top, bottom) from spans (doc, page, block, line, span, text, font, size, left, right, top, bottom)."""
    t = F.col("text")
    symbol = t.rlike(r"[^\x00-\x7F]|-") & t.rlike("[" + "".join(M.LATEX) + "]")
    math = M.is_math_font(F.col("font")) | M.looks_like_formula(t) | symbol
    each = spans.filter("text IS NOT NULL").withColumn("math", F.coalesce(math, F.lit(False)))
    box = [F.min("left").alias("left"), F.max("right").alias("right"), F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.max("size").alias("size")]
    parts = F.array_sort(F.collect_list(F.struct("span", "text", "size", F.col("top").alias("y"), "math")))
    lines = each.groupBy("doc", "page", "block", "line").agg(*box, parts.alias("s"))
    told = layout.math_spans(F.transform("s", lambda x: F.struct(x["text"].alias("text"), x["size"].cast("double").alias("size"), x["y"].cast("double").alias("y"), x["math"].alias("math"))))
    lines = lines.withColumn("told", told).withColumn("has", F.exists("told", lambda x: x["math"])).withColumn("text", M.merge_dollars(strip(layout.line_text(F.col("told")))))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), " ")
    blocks = lines.groupBy("doc", "page", "block").agg(*[F.min("left").alias("left"), F.max("right").alias("right"), F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.max("size").alias("size")], F.bool_or("has").alias("math"), whole.alias("text"))
    return blocks.withColumn("text", M.merge_dollars(strip(F.col("text")))).filter("text <> ''")


def reading_order(blocks: DataFrame) -> DataFrame:
    """``blocks`` with place: the order on a page.

    The middle of a page is that of its blocks. A page has two columns if no less than two
    blocks lie on either side of it. Blocks over both sides part a page in bands; within a
    band the left column comes first. Pages of one column keep the order of their blocks.
    """
    page = Window.partitionBy("doc", "page")
    middle = (F.min("left").over(page) + F.max("right").over(page)) / 2
    side = F.when(F.col("right") <= F.col("__mid") + 1, 0).when(F.col("left") >= F.col("__mid") - 1, 1)
    t = blocks.withColumn("__mid", middle).withColumn("__side", side)
    two = (F.count_if(F.col("__side") == 0).over(page) >= 2) & (F.count_if(F.col("__side") == 1).over(page) >= 2)
    down = page.orderBy("top", "block").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("__two", two).withColumn("__band", F.sum(F.when(F.col("__side").isNull(), 1).otherwise(0)).over(down))
    # A block over both columns opens its band.
    key = F.when(F.col("__two"), F.struct(F.col("__band").cast("double"), F.coalesce(F.col("__side") + 1, F.lit(0)).cast("double"), F.col("top").cast("double"), F.col("block").cast("double"))).otherwise(F.struct(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.col("block").cast("double")))
    return t.withColumn("place", F.row_number().over(page.orderBy(key))).drop("__mid", "__side", "__two", "__band")


def is_heading(text: Column, size: Column) -> Column:
    return (size > HEAD) & (text.rlike(HEADINGS[0]) | text.rlike(HEADINGS[1]) | text.rlike(HEADINGS[2]))


def assembled(spans: DataFrame) -> DataFrame:
    """(doc, page, block, place, kind, text, section, level, figure, author, formulas): what a document is made of, in order.

    ``kind`` is heading, text, figure or photo; a figure's text is its caption, from the next
    three blocks of its page. ``section`` is the last heading at or before a block, ``figure`` counts
    figures of a document but not photos beside a biography, ``formulas`` are those in the block that are valid.
    """
    words = text_blocks(spans)
    images = spans.filter("text IS NULL").select("doc", "page", "block", "left", "right", "top", "bottom")
    both = words.unionByName(images, allowMissingColumns=True)
    # By a window and not by a join with itself, so that the blocks are put together once; all that follows stays with its document.
    both = both.withColumn("pages", F.max("page").over(Window.partitionBy("doc")))
    near = Window.partitionBy("doc", "page").orderBy("block")
    under = F.collect_list(F.struct("text", "top")).over(near.rowsBetween(1, 3))
    around = F.concat_ws(" ", F.collect_list("text").over(near.rowsBetween(-2, -1)), F.collect_list("text").over(near.rowsBetween(1, 4)))
    image = F.col("text").isNull()
    both = both.withColumns({"__under": under, "__near": around})
    below = lambda x: x["top"] - F.col("bottom")
    fits = F.filter("__under", lambda x: x["text"].isNotNull() & (x["top"] > 0) & (below(x) > 0) & (below(x) < BELOW) & (F.length(x["text"]) < LONG) & x["text"].rlike(CAPTION))
    photo = (F.col("page") > F.col("pages") - 3) & (sum((F.col("__near").rlike(p).cast("int") for p in layout.BIOGRAPHY), F.lit(0)) >= 2)
    head = is_heading(F.col("text"), F.col("size"))
    kind = F.when(image & photo, "photo").when(image, "figure").when(head, "heading").otherwise("text")
    t = both.filter(~image | ((F.col("right") - F.col("left") >= LEAST) & (F.col("bottom") - F.col("top") >= LEAST)))
    t = reading_order(t.withColumns({"kind": kind, "__caption": F.substring(F.get(fits, F.lit(0))["text"], 1, 200)}))
    order = Window.partitionBy("doc").orderBy("page", "place")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("section", F.last(F.when(F.col("kind") == "heading", F.col("text")), ignorenulls=True).over(upto))
    t = t.withColumn("figure", F.when(F.col("kind") == "figure", F.count_if(F.col("kind") == "figure").over(upto)))
    inner = F.transform(F.regexp_extract_all("text", F.lit(r"(?<!\$)\$(?!\$)(.+?)(?<!\$)\$(?!\$)"), F.lit(1)), strip)
    found = F.transform(F.filter(inner, lambda f: (F.length(f) > 3) & M.is_formula(f)), lambda f: F.regexp_replace(f, r"\\Sigma(\s*[_^])", r"\\sum$1"))
    formulas = F.when(F.col("math"), found).otherwise(F.array().cast("array<string>"))
    level = F.when(F.col("kind") == "heading", F.length(F.regexp_replace("text", r"[^.]", "")))
    return t.select("doc", "page", "block", "place", "kind", F.when(image, F.col("__caption")).otherwise(F.col("text")).alias("text"), F.coalesce("section", F.lit("")).alias("section"), level.alias("level"), "figure", formulas.alias("formulas"))


def full_texts(parts: DataFrame) -> DataFrame:
    """(doc, text, sections, figures, formulas): pages apart by blank lines, figures as placeholders."""
    shown = F.when(F.col("kind") == "figure", F.concat(F.lit("\n[Fig "), "figure", F.lit(": "), F.coalesce("text", F.concat(F.lit("see original Fig "), "figure")), F.lit("]\n")))
    shown = shown.when(F.col("kind") == "photo", F.concat(F.lit("\n[Author Photo: "), F.coalesce("text", F.lit("author portrait")), F.lit("]\n"))).otherwise(F.col("text"))
    joined = lambda rows, by: F.array_join(F.transform(F.array_sort(rows), lambda x: x["t"]), by)
    page = parts.select("*", shown.alias("t")).groupBy("doc", "page").agg(joined(F.collect_list(F.struct("place", "t")), "\n").alias("t"), F.count_if(F.col("kind") == "heading").alias("h"), F.count("figure").alias("f"), F.sum(F.size("formulas")).alias("m"))
    return page.groupBy("doc").agg(joined(F.collect_list(F.struct("page", "t")), "\n\n").alias("text"), F.sum("h").alias("sections"), F.sum("f").alias("figures"), F.sum("m").alias("formulas"))
