"""What is done around single model calls: cutting and laying out what is asked, reading what comes back.

The model itself is a function that the caller gives (see ``models``). A call is tried again
once; what cannot be read becomes a stated default or an error in the row, never a lost row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import models

#: Candidates and characters of a rerank, its neutral score, and the bounds of a score.
MOST, CUT, NEUTRAL, LOW, HIGH = 20, 500, 5.0, 1.0, 10.0
SCORE_LINE = r"^\s*<?(\d+)>?\s*[:：]\s*(\d+(?:\.\d+)?)"


def retried(fn: models.ModelFn, tries: int = 2) -> models.ModelFn:
    """``fn``, asked again if it fails; a batch that fails ``tries`` times is asked text by text, and what fails then is null."""

    def once(texts: list[str]) -> list[str | None]:
        for _ in range(tries):
            try:
                return fn(texts)
            except Exception as e:  # noqa: BLE001  whatever a caller's function raises
                failed = e
        if len(texts) == 1:
            return [None]
        del failed
        return [once([t])[0] for t in texts]

    return once


def parsed_scores(answer: Column) -> Column:
    """Map of number to score from lines like ``3: 7.5``, between 1 and 10; of two lines with a number the last counts."""
    lines = F.filter(F.split(F.coalesce(answer, F.lit("")), "\n"), lambda x: x.rlike(SCORE_LINE))
    pairs = F.transform(lines, lambda x, i: F.struct(F.regexp_extract(x, SCORE_LINE, 1).cast("long").alias("k"), i.alias("i"), F.least(F.lit(HIGH), F.greatest(F.lit(LOW), F.regexp_extract(x, SCORE_LINE, 2).cast("double"))).alias("v")))
    last = F.filter(pairs, lambda p: ~F.exists(pairs, lambda q: (q["k"] == p["k"]) & (q["i"] > p["i"])))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], p["v"])))


def rerank(candidates: DataFrame, query: str, asked: str, doc: str, text: str, order: str, fn: models.ModelFn, top: int = 5, most: int = MOST, cut: int = CUT) -> DataFrame:
    """(query, doc, score, place): the best ``top`` of the first ``most`` candidates of every query, by ``order``.

    All candidates of a query are laid out in one text, ``cut`` characters each. With ``top`` or
    fewer there is nothing to ask: all score 10. So they do if no answer comes; a candidate
    without a line of its own scores 5. Ties stay in their order.
    """
    no = F.row_number().over(Window.partitionBy(query).orderBy(order)) - 1
    few = candidates.withColumn("__no", no).filter(F.col("__no") < most)
    line = F.concat(F.lit("<"), F.col("__no"), F.lit(">"), F.substring(F.coalesce(text, F.lit("")), 1, cut), F.lit("</"), F.col("__no"), F.lit(">"))
    each = few.groupBy(query).agg(F.array_sort(F.collect_list(F.struct(F.col("__no").alias("no"), F.col(doc).alias("doc"), line.alias("line")))).alias("c"), F.first(asked).alias("__q"))
    laid = F.concat(F.lit("query: "), F.substring(F.coalesce("__q", F.lit("")), 1, cut), F.lit("\n\n"), F.array_join(F.transform("c", lambda x: x["line"]), "\n\n"))
    each = models.ask(each.withColumn("__text", F.when(F.size("c") > top, laid)), "__text", "__answer", retried(fn))
    scores = F.when((F.size("c") <= top) | F.col("__answer").isNull(), F.create_map().cast("map<bigint,double>")).otherwise(parsed_scores(F.col("__answer")))
    default = F.when((F.size("c") <= top) | F.col("__answer").isNull(), F.lit(HIGH)).otherwise(F.lit(NEUTRAL))
    rated = each.withColumns({"__s": scores, "__d": default}).select(query, "__s", "__d", F.explode("c").alias("x"))
    rated = rated.select(query, F.col("x.doc").alias("doc"), F.col("x.no").alias("__no"), F.coalesce(F.try_element_at("__s", F.col("x.no").cast("long")), F.col("__d")).alias("score"))
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), "__no"))
    return rated.withColumn("place", place).filter(F.col("place") <= top).select(query, "doc", "score", "place")


def scored(papers: DataFrame, paper: str, text: str, dimensions: list[str], fn: models.ModelFn, cut: int = 3000, layout: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(paper, dimension, score, error): a paper is asked about once per dimension; a missing score is an error of that row only."""
    form = layout or (lambda dim, t: F.concat(F.lit("Score "), dim, F.lit(" from 1 to 10:\n"), t))
    each = papers.select(paper, F.substring(F.coalesce(text, F.lit("")), 1, cut).alias("__t")).withColumn("dimension", F.explode(F.array(*[F.lit(x) for x in dimensions])))
    each = models.ask(each.withColumn("__text", form(F.col("dimension"), F.col("__t"))), "__text", "__answer", retried(fn))
    n = F.regexp_extract(F.coalesce("__answer", F.lit("")), r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    error = F.when(F.col("__answer").isNull(), "no answer").when(n.isNull(), "missing score")
    return each.select(paper, "dimension", F.when(n.isNotNull(), F.least(F.lit(HIGH), F.greatest(F.lit(LOW), n))).alias("score"), error.alias("error"))
