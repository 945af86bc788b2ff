"""Stages of the pipeline: (spark, docs, sf_dir) to a DataFrame, all but the last with the columns of ``docs``.

What the operators add never takes the place of a column of the same name: other columns
pass through as they are, but n_chars, which follows the text. Repeated rows are treated
alike, empty tables give empty tables, and texts are read whole, whatever their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, lines, packing, pii, scratch, simhash

#: So many ids of dropped documents are sent to every task; more are joined.
MOST_SENT = 1_000_000


def _apart(docs: DataFrame, *names: str) -> DataFrame:
    """The columns called ``names``, and __row with all columns."""
    return docs.select(F.struct(*docs.columns).alias("__row"), *[F.col(n) for n in dict.fromkeys(names)])


def _back(found: DataFrame, docs: DataFrame, text: Column | None = None) -> DataFrame:
    """The columns of ``docs`` from __row; with ``text`` that column in place of text, and its length as n_chars."""
    new = {} if text is None else {"text": text, "n_chars": F.length(text).cast("long")}
    return found.select(*[new[c].alias(c) if c in new else F.col("__row").getField(c).alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents for which a language is found; null and empty texts and such without a letter go.

    If nothing can be learned (no row with a language and an id), no document has one. A tie
    between languages does not matter here.
    """
    scratch.bounded(spark)
    found = language.identify(_apart(docs, "doc_id", "text", "lang"))
    return _back(found.filter(F.col("lang_pred") != language.UND), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines; a document may become empty, a null text becomes an empty one. A null id counts for no line."""
    scratch.bounded(spark)
    return _back(lines.dedup_lines(_apart(docs, "doc_id", "text")), docs, F.col("text"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the smallest id stays; rows without id stay, rows of one id stay together.

    Texts are near-duplicates if their fingerprints differ in three bits or fewer, or if the
    cosine of their sets of five-word shingles, which is what SimHash estimates, is 0.8 or
    more. Texts without words are duplicates of each other.
    """
    scratch.bounded(spark)
    found = simhash.near_copies(docs, measure="cosine")
    lost = scratch.keep(found.filter("node <> component").select(F.col("node").alias("__lost")).distinct(), "lost")
    if lost.count() <= MOST_SENT:
        lost = F.broadcast(lost)
    return docs.join(lost, F.col("doc_id").cast("long") == F.col("__lost"), "left_anti").select(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind in brackets in the place of personal data; a null text stays null."""
    return _back(pii.redact(pii.detect(_apart(docs, "text"))), docs, F.col("text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places in sequences of 2,048 tokens; a null or empty text is the closing token alone."""
    scratch.bounded(spark)
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("pii", redact), ("pack", pack)]
