"""Okapi BM25 as relations: postings, document lengths, term and corpus statistics."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound, tokens
from ..sources import shared

K1, B = 1.5, 0.75
WORD = r"[\p{L}\p{N}_]"


def _counted(sorted_tokens: Column) -> Column:
    """(n, terms): equal tokens stand side by side, so each run of them is a term and its count."""
    n = F.size(sorted_tokens)
    places = F.filter(F.sequence(F.lit(0), n), lambda i: (i == n) | (i == 0) | (F.get(sorted_tokens, i) != F.get(sorted_tokens, i - 1)))

    def runs(begins: Column) -> Column:
        return F.transform(F.slice(begins, 1, F.size(begins) - 1), lambda b, k: F.struct(F.get(sorted_tokens, b).alias("term"), (F.get(begins, k + 1) - b).cast("long").alias("tf")))

    return F.struct(n.alias("n"), bound(places, runs).alias("terms"))


@dataclass
class Index:
    """counts(doc, doc_len, terms): a row per document with its terms and how often each occurs."""

    counts: DataFrame
    dealt: DataFrame | None = None

    @staticmethod
    def fit(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> Index:
        """A document without tokens counts among the documents; null texts have none. Terms are counted within the row, so nothing is shuffled."""
        t = docs.select(F.col(doc).alias("doc"), bound(F.sort_array(tokens(F.coalesce(F.col(text), F.lit("")))), _counted).alias("c"))
        return Index(t.select("doc", F.col("c.n").alias("doc_len"), F.col("c.terms").alias("terms")))

    @property
    def postings(self) -> DataFrame:
        """(doc, term, tf)"""
        if self.dealt is not None:
            return self.dealt
        return self.counts.select("doc", F.explode("terms").alias("t")).select("doc", "t.term", "t.tf")

    @property
    def lengths(self) -> DataFrame:
        """(doc, doc_len)"""
        return self.counts.select("doc", "doc_len")

    @property
    def stats(self) -> DataFrame:
        """(n, avgdl): one row."""
        return self.lengths.agg(F.count("*").alias("n"), (F.sum("doc_len") / F.greatest(F.lit(1), F.count("*"))).alias("avgdl"))

    def written(self) -> Index:
        """The same index as tables, the postings dealt and sorted by term, so that a search reads only the terms it asks for. A very common term may go to several tasks."""
        counts = Index(shared.keep(self.counts, "counts"))
        return Index(counts.counts, shared.keep(counts.postings.hint("rebalance", "term").sortWithinPartitions("term"), "postings"))

    def without(self, gone: DataFrame) -> Index:
        """The index of the documents that are not in ``gone`` (doc); what it knows of them is taken over, texts are not read again."""
        return Index(self.counts.join(gone, "doc", "left_anti"))

    def terms(self) -> DataFrame:
        """df(term): the documents that hold it."""
        return self.postings.groupBy("term").agg(F.count("*").alias("df"))


def score(docs: DataFrame, query: str, doc: str = "doc_id", text: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """(doc, score) of documents that hold a term of the query.

    Only the query's terms are counted, as whole words in the text, so neither tokens nor
    postings are built, and the only shuffle is that of the totals. The
    statistics of the terms are one row, as large as the query.
    """
    wanted = Counter(t for t in _terms(query))
    if not wanted:
        return docs.select(F.col(doc).alias("doc"), F.lit(0.0).alias("score")).limit(0)
    names = sorted(wanted)
    low = docs.select(F.col(doc).alias("doc"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("low"))
    t = low.select("doc", F.regexp_count("low", F.lit(WORD + "++")).alias("len"), *[F.regexp_count("low", F.lit(f"{w}(?<!{WORD}{w})(?!{WORD})")).alias(f"tf{i}") for i, w in enumerate(names)])
    t = shared.keep(t, "counts")  # a few numbers a document; the texts are read once
    totals = t.agg(F.count("*").alias("n"), F.sum("len").alias("all"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(names))])
    hit = t.filter(" OR ".join(f"tf{i} > 0" for i in range(len(names)))).crossJoin(F.broadcast(totals))
    avgdl = F.col("all") / F.greatest(F.lit(1), F.col("n"))
    out = F.lit(0.0)
    for i, w in enumerate(names):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        out = out + idf * wanted[w] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / avgdl))
    return hit.select("doc", out.alias("score"))


def _terms(query: str) -> list[str]:
    import re

    return re.findall(r"\w+", query.lower())


def search(docs: DataFrame, query: str, k: int = 20, **kw) -> DataFrame:
    """The k best, ties by document."""
    return score(docs, query, **kw).orderBy(F.desc("score"), "doc").limit(k)


def score_indexed(index: Index, query: str, k1: float = K1, b: float = B) -> DataFrame:
    """The same from an index: the query's terms are sent to the postings."""
    spark = index.postings.sparkSession
    wanted = Counter(_terms(query))
    q = F.broadcast(spark.createDataFrame(sorted(wanted.items()) or [("", 0)], "term string, qtf long"))
    hit = index.postings.join(q, "term")
    df = hit.groupBy("term").agg(F.count("*").alias("df"))
    s = hit.join(F.broadcast(df), "term").join(index.lengths, "doc").crossJoin(F.broadcast(index.stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("qtf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / F.col("avgdl")))
    return s.groupBy("doc").agg(F.sum(part).alias("score"))
