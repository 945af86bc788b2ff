import re

import corpus_pipeline as P
from pyspark.sql import functions as F
from strandmill.llm import scratch, stages
from strandmill.llm.stages import STAGES


def test_stages_on_a_table_with_odd_rows(spark, tmp_path):
    line = "this licence line stands in very many documents"
    en = "the cat sat on the mat and looked at the other cats there and then the dog came in "
    rows = [(i, f"{line}\n{en * (1 + i % 5)}{i} and {i * 7} are the numbers of this text", "en", "s", None) for i in range(50)]
    rows += [(100, None, "en", "s", 0), (101, "123 456", "en", "s", 7), (102, "", None, None, None), (103, en + "mail me at someone@example.org now", None, "s", 1), (None, en, "en", "s", 1)]
    rows += [(200 + i, "one and the same document of a few words that was copied many times", "en", "hot", 1) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs = scratch.documents(spark, str(tmp_path))
    for name, stage in P.STAGES[:-1]:
        before, docs = docs, scratch.keep(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == df.columns and docs.count() <= before.count()
        if name == "language_id":
            assert {100, 101, 102}.isdisjoint(r["doc_id"] for r in docs.collect())
        if name == "line_dedup":
            assert docs.filter(F.col("text").contains(line)).count() == 1
        if name == "near_dedup":
            assert docs.filter("doc_id >= 200").count() <= 2  # the line kept in one, and one of those left empty
        if name == "pii":
            t = docs.filter("doc_id = 103").first()
            assert t is None or ("[EMAIL]" in t["text"] and t["n_chars"] == len(t["text"]))
    out = P.run(spark, str(tmp_path))
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in docs.collect()}


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in P.STAGES:
        docs = scratch.keep(stage(spark, docs, ""), name)
    assert docs.count() == 0


def test_names():
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "near_dedup", "pii", "pack"] and P.ORACLE_SQL is None and re


def test_stages_keep_columns_of_the_names_that_operators_add(spark):
    """lang_pred, score, held_out, n_lines, n_dropped, pii and the like are data like any other; one text is very long."""
    en = "the cat sat on the mat and looked at the other cats there and then the dog came in "
    names = ["lang_pred", "score", "held_out", "n_lines", "n_dropped", "pii", "least", "component", "node", "fp", "__t"]
    rows = [(i, en * (20_000 if i == 7 else 1) + f" a@b{i}.org is number {i} of the texts " + " ".join(f"w{i * k}" for k in range(30)), "en", "s", i, *[f"{n} of {i}" for n in names]) for i in range(12)]
    rows += [(50, None, "en", "s", 0, *names), (51, "", "en", "s", 0, *names), rows[3]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    docs = df
    for name, stage in P.STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, ""), name)
        assert docs.columns == df.columns
        for r in docs.collect():
            want = [f"{n} of {r['doc_id']}" for n in names] if r["doc_id"] < 50 else names
            assert [r[n] for n in names] == want
    assert {r["doc_id"] for r in docs.collect()} == set(range(12)) and docs.filter("doc_id = 3").count() == 2
    assert docs.filter("doc_id = 7 and n_chars > 1500000 and text like '%[EMAIL]%'").count() == 1
    assert STAGES[-1][1](spark, docs, "").groupBy("doc_id").count().count() == 12


def test_dropped_documents_may_be_joined(spark, monkeypatch):
    monkeypatch.setattr(stages, "MOST_SENT", 0)
    text = " ".join(f"word{i}" for i in range(40))
    df = spark.createDataFrame([(1, text), (2, text + " more"), (3, "other words than those"), (None, text)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0) for r in stages.near_dedup(spark, df, "").collect()) == [0, 1, 3]
