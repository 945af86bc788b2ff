"""Around model calls: retries, scores read from answers, reranks and errors of single rows."""

from pyspark.sql import functions as F

from strandmill.operators import calls


def test_a_failing_batch_is_asked_text_by_text():
    seen = []

    def fn(texts):
        seen.append(len(texts))
        if len(texts) > 1 or texts[0] == "bad":
            raise ValueError
        return [t.upper() for t in texts]

    assert calls.retried(fn)(["a", "bad", "b"]) == ["A", None, "B"] and seen == [3, 3, 1, 1, 1, 1]


def test_scores_are_read_from_lines(spark):
    text = "<0>: 7\n 2 ： 11.5\nno\n3: 0.2\n0: 4.5\nx 5: 3"
    r = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(calls.parsed_scores(F.col("t")).alias("m")).collect()
    assert [x["m"] for x in r] == [{0: 4.5, 2: 10.0, 3: 1.0}, {}, {}]


def test_rerank(spark):
    rows = [(1, "q", i, f"text {i}", i) for i in range(30)] + [(2, "few", i, "t", i) for i in range(3)] + [(3, "bad", i, "t", i) for i in range(9)]
    asked = []

    def fn(texts):
        asked.extend(texts)
        if any("bad" in t for t in texts):
            raise ValueError
        return ["19: 9\n4: 9\n7: 9.5\n25: 10" for _ in texts]

    df = spark.createDataFrame(rows, "q int, asked string, d int, t string, o int").coalesce(1)
    got = {}
    for r in calls.rerank(df, "q", "asked", "d", "t", "o", fn, top=4).orderBy("q", "place").collect():
        got.setdefault(r["q"], []).append((r["doc"], r["score"]))
    assert got == {1: [(7, 9.5), (4, 9.0), (19, 9.0), (0, 5.0)], 2: [(i, 10.0) for i in range(3)], 3: [(i, 10.0) for i in range(4)]}


def test_a_missing_score_is_an_error_of_its_row(spark):
    fn = lambda texts: [None if "b" in t.split("\n")[1] else "none" if "c" in t.split("\n")[1] else "8 of 10" for t in texts]
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "p int, t string")
    got = {(r["p"], r["dimension"]): (r["score"], r["error"]) for r in calls.scored(df, "p", "t", ["x", "y"], fn).collect()}
    assert got[1, "x"] == (8.0, None) and got[2, "y"] == (None, "no answer") and got[3, "x"] == (None, "missing score") and got[4, "y"] == (8.0, None)
