from pyspark.sql import functions as F
from strandmill.sources import notes


def one(spark, value, col):
    return spark.createDataFrame([(value,)], "x string").select(col.alias("r")).first()["r"]


def test_memory_entries_pair_a_tag_with_its_own_text(spark):
    text = "first fact <!-- uid:a imp:7 ts:t1 acc:t2 -->\nsecond fact\nover two lines\n<!-- uid:b imp:3 ts:t3 acc:t4 -->\n"
    got = [tuple(e) for e in one(spark, text, notes.memory_entries(F.col("x")))]
    assert got == [("a", "first fact", 7, "t1", "t2"), ("b", "second fact\nover two lines", 3, "t3", "t4")]
    line = one(spark, "fact", notes.memory_line(F.col("x"), F.lit("u"), F.lit(5), F.lit("c"), F.lit("d")))
    assert [tuple(e) for e in one(spark, line, notes.memory_entries(F.col("x")))] == [("u", "fact", 5, "c", "d")]


def test_history(spark):
    text = "[2024-01-02 03:04] first\nmore\n[2024-01-02 03:05] second\r\n\r\nno date here"
    got = [tuple(e) for e in one(spark, text, notes.history_entries(F.col("x"), F.lit("?")))]
    assert got == [(1, "2024-01-02 03:04", "first\nmore"), (2, "2024-01-02 03:05", "second"), (3, "?", "no date here")]


def test_formula_collection(spark):
    rows = ["## 1. Paper one", "### 1.1 通信模型", "text $$a = b$$ and $$c = d$$", "## 2. Paper two", "### 2.1 AoI", "$$e$$"]
    df = spark.createDataFrame([("f", i, r) for i, r in enumerate(rows)], "file string, n int, line string")
    got = [tuple(r)[2:] for r in notes.formula_collection(df, "file", "n", "line").orderBy("n", "latex").collect()]
    assert got == [("Paper one", "通信模型", "通信模型", "a = b"), ("Paper one", "通信模型", "通信模型", "c = d"), ("Paper two", "AoI", "AoI", "e")]


def test_fragments(spark):
    cases = {"": True, "◈FIG_1◈": True, "12 34": True, "ab": True, "this is plain prose": True, r"\alpha": False, "x = 1": False, "abcd": False, "x_i": False}
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    assert {r["x"]: r["f"] for r in df.select("x", notes.is_fragment(F.col("x")).alias("f")).collect()} == cases


def test_faults(spark):
    df = spark.createDataFrame([("5", "ok"), ("x", None), ("99", "toolong")], "n string, s string")
    rules = {"n": {"type": "integer", "minimum": 1, "maximum": 10}, "s": {"type": "string", "required": True, "maxLength": 4}}
    got = [r[0] for r in df.select(notes.faults({"n": F.col("n"), "s": F.col("s")}, rules)).collect()]
    assert got == [[], ["n should be integer", "missing required s"], ["n must be <= 10", "s must be at most 4 chars"]]


def test_listing_of_folders(spark):
    from strandmill.sources import files

    paths = spark.createDataFrame([(p,) for p in ("/r/a.txt", "/r/b/c.txt", "/r/b/d/e.txt", "/r/.git/x", "/q/z", "/r/b/node_modules/y")], "p string")
    assert [tuple(r) for r in files.listing(paths, "p", "/r/").collect()] == [("a.txt", 2), ("b/", 2)]
    assert [r[0] for r in files.listing(paths, "p", "/r", recursive=True).collect()] == ["a.txt", "b/", "b/c.txt", "b/d/", "b/d/e.txt"]
    assert [tuple(r) for r in files.listing(paths, "p", "/r", most=1).collect()] == [("a.txt", 2)]


def test_events_without_a_document_keep_their_id(spark, tmp_path):
    from strandmill.plans import QUERIES

    spark.createDataFrame([(1, "one title", "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, 1), (6, 2)], "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["j5_events_papers"](spark, str(tmp_path)).orderBy("event_id").collect()
    assert [tuple(r) for r in got] == [(5, "one title", "en"), (6, "2", "?")]
