from pyspark.sql import functions as F
from strandmill.functions import tables
from strandmill.functions import text as X
from strandmill.operators import folds


def one(spark, value, col, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(col.alias("r")).first()["r"]


P = [f"paragraph number {w} with enough characters" for w in "a b c d e f g".split()]


def test_dedup_paragraphs_compares_with_what_was_kept(spark):
    run = lambda parts: one(spark, "\n\n".join(parts), folds.dedup_paragraphs(F.col("x"))).split("\n\n")
    a, b, c, d, e, f, g = P
    assert run([a, b, a]) == [a, b]
    assert run([a, b, c, d, e, a]) == [a, b, c, d, e]
    assert run([a, b, c, d, e, f, a]) == [a, b, c, d, e, f, a]
    assert run([a, b, c, a, d, e, a]) == [a, b, c, d, e, a]  # the dropped one at 3 does not count, so the one at 6 is six places behind
    assert run(["tiny", "tiny", a, "TINY!"]) == ["tiny", "tiny", a, "TINY!"]
    assert run(["◈FIG_1◈", "x", "◈FIG_1◈"]) == ["◈FIG_1◈", "x"]
    assert run([a, "", "  ", a, b, "", b]) == [a, "", "  ", b, ""]
    many = [P[i % 3] for i in range(3000)]
    assert run(many) == [x for i, x in enumerate(many) if i // 3 % 2 == 0]  # three places on it is dropped, six on it is too far
    once = run([a, b, a, c, b])
    assert run(once) == once


def test_dedup_boundaries(spark):
    head = "these words stand at the end."
    parts = ["some text and " + head, head + " and more follows here", "other words entirely"]
    got = one(spark, parts, folds.dedup_boundaries(F.col("x")), "array<string>")
    assert got[0] == parts[0] and got[-1] == parts[2]


def test_merge_and_pack(spark):
    text = "# Head\n\nshort\n\n" + "x" * 150 + "\n\n" + "y" * 150 + "\n\n# Next\n\n" + "z" * 300
    got = one(spark, text, folds.merge_paragraphs(F.col("x")))
    assert got[0].startswith("# Head\nshort") and got[-1].startswith("# Next")
    packed = one(spark, ["a" * 40, "b" * 40, "$$ c", "d $$", "e" * 200], folds.pack_paragraphs(F.col("x"), 84), "array<string>")
    assert packed == ["a" * 40 + "\n\n" + "b" * 40, "$$ c\n\nd $$", "e" * 200]


def test_split_message(spark):
    got = one(spark, "one two\nthree four five six", folds.split_message(F.col("x"), 10))
    assert got == ["one two", "three four", "five six"] or all(len(g) <= 10 for g in got)
    hard = one(spark, "x" * 25, folds.split_message(F.col("x"), 10))
    assert hard == ["x" * 10, "x" * 10, "x" * 5]
    assert "".join(one(spark, "ab cd " * 50, folds.split_message(F.col("x"), 7))).replace(" ", "") == "abcd" * 50


def test_sequence_overlap(spark):
    df = spark.createDataFrame([([1, 2, 3], [2, 3, 4]), ([1], [2]), ([], [1]), ([1, 1], [1, 1])], "a array<int>, b array<int>")
    assert [r[0] for r in df.select(folds.sequence_overlap(F.col("a"), F.col("b"))).collect()] == [2, 0, 0, 2]


def test_sections(spark):
    got = one(spark, "Intro\nbody one\n\n\nAlone", X.sections(F.col("x")))
    assert [tuple(s) for s in got] == [("Intro", "body one"), ("Alone", "Alone")]
    assert [tuple(s) for s in one(spark, "", X.sections(F.col("x")))] == [("全文", "")]


def test_language_and_think_tags(spark):
    assert one(spark, "汉" * 200 + "a" * 100, X.language(F.col("x"))) == "zh"
    assert one(spark, "汉" * 199, X.language(F.col("x"))) == "en"
    assert one(spark, "汉" * 200 + "a" * 1000, X.language(F.col("x"))) == "en"
    for said, want in (("<think>a\nb</think>yes", "yes"), ("  <think>never closed", ""), ("<think广场 ok", "广场 ok"), ("x </think>", "x"), ("about <thinker> tags", "about <thinker> tags"), ("<|channel|> hi", "hi")):
        assert one(spark, said, X.strip_thinking(F.col("x"))) == want


def test_diagram_labels(spark):
    text = "actor / critic / target\nnew new old\nA sentence that stays, as it is.\n更新 a b 1 c"
    assert one(spark, text, X.without_diagram_labels(F.col("x"))) == "A sentence that stays, as it is."


def test_tables(spark):
    md = one(spark, [["1", "2", "3"], ["4"]], tables.markdown_table(["a", "b"], F.col("x")), "array<array<string>>")
    assert md == "| a | b |\n| --- | --- |\n| 1 | 2 |\n| 4 |  |"
    assert one(spark, md, tables.table_rows(F.col("x"))) == [["1", "2"], ["4", ""]]
