"""What larger tables showed: results that depended on the order of a sum, work that grew faster than its input."""

import math
import operator
import random
from functools import reduce

import duckdb
from pyspark.sql import functions as F

from strandmill.functions import formula, fragments, latex
from strandmill.functions import text as X
from strandmill.operators import assembly, comparing, layout
from strandmill.plans import QUERIES
from strandmill.sources import shared


def test_means_that_round_to_the_same_are_a_tie(spark):
    rows = [(2, 0.1), (2, 0.2), (2, 0.3), (1, 0.2), (1, 0.2), (1, 0.2 - 1e-12), (None, 0.2), (3, 0.9), (4, None)]
    board = comparing.leaderboard(spark.createDataFrame(rows, "i long, v double"), "i", "v", 6)
    assert [(r["i"], r["mean"]) for r in board.orderBy("place").collect()] == [(3, 0.9), (1, 0.2), (2, 0.2), (None, 0.2), (4, None)]


def test_means_at_half_do_not_hang_on_how_rows_are_dealt(spark):
    rng, rows, want = random.Random(5), [], {}
    for item in [*range(300), None]:
        cents = [rng.randrange(30000) * rng.choice((1, 1, -1)) for _ in range(64)]
        cents[-1] += (2 - sum(cents)) % 4
        rows += [(item, at, c / 100) for at, c in enumerate(cents)] + [(item, 64, None)]
        scaled = abs(reduce(operator.add, [c / 100 for c in cents], 0.0) / 64) * 10**6
        want[item] = math.copysign(math.floor(scaled) + (scaled % 1 >= 0.5), sum(cents)) / 10**6
    rows += [(1000, 0, None), (1001, 0, float("nan")), (1001, 1, 1.0), (1002, 0, 1e16), (1002, 1, 1.0), (1002, 2, -1e16), (1003, 0, 1e305)]
    want |= {1000: None, 1002: 0.0, 1003: 1e305}
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "i long, at long, v double").repartition(7)
    board = comparing.leaderboard(df, "i", "v", 6, order="at").orderBy("place").collect()
    assert math.isnan(board[0]["mean"]) and {r["i"]: r["mean"] for r in board[1:]} == want
    assert [r["i"] for r in board[1:]] == sorted(want, key=lambda i: (want[i] is None, -(want[i] or 0.0), i is None, i))
    assert [r["place"] for r in board] == list(range(1, len(want) + 2))


def test_doubles_are_rounded_as_sql_rounds_them(spark):
    rng = random.Random(6)
    values = [rng.randrange(10**9) / 10**7 * rng.choice((1, -1)) for _ in range(3000)] + [(10 * rng.randrange(10**8) + 5) / 10**7 for _ in range(3000)] + [1e300, 1e305, -1e305, math.inf, -math.inf, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    db = duckdb.connect()
    want = db.execute("SELECT list_transform(?::DOUBLE[], lambda x: round(x, 6))", [values]).fetchall()[0][0]
    assert [r[0] for r in df.select(comparing.rounded(F.col("v"), 6)).collect()] == want


def test_categories_are_those_of_the_patterns(spark):
    texts = ["状态x动作y奖励", "状态\n动作奖励", "奖励动作状态", r"min f s.t. \max g", "min f max g", r"\max min", "Cobb and Douglas", "Douglas Cobb", "an SNR and DQN", "CobbDouglas 经济成本", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for pattern, _ in X.CATEGORIES:
        assert df.filter(~X.any_of(F.col("t"), pattern).eqNullSafe(F.col("t").rlike(pattern))).count() == 0
    plan = df.select(X.category(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("rlike") < len(X.CATEGORIES)


def test_lines_of_page_furniture_are_dropped(spark):
    drop = ["doi: 10.1234/x", "arXiv: 2101.00001", "Received 3 May 2020", "2020 IEEE", "© 2020", "see https://example.org/a", "123", " 12 ", "ab", "", "Department of Physics", "University of X", "a@b.c"]
    kept = ["doi 10.1234/x", "arXiv 2101.00001", "Received in May 2020", "IEEE 2020", "https://x.y", "1234", "１２３", "School of the arts" + " x" * 60, "a of b", "  indented line", "文字文"]
    lines = [x for pair in zip(drop, kept + [""] * 2) for x in pair]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, ""), (3, None)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(X.without_metadata_lines(F.col("t"))).collect()] == ["\n".join(kept), "", None]


def test_parts_of_long_texts_are_those_of_the_text(spark):
    text = "".join(chr(c) for c in (97, 0x4E00, 10, 0x1F600, 98)) * 300
    places = [(0, 120), (136, 120), (255, 1), (255, 30), (256, 20), (1380, 120), (1490, 30), (1500, 20)]
    parts = latex.blocks(F.lit(text))
    got = spark.range(1).select(*[latex.part_of(parts, F.lit(a), F.lit(n)).alias(str(i)) for i, (a, n) in enumerate(places)]).first()
    assert list(got) == [text[a : a + n] for a, n in places]


def test_contexts_at_both_ends_and_in_the_middle(spark):
    text = r"$x_1 = y$ then " + "some words in between " * 40 + r"$z_2 = \alpha$ (3) end"
    got = latex.formulas(spark.createDataFrame([(1, text)], "i int, t string"), F.col("t"), ["i"]).orderBy("start").collect()
    assert [(r["latex"], r["number"]) for r in got] == [("x_1 = y", None), (r"z_2 = \alpha", "3")]
    assert got[0]["context"].startswith("then some words in") and got[1]["context"].endswith("(3) end") and len(got[1]["context"]) == 80 + 1 + 7


def test_a_text_is_computed_once_where_it_is_balanced(spark):
    df = spark.createDataFrame([('<div class="fmean">a $x{$ b</div><div class="fexpr"> {y & z</div>',)], "t string")
    out = df.select(latex.balance_expressions(latex.balance_meanings(F.reverse(F.reverse(F.col("t"))))).alias("o"))
    assert out._jdf.queryExecution().optimizedPlan().expressions().mkString().count("reverse(reverse(") == 1
    assert out.first()["o"] == '<div class="fmean">a $x{}$ b</div><div class="fexpr">{y \\& z}</div>'


def test_batches_for_python_are_bounded(spark):
    before = {k: spark.conf.get(k) for k in shared.BATCH}
    try:
        shared.bounded(spark)
        seen = F.pandas_udf(lambda s: s * 0 + len(s), "long")
        assert spark.range(5000, numPartitions=1).select(seen("id").alias("n")).agg(F.max("n")).first()[0] <= shared.BATCH["spark.sql.execution.arrow.maxRecordsPerBatch"]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_long_gaps_are_not_split_into_words(monkeypatch):
    monkeypatch.setattr(fragments.re, "search", lambda *a: 1 / 0)
    assert not fragments._joins("word " * 10_000) and fragments._joins(" + ")


def test_runs_of_mathematics_in_a_line_of_many_spans(spark):
    rng = random.Random(3)
    for n in (0, 1, 2, 40, 3000):
        spans = [(rng.choice(("x", "Σ")), rng.choice((0.0, 5.0, 7.0, 10.0)), rng.choice((0.0, 1.6, 3.0)), rng.random() < 0.3) for _ in range(n)]
        want, size, y = [], 0.0, 0.0
        for text, s, at, math in spans:
            run, ratio, down = size > 0 and s > 0, size / max(s, 0.5), at - y
            math = math or (run and ratio >= 1.25 and abs(down) > 1.0)
            sign = ("_" if down > 1.5 else "^" if down < -1.5 else "") if run and ratio >= 1.3 else ""
            want.append((math, sign + text.replace("Σ", "\\Sigma") if math else text))
            size, y = (s, at) if math else (0.0, 0.0)
        df = spark.createDataFrame([(spans,)], "s array<struct<text:string,size:double,y:double,math:boolean>>")
        assert list(map(tuple, df.select(layout.math_spans(F.col("s")).alias("m")).first()["m"])) == want
    told = df.select(layout.math_spans(F.col("s")).alias("m"))._jdf.queryExecution().optimizedPlan().expressions().mkString()
    assert "aggregate(" not in told


def test_plain_words_are_told_by_keywords_alone(spark):
    words = ["max", "the max of", "maximal", "", "  ", "for all", "there exists x", "subject to", "forall", "word", "détail", "a-b", "a - b", "min\n"]
    df = spark.createDataFrame([(w,) for w in words], "t string")
    got = [r[0] for r in df.select(formula.looks_like_formula(F.col("t"))).collect()]
    assert got == [True, True, False, False, False, True, True, True, False, False, False, True, True, True]


def test_blocks_are_put_together_once(spark):
    spans = "doc int, page int, block int, line int, span int, text string, font string, size double, left double, right double, top double, bottom double"
    rows = [(1, p, 0, 0, 0, "text", "Times", 9.0, 0.0, 1.0, 0.0, 1.0) for p in range(3)]
    plan = assembly.assembled(spark.createDataFrame(rows, spans))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_runs_share_folders(spark, tmp_path, monkeypatch):
    rows = [(i, f"2024-01-01 00:00:{i % 60:02d}", i % 300 if i else None) for i in range(900)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long").selectExpr("event_id", "CAST(ts AS TIMESTAMP_NTZ) AS ts", "user_id", "'view' AS event_type", "1D AS value", "'{}' AS props").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(shared, "path", lambda spark, name: f"{tmp_path}/{name}")
    got = {r["run"]: r["records"] for r in QUERIES["a9_runs"](spark, str(tmp_path)).collect()}
    assert got == {**{i: 3 for i in range(300)}, 0: 2, None: 1}
    assert len(list((tmp_path / "runs").glob("*/*.json"))) <= 64


def test_sessions_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(c, t, "user", "x") for c in range(40) for t in range(2)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    monkeypatch.setattr(shared, "path", lambda spark, name: f"{tmp_path}/{name}")
    got = sorted(map(tuple, QUERIES["u4_session_headers"](spark, str(tmp_path)).collect()))
    assert got == [(f"c{i}", "turns 2") for i in (13, 3, 5)]
    names = [p.name for p in (tmp_path / "sessions").glob("key=*/part-*")]
    assert len(names) == 40 and len({n.split("-")[1] for n in names}) > 10
