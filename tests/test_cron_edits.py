"""Cron schedules against a walk over the minutes; places of edits against plain Python."""

import random
from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from strandmill.functions.cron import next_cron, next_time, parsed
from strandmill.operators import edits
from strandmill.sources import files


def ms(*at, zone="UTC"):
    return int(datetime(*at, tzinfo=ZoneInfo(zone)).timestamp() * 1000)


def walked(expr, after, zone, most=60 * 24 * 70):
    """The first minute behind ``after`` whose local fields are in the sets of the schedule; of a time that comes twice the first."""

    def values(text, low, high):
        out = set()
        for part in text.split(","):
            span, _, step = part.partition("/")
            a, _, b = span.partition("-")
            first, last = (low, high) if span == "*" else (int(a), int(b or (high if step else a)))
            out |= set(range(first, last + 1, int(step or 1)))
        return out

    f = expr.split()
    sets = [values(t, *r) for t, r in zip(f, ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7)))]
    for k in range(1, most):
        at = (after // 60000 + k) * 60000
        d = datetime.fromtimestamp(at / 1000, ZoneInfo(zone))
        day, week = d.day in sets[2], d.isoweekday() % 7 in {x % 7 for x in sets[4]}
        fits = (day or week) if len(sets[2]) < 31 and len({x % 7 for x in sets[4]}) < 7 else (day and week)
        if not d.fold and d.minute in sets[0] and d.hour in sets[1] and d.month in sets[3] and fits:
            return at
    return None


@pytest.mark.parametrize("zone", ["UTC", "Asia/Kolkata", "America/New_York"])
def test_equals_a_walk_over_the_minutes(zone):
    rng = random.Random(1)
    field = lambda low, high: rng.choice(("*", str(rng.randint(low, high)), f"*/{rng.randint(2, 9)}", f"{low}-{rng.randint(low, high)}", f"{rng.randint(low, high)},{rng.randint(low, high)}"))
    for _ in range(60):
        # June and July have no change of clocks; of the hours of a gap see below.
        expr = f"{field(0, 59)} {field(0, 23)} {field(1, 28)} * {field(0, 6)}"
        after = ms(2024, 6, rng.randint(1, 28), rng.randint(0, 23), rng.randint(0, 59), zone=zone) + rng.choice((0, 1, 59_999))
        assert next_time(expr, after, zone) == walked(expr, after, zone), (expr, after)


def test_clocks_that_change():
    ny = "America/New_York"
    # 02:30 does not exist on 10 March 2024: it runs as long after the gap.
    assert next_time("30 2 * * *", ms(2024, 3, 10, 1, 0, zone=ny), ny) == ms(2024, 3, 10, 3, 30, zone=ny)
    assert next_time("30 2 * * *", ms(2024, 3, 10, 3, 30, zone=ny), ny) == ms(2024, 3, 11, 2, 30, zone=ny)
    # 01:30 comes twice on 3 November 2024 and runs once.
    first = next_time("30 1 * * *", ms(2024, 11, 3, 0, 0, zone=ny), ny)
    assert first == int(datetime(2024, 11, 3, 5, 30, tzinfo=timezone.utc).timestamp() * 1000)
    assert next_time("30 1 * * *", first, ny) == ms(2024, 11, 4, 1, 30, zone=ny)


def test_names_rare_days_and_nonsense():
    assert next_time("0 0 29 feb *", ms(2024, 3, 1)) == ms(2028, 2, 29)
    assert next_time("0 9 * * mon-fri", ms(2024, 6, 7, 9)) == ms(2024, 6, 10, 9)
    assert next_time("0 0 * * 7", ms(2024, 6, 7)) == ms(2024, 6, 9)
    assert next_time("0 0 13 * fri", ms(2024, 6, 8)) == ms(2024, 6, 13)  # either will do
    assert next_time("0 0 30 2 *", ms(2024, 1, 1)) is None
    for bad in ("", "* * * *", "60 * * * *", "* * * * mo", "5-1 * * * *", "*/0 * * * *"):
        assert next_time(bad, 0) is None
    assert next_time("* * * * *", 0, "No/Where") is None and parsed("0 0 * * 7")[4] == 1


def test_schedules_as_columns(spark):
    rows = [("0 0 * * *", 0, None), (None, 0, "UTC"), ("0 0 * * *", None, "UTC"), ("bad", 0, "UTC"), ("0 12 * * *", 0, "Asia/Kolkata")]
    got = spark.createDataFrame(rows, "e string, at long, z string").coalesce(1).select(next_cron(F.col("e"), F.col("at"), F.col("z")).alias("n")).collect()
    assert [r["n"] for r in got] == [86_400_000, None, None, None, 6 * 3_600_000 + 1_800_000]


def plain(content, old):
    """(way, lines): line by line and character by character."""
    quotes = str.maketrans(edits.CURLY, edits.STRAIGHT)

    def inside(c, o):
        out, at = [], c.find(o) if o else -1
        while at >= 0:
            out.append(c[:at].count("\n") + 1)
            at = c.find(o, at + len(o))
        return out

    def windows(c, o):
        parts = lambda t: [x.strip(" ") for x in (t[:-1] if t.endswith("\n") else t).split("\n")] if t else []
        c, o = parts(c), parts(o)
        return [i + 1 for i in range(len(c) - len(o) + 1) if o and c[i : i + len(o)] == o]

    s = lambda t: t.translate(quotes)
    for way, found in zip(edits.WAYS, (inside(content, old), windows(content, old), windows(s(content), s(old)), inside(s(content), s(old)))):
        if found:
            return way, found
    return None, []


def test_edits_equal_plain_python(spark):
    rng = random.Random(2)
    line = lambda: rng.choice(("", " ", "  ")) + rng.choice(("a 'b'", 'say "x"', "c\\E.d", "a", "b $1")) + rng.choice(("", " "))
    rows = []
    for i in range(500):
        content = [line() for _ in range(rng.randrange(1, 9))]
        a = rng.randrange(len(content))
        old = content[a : a + rng.randrange(1, 3)]
        change = rng.choice((lambda x: x, lambda x: " " + x.strip(), lambda x: x.replace("'", "’").replace('"', "“"), lambda x: x[1:], lambda x: x + "q"))
        rows.append((i, "\n".join(content) + rng.choice(("", "\n")), "\n".join(map(change, old)) + rng.choice(("", "", "\n"))))
    for r in edits.located(spark.createDataFrame(rows, "id long, c string, o string").repartition(4), "c", "o").collect():
        way, lines = plain(r["c"], r["o"])
        assert (r["way"], r["matches"], r["line"]) == (way, len(lines), lines[0] if lines else None), (r["c"], r["o"])


def test_the_most_alike_window_with_what_differs(spark):
    import difflib

    rng = random.Random(3)
    rows = [(i, "\n".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 30))), "\n".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 5)))) for i in range(150)]
    for r in edits.nearest(spark.createDataFrame(rows, "id long, c string, o string"), "c", "o").collect():
        c, o = r["c"].splitlines(keepends=True), r["o"].splitlines(keepends=True)
        rates = [difflib.SequenceMatcher(None, o, c[i : i + len(o)]).ratio() for i in range(max(1, len(c) - len(o) + 1))]
        assert (r["ratio"], r["line"]) == (round(max(rates), 6), rates.index(max(rates)) + 1)
    near = edits.nearest(spark.createDataFrame([(1, "x\nLet A = 1\ny", "let a = 1"), (2, "x\nsay  'b'", "say ’b’"), (3, "q", "")], "id long, c string, o string"), "c", "o").orderBy("id").collect()
    assert [r["line"] for r in near] == [1, 1, 1] and all(r["hints"] == [] for r in near)


def test_a_walk_keeps_the_whole_path(spark, tmp_path):
    """The folder's name may come again below it, and may hold signs of a pattern."""
    root = tmp_path / "a.b+c" / "docs"
    for name in ("x.txt", "a/docs/b/x.txt", "node_modules/y.txt", "a/z.md"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("t")
    assert {r["path"] for r in files.walk(spark, str(root)).collect()} == {"x.txt", "a/docs/b/x.txt", "a/z.md"}
    assert {r["path"] for r in files.walk(spark, str(root), "a/**/*.txt").collect()} == {"a/docs/b/x.txt"}


def test_long_texts_are_searched_line_by_line_once(spark):
    """Quotes are made straight once a text and not once a line: 20,000 lines took minutes."""
    import time

    lines = [f"line {i} it's" for i in range(20_000)]
    rows = [("\n".join(lines), f"  {lines[i].replace(chr(39), '’')} \n{lines[i + 1]}") for i in (5, 19_998)]
    began = time.time()
    got = edits.located(spark.createDataFrame(rows, "c string, o string"), "c", "o").select("way", "matches", "line").collect()
    assert [tuple(r) for r in got] == [("lines_quotes", 1, 6), ("lines_quotes", 1, 19_999)] and time.time() - began < 20
