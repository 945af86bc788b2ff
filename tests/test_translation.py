"""Fragments, chunks, braces and formulas with their surroundings, against texts of known structure and plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from strandmill.functions import fragments, latex
from strandmill.functions.fragments import build_chunks, merge_fragments

JOIN = ["", " ", " = ", " a b ", " in R^n ", ", ", " x" * 17, " the of "]
APART = [" is good. ", "; ", " 其中 ", " " + "word " * 5, "y" * 36, " one two three by it ", "! "]


def test_neighbours_are_joined_as_their_gaps_say():
    rng = random.Random(1)
    for _ in range(400):
        inner = lambda: rng.choice(("a", "b_{1}", " c  d ", r"\alpha", r"x\$y", "k+1"))
        text, want, chain = "see ", "see ", [inner()]
        text += f"${chain[0]}$"

        def closed(c):
            return f"${' '.join(' '.join(c).split())}$" if len(c) > 1 else f"${c[0]}$"

        for _ in range(rng.randrange(6)):
            gap, x = rng.choice(JOIN + APART), inner()
            text += f"{gap}${x}$"
            if gap in JOIN and gap:
                chain += [gap.strip(), x]
            elif gap in APART:
                want += closed(chain) + gap
                chain = [x]
            else:  # two dollars in a row begin a display: no neighbours
                text, chain = text[: -len(f"${x}$")], chain
        assert fragments._chained(text) == want + closed(chain), text
        assert fragments._chained(fragments._chained(text)) == fragments._chained(text)


def test_three_passes():
    assert merge_fragments(None) is None and merge_fragments("no marks") == "no marks"
    assert merge_fragments("so $a$ = $b$ holds") == "so $a = b$ holds"
    assert merge_fragments(r"as $\frac{a}{b}$ says.") == "as \n\n$$\\frac{a}{b}$$\n\n says."
    assert merge_fragments("as $E$ (12a) says.") == "as \n\n$$E$$\n\n (12a) says."
    assert merge_fragments("as $" + "x=" * 26 + "$ says.").count("$$") == 2
    assert merge_fragments("$x_ab^cd$ and $$y_q # 5%$$ \\$3 left") == "$x_{ab}^{cd}$ and $$y_{q} \\# 5\\%$$ \\$3 left"
    assert merge_fragments("$a\x00_b~c$") == "$a_{b}\\textasciitilde{}c$"
    assert merge_fragments("one $ alone and $$ two") == "one $ alone and $$ two"


def test_a_long_text_is_read_in_its_length():
    text = "$a$ + $b$. Then " * 20_000 + "$" + "x" * 300_000
    assert merge_fragments(text).startswith("$a + b$. Then $a + b$.")


def test_chunks_hold_whole_paragraphs_and_formulas():
    rng = random.Random(2)
    for _ in range(300):
        parts = ["x" * rng.randrange(1, 60) + rng.choice((".", "", "? ", "，")) for _ in range(rng.randrange(0, 12))]
        got = build_chunks(parts, 40)
        assert [p for c in got for p in c.split("\n\n")] == parts
        # A chunk is over the size only by one paragraph, or by one that came from the chunk before.
        assert all(sum(map(len, c.split("\n\n")[:-1])) <= 60 for c in got)
    assert build_chunks(["a" * 30, "b" * 8, "c" * 30], 40) == ["a" * 30, "b" * 8 + "\n\n" + "c" * 30]
    assert build_chunks(["a" * 30, "b" * 7 + ".", "c" * 30], 40) == ["a" * 30 + "\n\n" + "b" * 7 + ".", "c" * 30]
    assert build_chunks(["a $$ b" + "x" * 30, "y" * 30, "z $$" + "w" * 30], 40) == ["a $$ b" + "x" * 30 + "\n\n" + "y" * 30, "z $$" + "w" * 30]
    assert build_chunks(["a $ b" + "x" * 34, "y$" + "y" * 30, "z"], 40)[0].count("$") == 2
    assert build_chunks([], 40) == [] and build_chunks(None, 40) is None


def test_a_paragraph_of_over_twice_the_size_is_cut_outside_of_formulas():
    p = "a" * 38 + "$xyz$" + "b" * 60
    got = build_chunks(["first", p], 40)
    assert got == ["first", "a" * 38 + "$xyz$", "z$" + "b" * 38 + "\n\n" + "b" * 22] or got[:2] == ["first", "a" * 38 + "$xyz$"]
    assert build_chunks(["q" * 100], 40) == ["q" * 40, "q" * 40, "q" * 20]


def plain_balance(t):
    escaped = lambda j: (len(t[:j]) - len(t[:j].rstrip("\\"))) % 2 == 1
    net = sum((c == "{") - (c == "}") for j, c in enumerate(t) if c in "{}" and not escaped(j))
    if net >= 0:
        return t + "}" * net
    loose = [j for j, c in enumerate(t) if c == "}" and not (t[j - 1 : j] == "\\" and t[j - 2 : j - 1] != "\\")]
    gone = set(loose[net:])
    return "".join(c for j, c in enumerate(t) if j not in gone)


def test_braces_equal_a_walk_over_the_characters(spark):
    rng = random.Random(3)
    rows = ["".join(rng.choice(("{", "}", "}", "\\", "a", "é")) for _ in range(rng.randrange(14))) for _ in range(1500)] + ["", None, "}" * 5, "{" * 5, "\\{" * 3, "\\\\{", "\\\\\\}"]
    got = spark.createDataFrame([(r,) for r in rows], "t string").select("t", latex.balance_braces(F.col("t")).alias("b")).collect()
    for r in got:
        assert r["b"] == (None if r["t"] is None else plain_balance(r["t"])), r["t"]


def test_the_last_dollar_that_stands_alone_is_escaped(spark):
    rng = random.Random(4)
    rows = ["".join(rng.choice(("$", "$", "a", "\n", "$$", "\\")) for _ in range(rng.randrange(10))) for _ in range(800)]
    for r in spark.createDataFrame([(r,) for r in rows], "t string").select("t", latex.escape_unmatched_dollars(F.col("t")).alias("e")).collect():
        t = r["t"]
        alone = [m.start() for m in re.finditer(r"(?<!\$)\$(?!\$)", t)]
        odd = t.replace("$$", "").count("$") % 2
        assert r["e"] == (t[: alone[-1]] + "\\" + t[alone[-1] :] if odd and alone else t), t


def test_cards(spark):
    html = '<div class="fexpr"> \\frac{a}{b & c </div> x { <div class="fmean">so $\\sqrt{a$ and 5$ more}</div><div class="fexpr">\\begin{cases} a & b \\end{cases}}</div>'
    got = spark.createDataFrame([(html,)], "h string").select(latex.balance_expressions(latex.balance_meanings(F.col("h"))).alias("h")).first()["h"]
    assert got == '<div class="fexpr">\\frac{a}{b \\& c}</div> x { <div class="fmean">so $\\sqrt{a}$ and 5\\$ more}</div><div class="fexpr">\\begin{cases} a & b \\end{cases}</div>'


@pytest.mark.parametrize("pattern", [r"\$\$[\s\S]+?\$\$", r"a+"])
def test_places_are_those_of_the_matches(spark, pattern):
    rng = random.Random(5)
    rows = ["".join(rng.choice(("$$", "a", "é🎉", " ", "b")) for _ in range(rng.choice((0, 5, 400)))) for _ in range(60)]
    for r in spark.createDataFrame([(r,) for r in rows], "t string").select("t", latex.placed(F.col("t"), pattern).alias("p")).collect():
        assert [(p["start"], p["end"], p["hit"]) for p in r["p"]] == [(m.start(), m.end(), m[0]) for m in re.finditer(pattern, r["t"])]


def test_formulas_with_numbers_and_context(spark):
    text = "We set $$E = mc^2 \\tag{3a}$$ for all. Then $\\alpha$ t = $\\frac{a_1}{b$ (5) follows.\nIt is \\[x_1 + y_2 \\leq z\\] (6). But $the method of$ and $ab$ and $$其中 a = b$$ are none, $w_1 = w_2$ is."
    got = latex.formulas(spark.createDataFrame([(1, text), (2, None)], "id long, t string"), F.col("t"), ["id"]).orderBy("start").collect()
    found = {r["latex"]: (r["number"], r["display"]) for r in got}
    assert found["E = mc^2"] == ("3a", True) and found["x_1 + y_2 \\leq z"] == ("6", True) and found["w_1 = w_2"] == (None, False)
    assert any("\\frac{a_1}{b}" in k and v == ("5", True) for k, v in found.items()) and len(found) == 4
    context = next(r["context"] for r in got if r["latex"] == "E = mc^2")
    assert context.startswith("We set for all.") and len(context) <= 111


def test_a_dollar_before_long_prose_is_read_once(spark):
    from strandmill.functions import formula

    text = "costs 5$ and " + "some word " * 5000 + "\nend"
    assert spark.createDataFrame([(text,)], "t string").select(formula.promote_display(F.col("t")).alias("t")).first()["t"] == text
