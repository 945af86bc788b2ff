"""Documents from spans: columns, sections over pages, captions, photos and formulas."""

from strandmill.operators.assembly import assembled, full_texts, reading_order

SCHEMA = "doc int, page int, block int, line int, span int, text string, font string, size double, left double, right double, top double, bottom double"


def words(page, block, text, left=50.0, right=250.0, top=0.0, size=9.0, line=0, span=0, font="Times", bottom=None):
    return (1, page, block, line, span, text, font, *map(float, (size, left, right, top, top + 10 if bottom is None else bottom)))


def image(page, block, left=50.0, right=250.0, top=100.0, bottom=200.0):
    return (1, page, block, None, None, None, None, None, *map(float, (left, right, top, bottom)))


def blocks(spark, rows):
    return {(r["page"], r["block"]): r for r in assembled(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}


def test_columns_are_read_one_after_the_other(spark):
    """A title over both, two columns whose blocks come mixed, a band over both, two columns again; a page of one column."""
    rows = [words(1, 0, "title", 50, 550, 0)]
    rows += [words(1, 1, "r1", 310, 550, 20), words(1, 2, "l1", 50, 290, 20), words(1, 3, "l2", 50, 290, 40), words(1, 4, "r2", 310, 550, 40)]
    rows += [words(1, 5, "wide", 50, 550, 60), words(1, 6, "r3", 310, 550, 80), words(1, 7, "l3", 50, 290, 80)]
    rows += [words(2, 0, "b", 50, 300, 90), words(2, 1, "a", 50, 300, 10)]
    got = sorted(blocks(spark, rows).values(), key=lambda r: (r["page"], r["place"]))
    assert [r["text"] for r in got] == ["title", "l1", "l2", "r1", "r2", "wide", "l3", "r3", "b", "a"]
    flat = spark.createDataFrame([(1, 1, i, float(i), 50.0, 90.0, 0.0) for i in range(3)], "doc int, page int, block int, top double, left double, right double, bottom double")
    assert [r["place"] for r in reading_order(flat).orderBy("block").collect()] == [1, 2, 3]


def test_sections_figures_and_formulas(spark):
    rows = [
        words(1, 0, "2.1 Related Work", size=14.0),
        words(1, 1, "small Heading Like", size=9.0),
        words(1, 2, "energy ", span=0, top=30),
        words(1, 2, "Σ", span=1, top=30, size=10, font="CMSY10"),
        words(1, 2, "i", span=2, top=33, size=7, font="CMMI7"),
        words(1, 2, "=", span=3, top=30, size=10, font="CMSY10"),
        words(1, 2, "α", span=4, top=30, size=10, font="CMMI10"),
        image(1, 3),
        words(1, 4, "Figure 3: a curve", top=230),
        image(1, 5, top=300, bottom=320),
        words(2, 0, "goes on"),
        image(2, 1),
        words(2, 2, "far below Fig. 9", top=400),
        words(9, 0, "She received the Ph.D. degree and is an associate professor"),
        image(9, 1),
        words(9, 2, "An IEEE Fellow"),
    ]
    got = blocks(spark, rows)
    assert {r["section"] for k, r in got.items()} == {"2.1 Related Work"} and got[1, 0]["kind"] == "heading" and got[1, 0]["level"] == 1
    assert got[1, 1]["kind"] == "text" and (1, 5) not in got
    assert got[1, 2]["formulas"] and got[1, 2]["formulas"][0].startswith("\\sum _i") and got[1, 2]["text"].startswith("energy")
    assert (got[1, 3]["kind"], got[1, 3]["figure"], got[1, 3]["text"]) == ("figure", 1, "Figure 3: a curve")
    assert (got[2, 1]["figure"], got[2, 1]["text"]) == (2, None) and got[9, 1]["kind"] == "photo" and got[9, 1]["figure"] is None
    full = full_texts(assembled(spark.createDataFrame(rows, SCHEMA))).first()
    assert "[Fig 1: Figure 3: a curve]" in full["text"] and "[Fig 2: see original Fig 2]" in full["text"] and "[Author Photo: author portrait]" in full["text"]
    assert (full["sections"], full["figures"], full["formulas"]) == (1, 2, 1)
    assert assembled(spark.createDataFrame([], SCHEMA)).count() == 0
