"""Queries on tables with rows that the shared ones lack."""

import difflib
import re

from strandmill.plans import QUERIES


def benchmark(spark, path, texts):
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_likeness_is_of_whole_texts(spark, tmp_path):
    head = "one beginning of three hundred characters " * 8
    texts = [head + "and an end " * 30, head + "0123456789 " * 30, head[:300]]
    benchmark(spark, tmp_path, texts)
    got = {(r["a"], r["b"]): r["value"] for r in QUERIES["j9_similarity_matrix"](spark, str(tmp_path)).collect()}
    want = {(a, b): difflib.SequenceMatcher(None, texts[min(a, b)], texts[max(a, b)]).ratio() if a != b else 1.0 for a in range(3) for b in range(3)}
    assert got == want and max(v for (a, b), v in got.items() if a != b) < 1


def test_the_whole_formula_is_judged(spark, tmp_path):
    benchmark(spark, tmp_path, [", " * 20 + "x = 1", ", " * 20, "(" * 40 + r"\frac{a}{b}"])
    got = {r["item_id"]: r["ok"] for r in QUERIES["c14_substantial"](spark, str(tmp_path)).collect()}
    assert got == {0: True, 1: False, 2: True}


def test_every_section_of_a_text_with_blank_lines(spark, tmp_path):
    texts = ["Head\nbody of one\n\n\nNext\nbody\nof two\n\nAlone", "one\ntwo", None, "", "\n\n \n\n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r[c] for c in ("doc_id", "section_no", "head", "body_chars")) for r in QUERIES["i2_sections"](spark, str(tmp_path)).collect())
    want = []
    for d, text in enumerate(texts):
        parts = [p.strip() for p in re.split(r"\n{2,}", text or "") if p.strip()]
        for n, p in enumerate(parts, 1):
            first, _, rest = p.partition("\n")
            want.append((d, n, first[:40], len(rest.strip() or p)))
        if not parts:
            want.append((d, 1, "全文", 0))
    assert got == want


def test_events_find_every_document(spark, tmp_path):
    spark.createDataFrame([(1, "odd text", "en"), (2, "even text of more than twenty characters", "de"), (4, None, None)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(10, 1), (11, 2), (12, 3), (13, 4), (14, None)], "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["event_id"]: (r["title"], r["language"]) for r in QUERIES["j5_events_all_papers"](spark, str(tmp_path)).collect()}
    assert got == {10: ("odd text", "en"), 11: ("even text of more th", "de"), 12: ("3", "?"), 13: ("4", "?"), 14: (None, "?")}
