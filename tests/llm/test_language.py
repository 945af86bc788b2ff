from strandmill.llm.language import UND, has_letter, identify


def rows():
    en, de = "the cat sat on the mat and looked at the other cats there ", "der hund und die katze sind nicht auf dem tisch gewesen "
    out = [(i, (en if i % 2 else de) * (1 + i % 3), "en" if i % 2 else "de") for i in range(60)]
    return out + [(100, None, "en"), (101, "", "de"), (102, "123 !!", None), (103, "the cats and the mat", None), (None, "die katze und der hund", "de"), (104, "der tisch " * 200_000, None)]


def test_predictions(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string").repartition(4)
    got = {r["doc_id"]: r for r in identify(df).collect()}
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "de") for i in range(60))
    assert [got[i]["lang_pred"] for i in (100, 101, 102)] == [UND] * 3 and got[102]["score"] == 0
    assert got[103]["lang_pred"] == "en" and got[104]["lang_pred"] == "de" and got[None]["lang_pred"] == "de"
    assert not got[None]["held_out"] and all(0 <= r["score"] <= 1 for r in got.values())
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items() if d is not None)


def test_prediction_does_not_use_labels(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string")
    wrong = spark.createDataFrame([(r[0], r[1], r[2] if r[0] is None or __import__("zlib").crc32(str(r[0]).encode()) % 3 != 1 else "xx") for r in rows()], df.schema)
    key = lambda x: sorted(((r["doc_id"], r["lang_pred"], r["score"]) for r in x.collect()), key=repr)
    assert key(identify(df)) == key(identify(wrong))


def test_nothing_to_learn_from_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "abc", None, "x")], "doc_id long, text string, lang string, lang_pred string")
    r = identify(df).first()
    assert (r["lang_pred"], r["score"]) == (UND, 0.0)
    assert identify(df.limit(0)).count() == 0


def test_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identify(df).filter("held_out").selectExpr("avg(cast(lang = lang_pred as int)) AS a").first()["a"]
    assert got > 0.97


def test_letters():
    assert has_letter("1é") and not has_letter("12 ,") and not has_letter(None)


def test_scores_equal_a_plain_naive_bayes(spark):
    """Counts in dictionaries, logarithms summed gram by gram, over the same buckets."""
    import math
    import zlib
    from collections import Counter

    import numpy as np
    from strandmill.llm.language import BITS, EVIDENCE, ORDERS, buckets

    data = [(i, t[:300] if t else t, lang) for i, t, lang in rows() if i is not None]
    grams = lambda t: [int(b) for n in ORDERS for b in buckets(np.array([ord(c) for c in f" {t.lower()} "], np.uint32), n)]
    counts = {"de": Counter(), "en": Counter()}
    for i, t, lang in data:
        if lang and t and zlib.crc32(str(i).encode()) % 3 != 1:
            counts[lang].update(grams(t))
    logs = {k: {b: math.log((c[b] + 0.5) / (sum(c.values()) + 0.5 * (1 << BITS))) for b in range(1 << BITS)} for k, c in counts.items()}
    got = {r["doc_id"]: r for r in identify(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()}
    for i, t, _ in data:
        if t and has_letter(t):
            g = grams(t)
            mean = {k: sum(v[b] for b in g) / len(g) * min(EVIDENCE, len(t) + 1) for k, v in logs.items()}
            best = max(sorted(mean), key=mean.get)
            odds = 1 / sum(math.exp(x - mean[best]) for x in mean.values())
            assert got[i]["lang_pred"] == best and abs(got[i]["score"] - odds) < 1e-3, (i, got[i], best, odds)


def test_ties_and_repeated_rows(spark):
    """Languages learned from the same texts tie: the first by name is predicted, with an even score."""
    data = [(i, "the same words in either", "bb" if i % 2 else "aa") for i in range(40)] + [(500, "words", None), (500, "words", None)]
    data = [d for d in data if d[0] == 500] + [(i, t, k) for k in ("aa", "bb") for i, t, _ in data[:40]]
    got = [r for r in identify(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect() if r["doc_id"] == 500]
    assert [(r["lang_pred"], round(r["score"], 6)) for r in got] == [("aa", 0.5)] * 2
