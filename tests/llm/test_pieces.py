from array import array

import numpy as np
import sentencepiece
from strandmill.llm import pieces
from strandmill.llm.pieces import cut_up, decode, encode, model, piece_model, product, states

ODD = ["a", "  hello   world\n\tü  x", " ", "   ", "日本語 🎉 x", "\n\n a", "x" * 300, " a b", "aa  bb" * 50, "\x01 \x02"]


def docs(spark):
    return [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]


def as_unigram(raw: bytes) -> bytes:
    """The same model file with its type changed to unigram."""
    out, i = bytearray(raw), 0

    def number(i):
        n = shift = 0
        while True:
            b = raw[i]
            i += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n, i

    while i < len(raw):
        tag, i = number(i)
        size, i = number(i)
        j = i
        while tag >> 3 == 2 and j < i + size:
            t, at = number(j)
            if t & 7 == 0:
                _, j = number(at)
                if t >> 3 == 3:
                    out[at] = 1
            elif t & 7 == 2:
                n, j = number(at)
                j += n
            else:
                j = at + (8 if t & 7 == 1 else 4)
        i += size
    return bytes(out)


def test_ids_equal_the_library(spark):
    m = model(piece_model())
    for t in ODD + docs(spark):
        assert list(array("I", m.encode(m.normal(t))[0])) == m.sp.encode(t), t[:40]


def test_best_path_equals_the_library_on_the_same_scores(spark):
    m = model(piece_model())
    u = sentencepiece.SentencePieceProcessor(model_proto=as_unigram(m.sp.serialized_model_proto()))
    words = {w for t in docs(spark)[:60] for w in t.split()}
    score = lambda ids: sum(m.sp.get_score(i) for i in ids)
    for w in words:
        assert score(array("I", m.encode(m.normal(w))[1])) == score(u.NBestEncodeAsIds(w, 2)[0])


def test_chunks_equal_the_whole(spark):
    m = model(piece_model())
    for t in docs(spark)[:15] + ODD:
        s = m.normal(t)
        for size in (1, 3, 37):
            starts = list(range(0, len(s), size))
            own = [min(size, len(s) - a) for a in starts]
            st = states([m.transfer(s[a : a + n + m.reach - 1], n, a + n >= len(s)) for a, n in zip(starts, own)]) if starts else [0]
            total = sum(m.best(s[a : a + n + m.reach - 1], st[k], n + st[k + 1])[1] for k, (a, n) in enumerate(zip(starts, own)) if st[k] < n + st[k + 1])
            assert total == m.best(s)[1]
            if size > 3:
                assert np.isclose(total, m.encode(s)[2])


def test_giant_documents_and_round_trip(spark):
    texts = docs(spark)[:20] + ODD + [None, "", "word " * 5000, "nospace" * 3000]
    df = spark.createDataFrame([(i % 40, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3)
    m = model(piece_model())
    small = {(r["doc_id"], r["text"]): r for r in decode(encode(df)).collect()}
    large = {(r["doc_id"], r["text"]): r for r in decode(encode(df, chunk=64, fan=2)).collect()}
    assert set(small) == set(large) == {(i % 40, t or "") for i, t in enumerate(texts)}
    for k, r in small.items():
        assert r["ids"] == large[k]["ids"] and r["n_ids"] * 4 == len(r["ids"])
        assert abs(r["best_score"] - large[k]["best_score"]) <= 1e-6 * abs(r["best_score"])
        assert list(array("I", r["ids"])) == m.sp.encode(k[1])
    assert encode(df.limit(0)).count() == 0


def test_parts_of_the_normal_string(spark):
    m = model(piece_model())
    for t in docs(spark)[:15] + ODD + ["ab cd " * 40, "é a b. c d  e f\n g h"]:
        for size in (1, 5, 64):
            assert "".join(m.normal_parts(t, size)) == m.normal(t)
            s, own, skips = m.normal(t), [], []
            for part, n, skip, until, last in cut_up(m, t, size):
                at = sum(own)
                assert s[at : at + len(part)] == part and last == (at + n == len(s)) and skip <= until
                skips.append(part[skip:until])
                own.append(n)
            assert sum(own) == len(s) and "".join(skips) == s


def test_matrices_by_cuts_equal_plain_ones_and_combine_in_any_order(spark):
    m = model(piece_model())
    for t in docs(spark)[:6] + ODD:
        s = m.normal(t)[:700]
        for size in (1, 7, 90):
            plain, cuts = [], []
            for a in range(0, len(s), size):
                n = min(size, len(s) - a)
                part, last = s[a : a + n + m.reach - 1], a + n >= len(s)
                plain.append(m.plain_transfer(part, n, last))
                short = m.transfer(part, n, last)  # knows also that no piece enters across a cut
                assert np.array_equal(short[np.isfinite(short)], plain[-1][np.isfinite(short)])
                cuts.append(short)
            if plain:
                left = plain[0]
                for x in plain[1:]:
                    left = product([left, x])
                assert np.array_equal(left, product(plain)) and left[0, 0] == product(cuts)[0, 0] == m.best(s)[1]


def test_long_texts_go_by_their_matrices(spark, monkeypatch):
    """Of a text above one chunk neither the whole path is searched nor is anything found without matrices."""
    df = spark.createDataFrame([(1, "some words and more of them " * 3000)], "doc_id long, text string")
    whole = encode(df, chunk=1 << 20).first()
    seen = []
    real = pieces.boundaries
    monkeypatch.setattr(pieces, "boundaries", lambda matrices, chunks, fan: seen.append((matrices.count(), chunks)) or real(matrices, chunks, fan))
    assert encode(df, chunk=1 << 20).first() == whole and not seen
    cut = encode(df).first()
    assert seen == [(3, 3)] and (cut["ids"], cut["best_score"], cut["n_best"]) == (whole["ids"], whole["best_score"], whole["n_best"])


def test_chunks_of_a_text_without_cuts_are_linear():
    """One letter, two letters and runs between words: the units are the same as those of the whole text, and what is written is about twice the text."""
    m = model(piece_model())
    for text, most in (("a" * 300_000, 2.1), ("ab" * 150_000, 2.1), ("=" * 10_000_000, 2.1), ("word " * 20_000 + "a" * 100_000 + " word" * 20_000, 1.6)):
        s = m.normal(text)
        size = 1 << 15
        chunks = list(cut_up(m, text, size))
        assert "".join(c[:own] for c, own, *_ in chunks) == s
        assert "".join(c[skip:until] for c, _, skip, until, _ in chunks) == s
        assert [last for *_, last in chunks] == [False] * (len(chunks) - 1) + [True]
        assert sum(len(c) for c, *_ in chunks) <= most * len(s)


def test_new_units_of_several_texts_are_learned_at_once():
    from strandmill.llm import pieces

    m, asked = pieces.Pieces(pieces.piece_model()), []
    learn = m.learn
    m.learn = lambda units: asked.append(units) or learn(units)
    strings = [m.normal(t) for t in ("one word twice twice", "", "a word of one ☃", "zqxjv 12.5")]
    got = m.encode_all(strings)
    assert len(asked) == 1 and len(asked[0]) == len(set(asked[0]))
    for s, (ids, best, score) in zip(strings, got):
        want = [m.best(u) for u in m.units(s)]
        assert abs(score - sum(w[1] for w in want)) < 1e-9 and (ids, best, score) == m.encode(s)
        assert list(memoryview(best).cast("I")) == [i for w in want for p in w[0] for i in m.ids(p)]
