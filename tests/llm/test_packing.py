import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from strandmill.llm.packing import assign, coder, pack, pieces, plan, word_tokenizer


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=30))
def test_plan_places_every_piece_once(counts):
    room = {}
    for length, rank, n, first, each, offset in plan(counts, 64):
        for j in range(n):
            seq, at = first + j // each, offset + j % each * length
            room.setdefault(seq, []).append((at, length))
    placed = {}
    for parts in room.values():
        end = 0
        for at, length in sorted(parts):
            assert at == end
            end += length
            placed[length] = placed.get(length, 0) + 1
        assert end <= 64
    assert placed == counts
    total = sum(k * v for k, v in counts.items())
    assert len(room) <= max(1, 2 * -(-total // 64))


ODD = ["İstanbul ΟΔΟΣ Σ. straße", "KELVIN K Ω <|endoftext|>x it's DON'T a1b2 12,3 　x", "", "   ", "\x1cab\x1d c", "naïve, rÉSUMÉ! ﬁ ǅ ẞ é", "é̂ ̂x", "a" * 5000]


def test_ids_equal_the_tokenizer(spark):
    code = coder(word_tokenizer())
    docs = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for t in ODD + docs:
        want = np.array(code.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        assert code.encode(t) == want and code.encode(t) == want, t[:50]


def test_pack(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["a", "cat", "unbelievable", "1"]) for _ in range(rng.randrange(0, 400)))) for i in range(200)] + [(900, None), (901, ""), (902, "word " * 9000), (None, "x"), (3, "again"), (3, "again")]
    out = pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), ids=True).toPandas()
    assert len(out[out.doc_id == 902]) == 5 and out.groupby("sequence_id").length.sum().max() <= 2048
    s = out.sort_values(["sequence_id", "offset"])
    assert ((s.groupby("sequence_id").length.cumsum() - s.length) == s.offset).all()
    assert (out.ids.map(zlib.crc32) == out.ids_crc32).all() and (out.ids.map(len) == 4 * out.length).all()
    assert out.sequence_id.nunique() == -(-out.length.sum() // 2048)
    assert len(out[out.doc_id.isna()]) == 1 and len(out[out.doc_id == 3]) == 3


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", 5, 6)], "doc_id long, text string, length int, sequence_id int")
    assert pack(df).first()["length"] == 3 and pack(df.limit(0)).count() == 0


def test_common_lengths_are_ranked_by_several_tasks(spark):
    """With eight pieces to a task the places are still gapless and the sequences as few."""
    rows = [(i, "cat " * (3 if i % 3 else 2500)) for i in range(300)] + [(None, "cat")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    parts = pieces(df)
    out, whole = (assign(parts, ranked=k).toPandas() for k in (8, 10**6))
    for x in (out, whole):
        s = x.sort_values(["sequence_id", "offset"])
        assert ((s.groupby("sequence_id").length.cumsum() - s.length) == s.offset).all() and s.groupby("sequence_id").length.sum().max() <= 2048
    assert out.sequence_id.nunique() == whole.sequence_id.nunique() and len(out) == len(whole) == 300 + 40 + 100
