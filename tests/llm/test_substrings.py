import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from strandmill.llm import substrings
from strandmill.llm.substrings import Memo, dedup_substrings, repeated_spans, rolled, runs


def brute(texts, width):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - width + 1) if seen[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        out.append((len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return out


def texts(rng, width):
    word = lambda n: f"w{rng.randrange(n)}"
    passages = [[word(5000) for _ in range(rng.randrange(width - 3, 4 * width))] for _ in range(12)]
    out = []
    for _ in range(120):
        t = [word(5000) for _ in range(rng.randrange(0, 3 * width))]
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(passages)
            a = rng.randrange(0, max(1, len(p) - width))
            t += p[a:] if rng.random() < 0.5 else p
            t += [word(5000) for _ in range(rng.randrange(0, 30))]
        out.append(rng.choice((" ", "\n", "\t \x0b")).join(t))
    periodic = ["a " * (width + 9), "a b c " * width, "a b c " * width + "x", " ".join(["q"] * width), "z " * (width - 1)]
    few = [" ".join(word(2) for _ in range(rng.randrange(0, 5 * width))) for _ in range(20)]
    return [*out, *out[:7], *periodic, *few, None, "", " \n ", "café x " * 3]


def test_equals_counting_all_windows(spark):
    for width, seed in ((35, 1), (20, 2), (5, 3), (1, 4)):
        rows = texts(random.Random(seed), width)
        df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5)
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in dedup_substrings(df, width=width).collect()}
        want = brute(rows, width)
        assert got == dict(enumerate(want)), width
        assert any(0 < n < m for m, n, _ in want)


def test_spans_are_paths_with_their_sources(spark):
    rng = random.Random(5)
    mine = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    p = mine(400)
    rows = [(i, " ".join(mine(50) + p + mine(50))) for i in range(6)] + [(9, " ".join(p[100:200]))]
    spans = repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    covered = Counter()
    for s in spans:
        assert s["sources"] >= 2
        covered.update((s["k1"], s["start"] + i) for i in range(s["windows"]))
    assert set(covered.values()) == {1} and len(covered) == 6 * 366 + 66
    paths = [s for s in spans if s["path"] is not None]
    # Nonbranching stretches are one span each, not one for every run of windows.
    assert sum(s["windows"] for s in paths) / len(paths) > 60
    for same in {s["path"] for s in paths}:
        assert len({(s["windows"], s["sources"]) for s in paths if s["path"] == same}) == 1


def test_pieces_hold_each_window_once(monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK", 100)
    monkeypatch.setattr(substrings, "SEGMENT", 64)
    rng = random.Random(6)
    text = " ".join(f"w{rng.randrange(50)}" for _ in range(1234)).encode()
    memo = Memo()
    h = np.array([memo[w] for w in text.split()], np.uint64)
    parts = list(substrings._pieces(text, memo, 35))
    assert [at for at, _ in parts] == list(range(0, 1200, 100)) and all((h[at : at + len(x)] == x).all() for at, x in parts)
    found = sorted(at + f + i for at, x in parts for f, n in zip(*runs(x, np.array([len(x)]))[:2]) for i in range(n))
    assert found == list(range(1200))
    n, lost, kept = substrings.cut(text, [(10, 20), (15, 40), (1230, 1240)])
    assert (n, lost) == (1234, 34) and kept.split() == text.split()[:10] + text.split()[40:1230]


def test_rolled_hashes_follow_the_words():
    h = np.arange(100, dtype=np.uint64) % np.uint64(10)
    for k in (1, 2, 3, 7, 12, 35):
        r = rolled(h, k, substrings.EDGE_BASE)
        assert len(r) == 101 - k and len(set(r.tolist())) == min(10, len(r)) and (r[10:] == r[:-10]).all()


def test_repeated_rows_null_ids_clashes_and_empty_tables(spark):
    t = " ".join(f"x{i}" for i in range(40))
    rows = [(None, t, 1, "a"), (1, t + " y", 2, "b"), (1, t + " y", 2, "b"), (1, "other", 3, "c"), (2, None, 4, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int, k1 string")
    got = sorted((r["doc_id"] or 0, r["text"], r["n_words"], r["n_removed"], r["k1"]) for r in dedup_substrings(df).collect())
    assert got == [(0, "", 40, 40, "a"), (1, "", 41, 41, "b"), (1, "", 41, 41, "b"), (1, "other", 1, 0, "c"), (2, "", 0, 0, "d")]
    assert dedup_substrings(df.limit(0)).count() == 0 and dedup_substrings(df.limit(0)).columns == ["doc_id", "text", "k1", "n_words", "n_removed"] and F
