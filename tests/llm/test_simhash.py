import random

import numpy as np
from pyspark.sql import functions as F
import xxhash
from strandmill.llm import simhash as S
from strandmill.llm.components import components


def plain(text):
    words = (text or "").encode().lower().split()
    sh = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    out = 0
    for bit in range(64):
        if sum(xxhash.xxh64_intdigest(s, 42) >> bit & 1 for s in sh) * 2 > len(sh):
            out |= 1 << bit
    return out


def brute(rows):
    fps = [(d, plain(t)) for d, t in rows]
    root = {f: f for _, f in fps}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    keys = sorted(root)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if bin(a ^ b).count("1") <= 3:
                root[top(a)] = top(b)
    least = {}
    for d, f in fps:
        if d is not None:
            least[top(f)] = min(least.get(top(f), d), d)
    return sorted([(d, f, least.get(top(f))) for d, f in fps], key=repr)


def test_equals_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(200)]
        for k in range(8):
            t = list(base)
            for _ in range(k):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((g * 100 + k, " ".join(t)))
    rows += [(5000, None), (5001, ""), (5002, " \t\n"), (5003, "one"), (5004, "ONE"), (5005, "one two"), (None, "one"), (7, "one two three four"), (7, "one two three four"), (6000, "word " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("x", "y").repartition(6)
    got = sorted([(r["doc"], r["fp"] & (1 << 64) - 1, r["component"]) for r in S.near_duplicates(df).collect()], key=repr)
    assert got == brute(rows)


def test_empty_and_clashing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, fp string, component int")
    assert S.near_duplicates(df).count() == 0
    df = spark.createDataFrame([(1, "a", "z", 3)], "doc_id long, text string, fp string, component int")
    assert S.near_duplicates(df).first()["component"] == 1


def test_variants_find_all_pairs_within_three_bits(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = set(base.tolist())
    for b in base.tolist():
        for _ in range(10):
            fps.add(b ^ sum({1 << int(x) for x in rng.integers(0, 64, rng.integers(1, 6))}))
    fps = sorted(fps)
    want = {frozenset((a, b)) for i, a in enumerate(fps) for b in fps[:i] if bin(a ^ b).count("1") <= 3}
    root = {f: f for f in fps}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for p in want:
        a, b = p
        root[top(a)] = top(b)
    signed = [(int(np.uint64(f).view(np.int64)),) for f in fps]
    edges = S.link(spark.createDataFrame(signed, "fp long"))
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    groups = {}
    for f in fps:
        groups.setdefault(top(f), set()).add(got.get(int(np.uint64(f).view(np.int64)), f"alone{f}"))
    assert all(len(v) == 1 for v in groups.values())
    assert len({next(iter(v)) for v in groups.values()}) == len(groups)


def test_dense_and_flipped_give_the_same_components():
    rng = np.random.default_rng(2)
    run = np.unique((rng.integers(0, 1 << 14, 400).astype(np.uint64) << np.uint64(7)) | np.uint64(1))

    def comps(edges):
        label = list(range(len(run)))
        for a, b in edges:
            x, y = label[a], label[b]
            label = [x if v == y else v for v in label]
        first = {}
        return [first.setdefault(v, i) for i, v in enumerate(label)]

    assert comps(S._dense(run, 2)) == comps(S._flipped(run, 2))


def test_components_of_a_long_path(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (None, 5), (7, 7)], "u long, v long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}


def test_majority_counts_bits():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 4, 7, 64, 1000):
        rows = rng.integers(0, 1 << 63, (n, 3), dtype=np.uint64)
        bits = np.unpackbits(rows.view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
        want = np.packbits(bits.sum(0, dtype=int) * 2 > n, bitorder="little").view(np.uint64)
        assert (S.majority(rows.copy()) == want).all()


def test_near_copies_by_similarity(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(2000)]
    rows, groups = [], []
    for g in range(40):
        base = [rng.choice(words) for _ in range(rng.randrange(120, 400))]
        ids = []
        for k in range(4):
            t = list(base)
            for _ in range(len(t) // 60 if k else 0):  # a likeness of about 0.85 to the first
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((g * 10 + k, " ".join(t)))
            ids.append(g * 10 + k)
        groups.append(ids)
    clean = [(5000 + i, " ".join(rng.choice(words) for _ in range(200))) for i in range(300)]
    odd = [(9000, None), (9001, ""), (9002, "one two"), (9003, "ONE two"), (None, "one two")]
    df = spark.createDataFrame(rows + clean + odd, "doc_id long, text string").repartition(5)
    got = {r["node"]: r["component"] for r in S.near_copies(df).collect()}
    assert not {i for i, _ in clean} & set(got)
    assert (got[9001], got[9003]) == (9000, 9002)
    assert sum(got.get(i) == g[0] for g in groups for i in g) >= 0.97 * 160
    assert S.near_copies(df.limit(0)).count() == 0


def overlapping(rng, common, own):
    """Two texts with ``common`` shared five-word shingles and ``own`` more each."""
    fresh = lambda n: [f"x{rng.randrange(1 << 40)}" for _ in range(n)]
    base = fresh(common + 4)
    return " ".join(base + fresh(own)), " ".join(base + fresh(own))


def test_likeness_is_checked_on_the_shingles(spark):
    """80 of 100 and 81 of 101 link; below that none does, however alike the sketches are."""
    rng = random.Random(4)
    rows, found, below = [], [], []
    for i in range(300):
        common, own = [(80, 10), (160, 20), (78, 11), (70, 15), (74, 13)][i % 5]
        a, b = overlapping(rng, common, own)
        rows += [(2 * i, a), (2 * i + 1, b)]
        (found if common >= 0.8 * (common + 2 * own) else below).append(2 * i + 1)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["node"]: r["component"] for r in S.near_copies(df).collect()}
    assert all(got.get(i) == i - 1 for i in found)
    assert not set(below) & set(got)


def test_short_texts_link_by_their_shingles(spark):
    """8 against 9 words share 4 of 5 shingles, 10 against 11 six of seven, 7 against 8 three of four."""
    rng = random.Random(5)
    rows, want = [], {}
    for i in range(150):
        n = (8, 10, 7)[i % 3]
        words = [f"x{rng.randrange(1 << 40)}" for _ in range(n + 1)]
        rows += [(2 * i, " ".join(words[:n])), (2 * i + 1, " ".join(words))]
        if n >= 8:
            want |= {2 * i: 2 * i, 2 * i + 1: 2 * i}
    got = {r["node"]: r["component"] for r in S.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_spanning_edges_of_sets_equal_brute_force():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate((rng.choice(base, rng.integers(40, 58), replace=False), rng.integers(0, 1 << 63, 2, dtype=np.uint64)))) for _ in range(60)]
    label = list(range(60))
    want = list(range(60))
    for a, b in S.alike(sets, 0.8):
        label = [label[a] if x == label[b] else x for x in label]
    for a in range(60):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if both * 10 >= 8 * (len(sets[a]) + len(sets[b]) - both):
                want = [want[a] if x == want[b] else x for x in want]
    first, other = {}, {}
    assert [first.setdefault(x, i) for i, x in enumerate(label)] == [other.setdefault(x, i) for i, x in enumerate(want)]


def grouped(edges):
    out = {}
    for r in components(edges).collect():
        out.setdefault(r["component"], set()).add(r["node"])
    return sorted(map(sorted, out.values()))


def test_long_runs_are_cut_without_loss(spark):
    """A third of all fingerprints share a segment; with runs cut at 50 rows the components stay as by brute force."""
    rng = np.random.default_rng(11)
    low = np.uint64(0x12345678)
    hot = np.unique((rng.integers(0, 1 << 11, 500).astype(np.uint64) << np.uint64(40)) | low)
    fps = np.unique(np.concatenate((hot, rng.integers(0, 1 << 63, 900, dtype=np.uint64))))
    df = spark.createDataFrame([(int(x.view(np.int64)),) for x in fps], "fp long").repartition(7)
    want = grouped(spark.createDataFrame([(int(fps[a].view(np.int64)), int(fps[b].view(np.int64))) for a, b in S._dense(fps, 3)], "u long, v long"))
    assert grouped(S.link(df, 3, hot=50)) == want == grouped(S.link(df, 3))
    named = df.withColumn("node", F.col("fp") * 0 + F.monotonically_increasing_id())
    assert [len(g) for g in grouped(S.link(named, 3, hot=50))] and sorted(map(len, grouped(S.link(named, 3, hot=50)))) == sorted(map(len, want))


def variety(rng, n):
    """Texts of one stock of words: near copies of a base, of each other, and half copies that are not alike enough."""
    base = [f"w{i}" for i in range(120)]
    out = []
    for i in range(n):
        t = list(base)
        for _ in range((0, 1, 2, 3, 9)[i % 5]):
            t[rng.randrange(len(t))] = f"x{rng.randrange(1 << 30)}"
        out.append((i, " ".join(t)))
    return out


def test_crowded_runs_and_measures_equal_brute_force(spark):
    rows = variety(random.Random(12), 150)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sets = [S.shingles(t.encode()) for _, t in rows]
    prints = [S.fingerprint(t.encode()) for _, t in rows]
    for measure in ("jaccard", "cosine"):
        edges = []
        for a in range(len(rows)):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                bar = 0.8 * (len(sets[a]) + len(sets[b]) - both) if measure == "jaccard" else 0.8 * (len(sets[a]) * len(sets[b])) ** 0.5
                if both >= bar - 1e-9 or bin(prints[a] ^ prints[b]).count("1") <= 3:
                    edges.append((a, b))
        want = grouped(spark.createDataFrame(edges, "u long, v long"))
        for kw in ({}, {"crowd": 12}, {"crowd": 12, "most_sent": 0}):
            out = {}
            for r in S.near_copies(df, measure=measure, **kw).collect():
                out.setdefault(r["component"], set()).add(r["node"])
            assert sorted(map(sorted, out.values())) == want, (measure, kw)


def test_near_copies_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 1, "x"), (2, "a b c d e f", 2, "y")], "doc_id long, text string, id int, fp string").withColumn("run", F.lit(1))
    assert {tuple(r) for r in S.near_copies(df).collect()} == {(1, 1), (2, 1)}


def test_components_of_hubs(spark):
    """Two hubs with most edges each, above the bound from which a hub is met by a broadcast."""
    edges = [(0, i) for i in range(1, 1500)] + [(5000, i) for i in range(5001, 6500)] + [(1499, 6400)]
    got = {r["component"] for r in components(spark.createDataFrame(edges, "u long, v long").repartition(6)).collect()}
    assert got == {0}
