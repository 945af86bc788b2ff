import math

import numpy as np
from strandmill.llm.embeddings import near_duplicates


def brute(rows, least=0.98):
    use = []
    for i, label, v in rows:
        ok = i is not None and label is not None and v and None not in v and all(math.isfinite(x) for x in v) and any(v)
        use.append(np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None)
    n = len(rows)
    links = [[j for j in range(n) if j != i and use[i] is not None and use[j] is not None and rows[i][1] == rows[j][1] and len(use[i]) == len(use[j]) and use[i] @ use[j] >= least] for i in range(n)]
    comp = {}
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        comp[i] = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
    return sorted([(rows[i][0], len(links[i]), comp[i], rows[i][0] is None or rows[i][0] == comp[i]) for i in range(n)], key=repr)


def rows():
    rng = np.random.default_rng(3)
    out, n = [], 0
    for label in (0, 1):
        for _ in range(40):
            base = rng.normal(size=32)
            for k in range(int(rng.integers(1, 6))):
                v = base + rng.normal(size=32) * 0.07 * k
                out.append((n, label, v.tolist()))
                n += 1
    same = out[0][2]
    out += [(1000 + k, 0, same) for k in range(5)] + [(1100, 1, same), (1101, None, same), (1102, 0, [2 * x for x in same]), (1103, 0, [-0.0] * 32), (1104, 0, None), (1105, 0, []), (1106, 0, [float("nan")] * 32), (1107, 0, [float("inf")] * 32), (1108, 0, same[:31] + [None]), (None, 0, same), (1109, 0, same[:7]), (1110, 0, same[:7]), (1111, 0, [1e150] * 3), (1112, 0, [1e150] * 3)]
    return out


def run(spark, data, **kw):
    df = spark.createDataFrame(data, "vec_id long, label int, embedding array<double>").repartition(5)
    return sorted([tuple(r) for r in near_duplicates(df, **kw).collect()], key=repr)


def test_equals_brute_force(spark):
    assert run(spark, rows()) == brute(rows())


def test_split_buckets_give_the_same(spark):
    assert run(spark, rows(), hot=2) == brute(rows())


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<float>, rep int")
    assert near_duplicates(df).count() == 0
    df = spark.createDataFrame([(1, 0, [1.0, 2.0], 3), (2, 0, [1.0, 2.0], 3)], df.schema)
    assert sorted(tuple(r) for r in near_duplicates(df).collect()) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_recall_near_the_bound(spark):
    rng = np.random.default_rng(4)
    data = []
    for k in range(300):
        a = rng.normal(size=64)
        a /= np.linalg.norm(a)
        d = rng.normal(size=64)
        d -= (d @ a) * a
        d /= np.linalg.norm(d)
        c = 0.9801
        data += [(2 * k, 0, a.tolist()), (2 * k + 1, 0, (c * a + math.sqrt(1 - c * c) * d).tolist())]
    found = sum(r[1] for r in run(spark, data)) / 2
    assert found >= 0.9 * 300


def test_repeated_ids(spark):
    """One id with two vectors, with equal ones, and with one that links with nothing: every row has the links of its own vector."""
    rng = np.random.default_rng(9)
    a, b, c = (rng.normal(size=16).tolist() for _ in range(3))
    near = lambda x: [y + 1e-3 for y in x]
    data = [(1, 0, a), (1, 0, b), (2, 0, near(a)), (3, 0, near(b)), (4, 0, c), (5, 0, c), (5, 0, c), (1, None, a), (4, 0, None)]
    assert run(spark, data) == brute(data) and len(run(spark, data)) == len(data)


def test_more_hashes_keep_the_recall(spark):
    """Pairs at the bound, with as many hashes as 10 million and 10 billion vectors take."""
    from strandmill.llm.embeddings import bucket_ids, hashes_for

    rng = np.random.default_rng(10)
    a, d = rng.normal(size=(2, 2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    d -= (d * a).sum(1, keepdims=True) * a
    b = 0.9801 * a + math.sqrt(1 - 0.9801**2) * d / np.linalg.norm(d, axis=1, keepdims=True)
    assert (hashes_for(4000), hashes_for(10**7), hashes_for(10**10)) == (2, 4, 6)
    for k, bar in ((4, 0.99), (6, 0.9)):
        x, y = bucket_ids(a, hashes=k), bucket_ids(b, hashes=k)
        assert (x[:, :, :, None] == y[:, :, None, :]).any((1, 2, 3)).mean() >= bar
