import hashlib
import random

from strandmill.llm.spans import BLOCK, PrefixHash, extension, fingerprint, fingerprints, likeness, same


def test_prefix_hashes_answer_equality_and_extension():
    rng = random.Random(1)
    a = "".join(rng.choice("ab") for _ in range(BLOCK * 2 + 77))
    b = a[5:BLOCK + 300] + "c" + a[BLOCK + 301 :]
    x, y = PrefixHash(a), PrefixHash(b)
    for _ in range(300):
        i, j, n = rng.randrange(len(a)), rng.randrange(len(b)), rng.choice([0, 1, 2, 5, 40, BLOCK])
        if i + n <= len(a) and j + n <= len(b):
            assert same(x, i, y, j, n) == (a[i : i + n] == b[j : j + n])
    assert extension(x, 5, y, 0) == BLOCK + 295
    for _ in range(40):
        i, j = rng.randrange(len(a)), rng.randrange(len(b))
        n = 0
        while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
            n += 1
        assert extension(x, i, y, j) == n


def test_likeness():
    rng = random.Random(2)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    a, b = text(3000), text(3000)
    assert fingerprint(a) == fingerprint(str(a)) and likeness(fingerprint(a), fingerprint(a)) == 1
    assert likeness(fingerprint(a), fingerprint(b)) < 0.1
    half = a[: len(a) // 2] + b[: len(a) // 2]
    assert 0.35 < likeness(fingerprint(a), fingerprint(half)) < 0.65
    assert fingerprint("") == fingerprint("") and 0 <= likeness(fingerprint(""), fingerprint("a")) <= 1


def test_table(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(10**6) * 2, "é🎉" * rng.randrange(0, 30) + str(i)) for i in range(300)] + [(1, None), (3, ""), (5, "x" * 500_000)]
    rows = list({r[0]: r for r in rows}.values())
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: r for r in fingerprints(df).collect()}
    order = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        new = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        r = got[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert r["fingerprint"] == fingerprint(t) and r["edited_fingerprint"] == fingerprint(new)
        assert r["near_next"] == likeness(fingerprint(t), fingerprint(nxt))


def test_one_row_null_ids_and_empty(spark):
    df = spark.createDataFrame([(4, "abcd")], "doc_id long, text string")
    assert fingerprints(df).first()["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    df = spark.createDataFrame([(None, "abcd"), (None, "abcd"), (2, "xyz"), (2, "xyz")], "doc_id long, text string")
    assert fingerprints(df).count() == 4
    assert fingerprints(df.limit(0)).count() == 0


def test_clashing_columns_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "abcd", "k", 1, True), (1, "abcd", "k", 1, True), (2, "xyzw", "l", 2, False)], "doc_id long, text string, key string, part int, guest boolean")
    got = sorted((r["doc_id"], r["n_chars"]) for r in fingerprints(df.withColumn("top", df.part).withColumn("fingerprint", df.key)).collect())
    assert got == [(1, 4), (1, 4), (2, 4)]
