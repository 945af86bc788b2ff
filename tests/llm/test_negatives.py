import math
import random

from pyspark.sql import functions as F

from strandmill.llm.negatives import LONG, mine

SCHEMA = "vec_id long, label int, embedding array<float>, score int"


def brute(rows, anchors, pos=5, neg=10):
    use = [(i, y, [math.floor(256 * x) for x in v]) for i, y, v, _ in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    clip = lambda n: min(max(n, LONG.min), LONG.max)
    out = []
    for i, y, q in (r for r in use if anchors(r[0])):
        scored = sorted((-clip(sum(a * b for a, b in zip(q, r))), j, z) for j, z, r in use if len(r) == len(q))
        for s, p, _ in [x for x in scored if x[2] == y and x[1] != i][:pos]:
            found = [(-n, j) for n, j, z in scored if z != y and 30 * -s <= 100 * -n <= 90 * -s][:neg]
            out += [(i, p, k, j, -s, n) for k, (n, j) in enumerate(found, 1)]
    return sorted(out)


def single(x):
    import struct

    return None if x is None else struct.unpack("f", struct.pack("f", x))[0]


def check(spark, rows, every=7):
    rows = [(i, y, None if v is None else [single(x) for x in v], 0) for i, y, v in rows]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(map(tuple, mine(df, F.col("vec_id") % every == 0).collect())) == brute(rows, lambda i: i % every == 0)


def test_equals_brute_force(spark):
    rng = random.Random(12)
    rows = [(i, rng.randrange(4), [rng.gauss(0.3, 0.2) for _ in range(8)]) for i in range(2600)]
    check(spark, rows, 100)


def test_ties_nulls_lengths_and_repeated_rows(spark):
    rng = random.Random(13)
    few = [[round(rng.random(), 1) for _ in range(4)] for _ in range(5)]
    rows = [(i % 120, rng.choice((0, 0, 0, 1, 2, None)), rng.choice((*few, [0.5, 0.5], [], None, [1.0, None], [float("nan"), 1.0], [float("inf"), 0.0]))) for i in range(300)]
    check(spark, rows + [(None, 1, [0.5, 0.5])])


def test_scores_beyond_doubles_are_exact(spark):
    rng = random.Random(14)
    check(spark, [(i, i % 3, [rng.choice((1e7, 3.5, 1e12, -2.0)) * rng.random() for _ in range(3)]) for i in range(90)])
    check(spark, [(i, i % 2, [1e30, float(i)]) for i in range(20)])


def test_empty_table_and_no_anchor(spark):
    df = spark.createDataFrame([(1, 0, [1.0], 0), (2, 1, [1.0], 0)], SCHEMA)
    assert mine(df.limit(0), F.col("vec_id") % 7 == 0).count() == 0 and mine(df, F.col("vec_id") % 7 == 0).count() == 0
