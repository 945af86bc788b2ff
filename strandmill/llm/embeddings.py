"""Embedding near-dedup by cross-polytope hashing.

A vector is turned by three rounds of random signs and fast Hadamard transforms; the
largest coordinate by absolute value, with its sign, is one hash, some of them are a
bucket (more, the more vectors there are) and TABLES buckets with their two nearest
probes each (the second-largest coordinate instead) are the index. Vectors that meet in
a bucket are verified by cosine in double precision. Vectors are fetched only where a
bucket has more than one.

Equal vectors of a label are one class before anything is dealt. A bucket gives no pairs: it gives
to each class the weight of its partners, where a pair counts only in the smallest of
the buckets that it shares, and the edges of a spanning forest. Buckets of more than
``hot`` classes are cut into blocks, and the pairs of blocks dealt to different tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .components import components
from .skew import lookup

TABLES = 6
PROBES = 3
SEED = 20240229


def rotate(x: np.ndarray, table: int, which: int) -> np.ndarray:
    """Three rounds of signs and Hadamard transform on rows, padded to a power of two."""
    n, d = x.shape
    width = 1 << max(1, (d - 1).bit_length())
    out = np.zeros((n, width))
    out[:, :d] = x
    signs = np.random.Generator(np.random.PCG64([SEED, table, which, width])).integers(0, 2, (3, width)) * 2.0 - 1.0
    for s in signs:
        out *= s
        h = 1
        while h < width:
            v = out.reshape(n, width // (2 * h), 2, h)
            a, b = v[:, :, 0].copy(), v[:, :, 1].copy()
            v[:, :, 0], v[:, :, 1] = a + b, a - b
            h *= 2
        out /= np.sqrt(width)
    return out


def bucket_ids(x: np.ndarray, tables: int = TABLES, hashes: int = 2) -> np.ndarray:
    """(vectors, tables, PROBES) ids of unit vectors: the bucket itself and, for the two hashes that are nearest to a change, its probes."""
    n = len(x)
    out = np.empty((n, tables, PROBES), np.int64)
    rows = np.arange(n)
    for t in range(tables):
        first, second, gap = [], [], []
        for k in range(hashes):
            y = rotate(x, t, k)
            size = np.abs(y)
            top = size.argmax(1)
            best = size[rows, top].copy()
            size[rows, top] = -1
            nxt = size.argmax(1)
            gap.append(best - size[rows, nxt])
            first.append(top * 2 + (y[rows, top] < 0))
            second.append(nxt * 2 + (y[rows, nxt] < 0))
        base = np.full(n, t, np.int64)
        width = 2 * y.shape[1]
        for k in range(hashes):
            base = base * width + first[k]
        out[:, t, 0] = base
        near = np.argsort(np.array(gap), axis=0)
        for p in range(1, PROBES):
            turned = near[p - 1] if p - 1 < hashes else near[0]
            other = np.full(n, t, np.int64)
            for k in range(hashes):
                other = other * width + np.where(turned == k, second[k], first[k])
            out[:, t, p] = other
    return out


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, dim, digest, vec) of all rows; the last four are null where a vector cannot link. digest is of the label and the vector."""
    for batch in batches:
        ids, rows = batch.column(0).to_pylist(), []
        for i, label, v in zip(ids, batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            x = np.array(v, "<f8") + 0.0 if i is not None and label is not None and v and None not in v else np.zeros(0)
            if x.any() and np.isfinite(x).all():
                raw = x.tobytes()
                name = label.encode()
                rows.append((label, len(x), hashlib.blake2b(len(name).to_bytes(8, "little") + name + raw, digest_size=16).digest(), raw))
            else:
                rows.append((None,) * 4)
        cols = zip(*rows) if rows else [[]] * 4
        yield pa.record_batch([pa.array(ids, pa.int64()), *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.binary(), pa.binary())))], names=["id", "label", "dim", "digest", "vec"])


def _coded(batches: Iterator[pa.RecordBatch], tables: int, hashes: int) -> Iterator[pa.RecordBatch]:
    """Adds codes: the buckets of a vector and its probes, table by table."""
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            vec = batch.column(batch.schema.names.index("vec")).to_pylist()
            by_dim: dict[int, list[int]] = {}
            for i, v in enumerate(vec):
                by_dim.setdefault(len(v) // 8, []).append(i)
            codes: list = [None] * len(vec)
            for ids in by_dim.values():
                for i, c in zip(ids, bucket_ids(_unit([vec[i] for i in ids]), tables, hashes).reshape(len(ids), -1)):
                    codes[i] = c
            yield pa.record_batch([*batch.columns, pa.array(codes, pa.list_(pa.int64()))], names=[*batch.schema.names, "codes"])


def hashes_for(rows: int, dims: int = 64) -> int:
    """Hashes to a bucket, so that there are four buckets of a table or more to a vector, and 2 at least."""
    k = 2
    while (2 * dims) ** k < 4 * rows:
        k += 1
    return k


def _within(bucket: int, rep: np.ndarray, n: np.ndarray, x: np.ndarray, codes: np.ndarray, own: np.ndarray, lo: int, hi: int, least: float, tables: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Weights of partners by row and spanning edges among the rows of one bucket, or of two blocks of it."""
    weight = np.zeros(len(rep), np.int64)
    root = np.arange(len(rep))
    edges = []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    left, right = (np.arange(len(rep)),) * 2 if lo == hi else (np.flatnonzero(own == lo), np.flatnonzero(own == hi))
    for a in range(0, len(left), 512):
        part = left[a : a + 512]
        i, j = np.nonzero(x[part] @ x[right].T >= least)
        i, j = part[i], right[j]
        if lo == hi:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), 20_000):
            p, q = i[at : at + 20_000], j[at : at + 20_000]
            same = codes[p][:, :, :, None] == codes[q][:, :, None, :]
            shared = np.where(same.any(3), codes[p], np.iinfo(np.int64).max).reshape(len(p), -1).min(1)
            mine = shared == bucket
            np.add.at(weight, p[mine], n[q[mine]])
            np.add.at(weight, q[mine], n[p[mine]])
            while len(p):  # a round unites each row with one partner; what is united already falls away
                r = root[root[p]], root[root[q]]
                new = r[0] != r[1]
                p, q = p[new], q[new]
                if not len(p):
                    break
                _, once = np.unique(p, return_index=True)
                for u, v in zip(p[once].tolist(), q[once].tolist()):
                    u2, v2 = top(u), top(v)
                    if u2 != v2:
                        root[max(u2, v2)] = min(u2, v2)
                        edges.append((u, v))
                while (root[root] != root).any():
                    root = root[root]
    return weight, edges


def _verify(batches: Iterator[pa.RecordBatch], least: float, tables: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (label, dim, bucket, lo, hi). Gives (u, weight, v): v null for a weight, weight 0 for an edge."""
    held: list = []
    key = None

    def done(rows: list) -> Iterator[tuple]:
        if len(rows) > 1:
            own, rep, n, vec, codes = zip(*rows)
            rep = np.array(rep)
            c = np.array(codes, np.int64).reshape(len(rep), tables, PROBES)
            w, e = _within(key[2], rep, np.array(n), _unit(list(vec)), c, np.array(own), key[3], key[4], least, tables)
            for i in np.flatnonzero(w):
                yield int(rep[i]), int(w[i]), None
            for i, j in e:
                yield int(rep[i]), 0, int(rep[j])

    for batch in batches:
        cols = [batch.column(batch.schema.names.index(c)).to_pylist() for c in ("label", "dim", "bucket", "lo", "hi", "own", "rep", "n", "vec", "codes")]
        out = []
        for row in zip(*cols):
            if row[:5] != key:
                out.extend(done(held))
                key, held = row[:5], []
            held.append(row[5:])
        if out:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], names=["u", "weight", "v"])
    out = list(done(held))
    if out:
        yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], names=["u", "weight", "v"])


def near_duplicates(vectors: DataFrame, vec: str = "embedding", label: str = "label", vec_id: str = "vec_id", least: float = 0.98, tables: int = TABLES, hashes: int | None = None, hot: int | None = None) -> DataFrame:
    """Per row of ``vectors``: vec_id, n_links, component_id, kept.

    Links join vectors of one label and one length with cosine >= ``least``. Null ids,
    labels or vectors, empty or zero vectors and such with null or non-finite components link
    with nothing: n_links 0, their own component, kept. Repeated rows of an id count as
    vectors of their own, whether their vectors are equal or not; each row has the links of
    its own vector. ``hashes`` follows the number of rows where it is not given, and
    ``hot``, the classes of a block, is a quarter of a shuffle partition's share, 64 to
    1,024. Other columns are not read; an empty table gives an empty table.
    """
    parts = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    asked = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vec).cast("array<double>").alias("v"))
    read = scratch.keep(asked.mapInArrow(_read, "id long, label string, dim int, digest binary, vec binary"), "vectors")
    rows = read.count()
    hashes = hashes or hashes_for(rows)
    hot = hot or min(1024, max(64, rows * tables * PROBES // (4 * parts)))
    classes = read.filter("digest is not null").groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("label", "dim", "vec")])
    classes = classes.select(F.monotonically_increasing_id().alias("rep"), *classes.columns)
    classes = scratch.keep(classes.mapInArrow(lambda it: _coded(it, tables, hashes), "rep long, digest binary, least long, n long, label string, dim int, vec binary, codes array<long>"), "classes")
    by = ["label", "dim", "bucket"]
    index = classes.select("label", "dim", F.explode(F.array_distinct("codes")).alias("bucket"), "rep")
    met = lookup(index, index.groupBy(*by).agg(F.count("*").alias("m")).filter("m > 1").withColumn("blocks", F.ceil(F.col("m") / hot).cast("int")), by, "m", rows * tables * PROBES)
    met = met.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select(*by, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "rep")
    by = [*by, "lo", "hi"]
    met = met.join(classes.select("rep", "n", "vec", "codes"), "rep").repartition(parts, *by).sortWithinPartitions(*by, "rep")
    found = scratch.keep(met.mapInArrow(lambda it: _verify(it, least, tables), "u long, weight long, v long"), "found")
    weights = found.filter("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("weight").alias("weight"))
    joint = components(found.filter("v is not null").select("u", "v")).withColumnRenamed("node", "rep")
    linked = classes.select("rep", "digest", "least", "n").join(weights, "rep", "left").join(joint, "rep", "left").filter("n > 1 or weight is not null or component is not null")
    linked = scratch.keep(linked.select("digest", "n", "least", (F.col("n") - 1 + F.coalesce("weight", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component")), "linked")
    names = linked.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    member = scratch.keep(lookup(linked, names, "component", "size", linked.count()).select("digest", "n", "n_links", "component_id"), "member")
    out = lookup(read.select("id", "digest"), member, "digest", "n", rows, "left")
    scratch.drop(classes, found, linked)
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
