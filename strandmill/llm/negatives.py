"""Hard-negative mining: per anchor a full sort of integer scores, positives' limits by binary search.

Every component x of a vector becomes floor(scale * x); the score of a row is its integer
inner product with the anchor. Anchors and rows are dealt in blocks, each pair of blocks
to one task, so neither an anchor's scores nor all anchors are ever in one place:

1. each pair of blocks gives an anchor its best rows of the same label; of them the best
   over all blocks are its positives;
2. each pair sorts the scores of its rows per anchor, by score and id, finds each
   positive's upper limit by binary search and reads rows of other labels until enough
   are found or the lower limit is passed; of them the best over all blocks are kept.

What meets per anchor is a rank-limited window, which Spark cuts before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

#: Rows and anchors of a block.
ROWS, ANCHORS = 16_384, 1024
#: Anchors whose scores are in memory at a time.
SLICE = 64
LONG = np.iinfo(np.int64)


def _read(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    """(id, label, anchor, dim, wide, q): rows that take part, their components as 16-bit integers or, if wide, as whole doubles."""
    for batch in batches:
        out = []
        for i, label, anchor, v in zip(*(c.to_pylist() for c in batch.columns)):
            if i is None or label is None or v is None or None in v:
                continue
            x = np.array(v, "<f8")
            if np.isfinite(x).all():
                with np.errstate(over="ignore"):
                    q = np.clip(np.floor(scale * x), -1e300, 1e300)
                wide = bool(len(q)) and float(np.abs(q).max()) > 32_767
                out.append((i, label, bool(anchor), len(q), wide, (q if wide else q.astype("<i2")).tobytes()))
        cols = zip(*out) if out else [[]] * 6
        kinds = (pa.int64(), pa.string(), pa.bool_(), pa.int32(), pa.bool_(), pa.binary())
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)], names=["id", "label", "anchor", "dim", "wide", "q"])


def _matrix(q: list[bytes], wide: list[bool]) -> np.ndarray:
    if not any(wide):
        return np.frombuffer(b"".join(q), "<i2").reshape(len(q), -1).astype(np.float64)
    return np.stack([np.frombuffer(x, "<f8") if w else np.frombuffer(x, "<i2").astype(np.float64) for x, w in zip(q, wide)])


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers as longs; what is beyond a long becomes the largest or smallest one."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2.0**53:
        return (a @ b.T).astype(np.int64)
    x, y = ([[int(v) for v in row] for row in m] for m in (a, b))
    return np.array([[min(max(sum(map(int.__mul__, p, r)), LONG.min), LONG.max) for r in y] for p in x], np.int64)


def ordered(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per line the scores from high to low and their columns, ties by column (columns go by id): a score and its column are one sortable number."""
    n = scores.shape[1]
    bits = max(1, (n - 1).bit_length())
    if n and max(-int(scores.min()), int(scores.max())) < 1 << (62 - bits):
        key = np.sort((-scores << bits) | np.arange(n), axis=1)
        return -(key >> bits), key & ((1 << bits) - 1)
    at = np.argsort(-scores.astype(object) if n and scores.min() == LONG.min else -scores, axis=1, kind="stable")
    return np.take_along_axis(scores, at, 1), at


def within(high_to_low: np.ndarray, order: np.ndarray, other: np.ndarray, upper: int, lower: int, k: int) -> list[int]:
    """The first ``k`` columns of ``order`` that are ``other`` with upper >= score >= lower."""
    if upper < lower:
        return []
    up = high_to_low[::-1]
    start, end = (len(up) - int(np.searchsorted(up, min(max(x, LONG.min), LONG.max), side=s)) for x, s in ((upper, "right"), (lower, "left")))
    found: list[int] = []
    step = 4 * k
    while start < end and len(found) < k:
        part = order[start : min(end, start + step)]
        found.extend(part[other[part]].tolist())
        start, step = start + step, 2 * step
    return found[:k]


def _groups(batches: Iterator[pa.RecordBatch], names: list[str], width: int) -> Iterator[list[tuple]]:
    """Rows in runs of equal first ``width`` columns."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(batch.schema.names.index(c)).to_pylist() for c in names)):
            if row[:width] != key and held:
                yield held
                held = []
            key = row[:width]
            held.append(row)
    if held:
        yield held


def _pairs(batches: Iterator[pa.RecordBatch], positives: int) -> Iterator[pa.RecordBatch]:
    """First pass: of each anchor the best rows of its label in this block."""
    names = ["dim", "ab", "rb", "row", "id", "uid", "label", "wide", "q"]
    for rows in _groups(batches, names, 3):
        left = [r for r in rows if not r[3]]
        right = sorted((r for r in rows if r[3]), key=lambda r: (r[4], r[5]))
        if not left or not right:
            continue
        ids, labels = np.array([r[4] for r in right]), np.array([r[6] for r in right], object)
        b = _matrix([r[8] for r in right], [r[7] for r in right])
        out: list[tuple] = []
        for name in {r[6] for r in left}:
            own = np.flatnonzero(labels == name)
            mine = [r for r in left if r[6] == name]
            for at in range(0, len(mine) if len(own) else 0, SLICE):
                part = mine[at : at + SLICE]
                high, order = ordered(inner(_matrix([r[8] for r in part], [r[7] for r in part]), b[own]))
                for r, s, o in zip(part, high, order):
                    keep = np.flatnonzero(ids[own[o]] != r[4])[:positives]
                    out.extend((r[5], int(s[j]), int(ids[own[o[j]]]), right[own[o[j]]][5]) for j in keep)
        if out:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], names=["auid", "score", "id", "uid"])


def _negatives(batches: Iterator[pa.RecordBatch], k: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """Second pass: of each anchor and positive the first negatives of this block."""
    names = ["dim", "ab", "rb", "row", "id", "uid", "label", "wide", "q", "positives"]
    for rows in _groups(batches, names, 3):
        left = [r for r in rows if not r[3]]
        right = sorted((r for r in rows if r[3]), key=lambda r: (r[4], r[5]))
        if not left or not right:
            continue
        ids, labels = np.array([r[4] for r in right]), np.array([r[6] for r in right], object)
        b = _matrix([r[8] for r in right], [r[7] for r in right])
        others = {name: labels != name for name in {r[6] for r in left}}
        out: list[tuple] = []
        for at in range(0, len(left), SLICE):
            part = left[at : at + SLICE]
            best, order = ordered(inner(_matrix([r[8] for r in part], [r[7] for r in part]), b))
            for r, s, o in zip(part, best, order):
                scores = None
                for p in r[9]:
                    found = within(s, o, others[r[6]], high * p["score"] // 100, -(-low * p["score"] // 100), k)
                    if found and scores is None:
                        scores = np.empty(len(o), np.int64)
                        scores[o] = s
                    out.extend((r[5], r[4], p["rn"], p["id"], p["score"], int(ids[j]), int(scores[j])) for j in found)
        if out:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], names=["auid", "anchor_id", "rn", "positive_id", "positive_score", "negative_id", "negative_score"])


def mine(vectors: DataFrame, anchors: Column, vec: str = "embedding", label: str = "label", vec_id: str = "vec_id", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` says which rows are anchors. An anchor's positives are its ``positives`` best
    rows of the same label and another id; for each, the ``negatives`` best rows of another
    label with ``low`` * positive <= 100 * negative <= ``high`` * positive. Higher scores
    come first, ties by smaller id. All of them, if there are fewer.

    Rows whose id, label or vector is null, or with a null or non-finite component, take no
    part. Vectors meet those of their own length only; those of length 0 score 0. Repeated
    rows of an id are rows of their own, as anchors (each has its own rows of the result) and
    as partners. Scores beyond a long are the largest or smallest long. Other columns are not
    read; an empty table gives an empty table.
    """
    spark = vectors.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    asked = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("string").alias("label"), anchors.alias("anchor"), F.col(vec).cast("array<double>").alias("v"))
    read = asked.mapInArrow(lambda it: _read(it, scale), "id long, label string, anchor boolean, dim int, wide boolean, q binary")
    rows = scratch.keep(read.select(F.monotonically_increasing_id().alias("uid"), *read.columns), "vectors")
    n, n_anchors = rows.agg(F.count("*"), F.count_if("anchor")).first()
    rbs = max(1, -(-n // min(ROWS, max(1024, n // parts))))
    abs_ = max(1, -(-n_anchors // ANCHORS))

    def dealt(left: DataFrame, more: list[str]) -> DataFrame:
        blocks = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
        own = lambda count: F.pmod(F.xxhash64("uid"), F.lit(count)).cast("int")
        cols = ["uid", "id", "label", "dim", "wide", "q"]
        a = left.select(*cols, *more, F.lit(False).alias("row"), own(abs_).alias("ab"), blocks(rbs).alias("rb"))
        b = rows.select(*cols, *[F.lit(None).cast(left.schema[m].dataType).alias(m) for m in more], F.lit(True).alias("row"), own(rbs).alias("rb"), blocks(abs_).alias("ab"))
        return a.unionByName(b).repartition(max(parts, min(rbs * abs_, 10_000)), "dim", "ab", "rb").sortWithinPartitions("dim", "ab", "rb")

    anchor = rows.filter("anchor")
    first = dealt(anchor, []).mapInArrow(lambda it: _pairs(it, positives), "auid long, score long, id long, uid long")
    rank = F.row_number().over(Window.partitionBy("auid").orderBy(F.desc("score"), "id", "uid"))
    best = first.withColumn("rn", rank).filter(F.col("rn") <= positives)
    best = best.groupBy("auid").agg(F.array_sort(F.collect_list(F.struct(F.col("rn").cast("long").alias("rn"), "id", "score"))).alias("positives"))
    asking = scratch.keep(anchor.join(best, F.col("uid") == F.col("auid")).drop("auid", "anchor"), "anchors")
    found = dealt(asking, ["positives"]).mapInArrow(lambda it: _negatives(it, negatives, low, high), "auid long, anchor_id long, rn long, positive_id long, positive_score long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("auid", "rn").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= negatives).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
