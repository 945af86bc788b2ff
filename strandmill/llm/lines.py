"""Line dedup with two Bloom filters, one of keys seen once and one of keys seen twice.

Three passes over the texts, none of which shuffles a text:

1. every task sets the bits of its keys; a bit met again, in the task or when the
   tasks' blocks are merged, also goes to the second filter;
2. keys all of whose bits are in the second filter are suspects; only they are
   shuffled (128-bit digests, the largest few documents of a key per task), and
   counted exactly;
3. the confirmed keys, with the document that keeps them, are applied.

The filters have a fixed upper size (``max_bits``), full at some 2.8 million documents.
Beyond it they let more suspects through, up to all keys (24 bytes each, three of a key
per task at most); the exact count decides, and the cost stays in proportion to the lines. The confirmed keys
are sent to the tasks while they are at most ``max_sent`` (24 bytes each), and joined
by document beyond that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch
from .skew import lookup

BLOCK = 1 << 16
SPACE = b" \t\n\x0b\x0c\r"
FLUSH = 1 << 19


def line_key(line: bytes) -> bytes:
    """The line without [space, \\t-\\r] at its ends and with A-Z in lower case."""
    return line.strip(SPACE).lower()


def _long(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or key.isascii() or len(key.decode("utf-8", "replace")) >= least)


def _digests(text: bytes | None, least: int) -> list[bytes | None]:
    """Per line the digest of its key, None where the key is too short."""
    out = []
    for line in (text or b"").split(b"\n"):
        key = line.strip(SPACE).lower()
        out.append(xxhash.xxh3_128_digest(key) if _long(key, least) else None)
    return out


def _words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)


def _bits(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return words[:, 0] & mask, (words[:, 1] >> np.uint64(8)) & mask


def _mark(batches: Iterator[pa.RecordBatch], least: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Per task and block: positions set once, positions set twice."""

    def flush(found: list[bytes]) -> pa.RecordBatch:
        words = _words(found)
        order = np.argsort(words[:, 0], kind="stable")
        h = words[order, 0]
        again = np.zeros(len(h), bool)
        again[1:] = h[1:] == h[:-1]
        sides = []
        for w in (words, words[order[again]]):
            pos = np.unique(np.concatenate(_bits(w, bits)))
            block = (pos >> np.uint64(16)).astype(np.int32)
            edges = np.flatnonzero(np.diff(block, prepend=-1))
            low = (pos & np.uint64(BLOCK - 1)).astype("<u2")
            sides.append({int(block[a]): low[a:b].tobytes() for a, b in zip(edges, [*edges[1:], len(block)])})
        keys = list(sides[0])
        return pa.record_batch([pa.array(keys, pa.int32()), pa.array([sides[0][k] for k in keys], pa.binary()), pa.array([sides[1].get(k, b"") for k in keys], pa.binary())], names=["block", "once", "twice"])

    found: list[bytes] = []
    for batch in batches:
        for text in batch.column(0):
            found.extend({d for d in _digests(text.as_py(), least) if d})
            if len(found) >= FLUSH:
                yield flush(found)
                found = []
    if found:
        yield flush(found)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    once: dict[int, np.ndarray] = {}
    twice: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, a, b in zip(*(c.to_pylist() for c in batch.columns)):
            o = once.setdefault(block, np.zeros(BLOCK, bool))
            t = twice.setdefault(block, np.zeros(BLOCK, bool))
            pos = np.frombuffer(a, "<u2")
            t[pos[o[pos]]] = True
            o[pos] = True
            t[np.frombuffer(b, "<u2")] = True
    hit = [k for k in twice if twice[k].any()]
    if hit:
        yield pa.record_batch([pa.array(hit, pa.int32()), pa.array([np.packbits(twice[k], bitorder="little").tobytes() for k in hit], pa.binary())], names=["block", "bits"])


def twice_filter(docs: DataFrame, text: str, least: int, bits: int) -> np.ndarray:
    """The filter of keys seen twice: ``bits`` / 8 bytes, whatever the input."""
    marks = docs.select(F.col(text).cast("binary").alias("t")).mapInArrow(lambda it: _mark(it, least, bits), "block int, once binary, twice binary")
    parts = max(1, min(bits // BLOCK, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    full = np.zeros(bits // 8, np.uint8)
    for block, packed in marks.repartition(parts, "block").mapInArrow(_merge, "block int, bits binary").collect():
        full[block * BLOCK // 8 : (block + 1) * BLOCK // 8] = np.frombuffer(packed, np.uint8)
    return full


def _suspected(words: np.ndarray, full: np.ndarray, bits: int) -> np.ndarray:
    a, b = _bits(words, bits)
    test = lambda p: (full[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1
    return (test(a) & test(b)).astype(bool)


def _suspects(batches: Iterator[pa.RecordBatch], least: int, bits: int, most: int | None, shared) -> Iterator[pa.RecordBatch]:
    """(k1, k2, doc) of suspected keys; of a key the ``most`` largest documents of this task."""
    full = shared.value

    def flush(held: dict) -> pa.RecordBatch:
        words = _words([k for k, v in held.items() for _ in v])
        return pa.record_batch([pa.array(words[:, 0].view(np.int64)), pa.array(words[:, 1].view(np.int64)), pa.array([d for v in held.values() for d in v], pa.int64())], names=["k1", "k2", "doc"])

    held: dict[bytes, list[int]] = {}
    n = 0
    for batch in batches:
        docs, keys = [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if doc is not None:
                own = {d for d in _digests(text.as_py(), least) if d}
                keys.extend(own)
                docs.extend([doc] * len(own))
        if keys:
            for i in np.flatnonzero(_suspected(_words(keys), full, bits)):
                v = held.setdefault(keys[i], [])
                d = docs[i]
                if d in v and most:
                    continue
                if most and len(v) == most:
                    if d > min(v):
                        v[v.index(min(v))] = d
                else:
                    v.append(d)
                    n += 1
        if n >= FLUSH:
            yield flush(held)
            held, n = {}, 0
    if held:
        yield flush(held)


def _apply(batches: Iterator[pa.RecordBatch], text: str, doc: str, least: int, shared, drops: str | None) -> Iterator[pa.RecordBatch]:
    """Drop lines whose key another document keeps; k1, k2 sorted, keep: its document."""
    if shared is not None:
        k1, k2, keep = shared.value
    for batch in batches:
        names = batch.schema.names
        docs = batch.column(names.index(doc)).to_pylist()
        texts = [t.as_py() for t in batch.column(names.index(text))]
        digests = [_digests(t, least) for t in texts]
        gone: list[set] = [set()] * len(docs)
        if shared is not None and len(k1):
            flat = [d for row in digests for d in row if d]
            if flat:
                words = _words(flat)
                at = np.minimum(np.searchsorted(k1, words[:, 0]), len(k1) - 1)
                hit = (k1[at] == words[:, 0]) & (k2[at] == words[:, 1])
                stay = keep[at]
                i = 0
                gone = []
                for row, d in zip(digests, docs):
                    own = set()
                    for x in row:
                        if x:
                            if hit[i] and d is not None and stay[i] != d:
                                own.add(x)
                            i += 1
                    gone.append(own)
        elif drops:
            gone = [{np.array([r["k1"], r["k2"]], np.int64).tobytes() for r in row or []} for row in batch.column(names.index(drops)).to_pylist()]
        kept, n_lines, n_dropped = [], [], []
        for t, row, own in zip(texts, digests, gone):
            n_lines.append(len(row))
            if own:
                lines = [x for x, d in zip((t or b"").split(b"\n"), row) if d is None or d not in own]
                n_dropped.append(len(row) - len(lines))
                kept.append(b"\n".join(lines))
            else:
                n_dropped.append(0)
                kept.append(t or b"")
        cols = {n: c for n, c in zip(names, batch.columns) if n != drops}
        cols[text] = pa.array(kept, pa.binary()).cast(pa.string())
        cols |= {"n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}
        yield pa.record_batch(list(cols.values()), names=list(cols))


def dedup_lines(docs: DataFrame, text: str = "text", doc: str = "doc_id", min_chars: int = 20, min_docs: int = 3, max_bits: int = 1 << 29, max_sent: int = 1_000_000) -> DataFrame:
    """All columns of ``docs``, ``text`` without repeated lines, and n_lines, n_dropped.

    A key of ``min_chars`` code points or more that ``min_docs`` documents hold loses its
    lines everywhere but in the largest document id. A null text is an empty one, with one
    empty line. Repeated rows of one id are one document. A row whose id is null counts
    for no key and stays as it is. Columns called n_lines or n_dropped are replaced; further
    columns pass through. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped")
    rows = docs.count()
    bits = 1 << 20
    while bits < min(max_bits, 192 * rows):
        bits *= 2
    out = T.StructType([T.StructField(f.name, T.StringType() if f.name == text else f.dataType) for f in docs.schema] + [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    shared = spark.sparkContext.broadcast(twice_filter(docs, text, min_chars, bits))
    pairs = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).cast("binary").alias("t"))
    found = pairs.mapInArrow(lambda it: _suspects(it, min_chars, bits, min_docs, shared), "k1 long, k2 long, doc long")
    confirmed = scratch.keep(found.groupBy("k1", "k2").agg(F.countDistinct("doc").alias("n"), F.max("doc").alias("keep")).filter(F.col("n") >= min_docs).select("k1", "k2", "keep"), "lines")
    wide = docs.withColumn(text, F.col(text).cast("binary"))
    if confirmed.count() <= max_sent:
        t = confirmed.toArrow()
        k1, k2, keep = (t.column(c).to_numpy() for c in ("k1", "k2", "keep"))
        order = np.argsort(k1.view(np.uint64), kind="stable")
        sent = spark.sparkContext.broadcast((k1.view(np.uint64)[order], k2.view(np.uint64)[order], keep[order]))
        return wide.mapInArrow(lambda it: _apply(it, text, doc, min_chars, sent, None), out)
    every = scratch.keep(pairs.mapInArrow(lambda it: _suspects(it, min_chars, bits, None, shared), "k1 long, k2 long, doc long"), "suspects")
    sized = confirmed.join(every.groupBy("k1", "k2").agg(F.count("*").alias("rows")), ["k1", "k2"])
    lost = lookup(every, sized, ["k1", "k2"], "rows", every.count()).filter("doc <> keep").groupBy(F.col("doc").alias("__doc")).agg(F.collect_set(F.struct("k1", "k2")).alias("__drops"))
    joined = wide.join(lost, wide[doc].cast("long") == lost["__doc"], "left").drop("__doc")
    return joined.mapInArrow(lambda it: _apply(it, text, doc, min_chars, None, "__drops"), out)
