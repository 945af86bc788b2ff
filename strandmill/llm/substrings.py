"""Substring dedup on a compacted de Bruijn graph of word windows.

An edge of the graph is a window of ``width`` consecutive words, which joins its first
words to its last. Edges that occur twice are repeated text. Edges are not dealt out one
by one: the seed of a window is its least-hashed run of SEED words (the leftmost of
equals), and consecutive windows with a seed at one place, 1 to 24 of them, are a run,
a path that is compacted where it stands. Equal windows have equal seeds.

1. Seeds are counted; runs whose seed occurs once hold no repeated window. A Bloom filter
   of the repeated seeds lets the others pass (it only spares work: counts decide).
2. Runs of equal words are one class; windows are counted over distinct classes, so a
   passage of a million copies is counted once for each of its contexts.
3. A join of the classes with the class before them compacts nonbranching paths: two
   classes are one path if each occurrence of the first is followed by the second and
   each of the second follows the first, with two occurrences or more.
4. A join takes the paths back to their source coordinates: spans (document, first word,
   windows, path, number of sources), each with two sources at least. Windows that are
   repeated within a run that occurs once are spans of their own.

Texts are shuffled once, at the end, with the spans of their document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch
from .skew import lookup

WIDTH, SEED = 35, 12
#: Bits of the filter of repeated seeds at most: 64 MB.
MAX_BITS = 1 << 29
#: The bits of a seed from which on it gives a place in the filter.
SHIFTS = (0, 12, 23, 35)
#: Words that are hashed together, bytes of a text that are split at once, and words whose hashes a task remembers.
CHUNK, SEGMENT, MEMO = 1 << 18, 1 << 20, 1 << 18
GAP = re.compile(rb"[\x20\x09-\x0d]")
SEED_BASE, EDGE_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


class Memo(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def segments(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time."""
    at = 0
    while at < len(text):
        cut = GAP.search(text, at + SEGMENT) if len(text) - at > SEGMENT else None
        end = cut.start() if cut else len(text)
        yield text[at:end].split()
        at = end


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolled(h: np.ndarray, k: int, base: np.uint64) -> np.ndarray:
    """Hash of each ``k`` consecutive words, from those of half as many."""
    power = lambda m: np.uint64(pow(int(base), m, 1 << 64))
    out, length, part, size = None, 0, h, 1
    while True:
        if k & size:
            out, length = (part, size) if out is None else (out[: len(h) - length - size + 1] * power(size) + part[length : len(h) - size + 1], length + size)
        if 2 * size > k:
            return mixed(out)
        part = part[:-size] * power(size) + part[size:]
        size *= 2


def least(s: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of each ``width`` consecutive values, the leftmost of equals."""
    value, place, size = s, np.arange(len(s)), 1
    while size < width:
        step = min(size, width - size)
        left = value[:-step] <= value[step:]
        value, place = np.where(left, value[:-step], value[step:]), np.where(left, place[:-step], place[step:])
        size += step
    return place


def runs(h: np.ndarray, ends: np.ndarray, width: int = WIDTH) -> tuple:
    """Runs of windows in texts that stand one after the other and end at ``ends``: first window, number, seed; and the edges' hashes.

    No run goes over the end of a text.
    """
    nothing = np.zeros(0, np.int64)
    if len(h) < width:
        return nothing, nothing, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    k = min(SEED, width)
    s = rolled(h, k, SEED_BASE)
    at = least(s, width - k + 1)
    start = np.arange(len(at))
    stop = ends[np.searchsorted(ends, start, side="right")]
    inside = start + width <= stop
    first = np.flatnonzero(inside & ~(np.append(False, inside[:-1]) & (np.append(-1, at[:-1]) == at) & (np.append(-1, stop[:-1]) == stop)))
    valid = np.append(0, np.cumsum(inside))
    number = valid[np.append(first[1:], len(inside))] - valid[first]
    return first, number, s[at[first]], rolled(h, width, EDGE_BASE)


def _pieces(text: bytes, memo: Memo, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first word, hashes of words) of pieces with CHUNK windows at most; each window is in one of them."""
    at, held = 0, np.zeros(0, np.uint64)
    for words in segments(text):
        held = np.append(held, np.fromiter(map(memo.__getitem__, words), np.uint64, len(words)))
        while len(held) >= CHUNK + width:
            yield at, held[: CHUNK + width - 1]
            at, held = at + CHUNK, held[CHUNK:]
    if len(held) >= width:
        yield at, held


def _chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Keys of pieces with their first word, the hashes of their words one after the other, and where each piece ends."""
    memo = Memo()
    keys, parts, size = [], [], 0
    for batch in batches:
        for *key, text in zip(*batch.columns):
            for at, h in _pieces(text.as_py() or b"", memo, width):
                keys.append([*(k.as_py() for k in key), at])
                parts.append(h)
                size += len(h)
                if size >= CHUNK:
                    yield keys, np.concatenate(parts), np.cumsum([len(p) for p in parts])
                    keys, parts, size = [], [], 0
    if parts:
        yield keys, np.concatenate(parts), np.cumsum([len(p) for p in parts])


def _seeds(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for _, h, ends in _chunks(batches, width):
        seed, n = np.unique(runs(h, ends, width)[2], return_counts=True)
        yield pa.record_batch([pa.array(seed.view(np.int64)), pa.array(n, pa.int64())], names=["seed", "n"])


def _suspected(seed: np.ndarray, full: np.ndarray) -> np.ndarray:
    mask = np.uint64(8 * len(full) - 1)
    hit = np.ones(len(seed), bool)
    for shift in SHIFTS:
        p = (seed >> np.uint64(shift)) & mask
        hit &= ((full[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
    return hit


RUN = "k1 long, k2 long, start long, n int, seed long, code long, before long, edges array<long>"


def _runs(batches: Iterator[pa.RecordBatch], width: int, shared) -> Iterator[pa.RecordBatch]:
    """Runs whose seed may be repeated, with the code of the run before them (null at the start).

    Seed and code, 128 bits, stand for the words of a run: the code is of its number of windows
    and of the first and the last, which overlap and hold all words.
    """
    full = shared.value
    for keys, h, ends in _chunks(batches, width):
        first, n, seed, edge = runs(h, ends, width)
        if not len(first):
            continue
        low, high = edge[first], edge[first + n - 1]
        code = mixed(mixed(mixed(seed) + low) + high + n.astype(np.uint64)).view(np.int64)
        text = np.searchsorted(ends, first, side="right")
        met = np.append(False, text[1:] == text[:-1])
        begins = np.append(0, ends)[text]
        take = np.flatnonzero(_suspected(seed, full))
        for a in range(0, len(take), 20_000):
            t = take[a : a + 20_000]
            offsets = np.append(0, np.cumsum(n[t]))
            flat = edge[np.repeat(first[t] - offsets[:-1], n[t]) + np.arange(offsets[-1])].view(np.int64)
            cols = [
                pa.array([keys[i][0] for i in text[t]], pa.int64()),
                pa.array([keys[i][1] for i in text[t]], pa.int64()),
                pa.array(first[t] - begins[t] + np.array([keys[i][2] for i in text[t]], np.int64), pa.int64()),
                pa.array(n[t], pa.int32()),
                pa.array(seed[t].view(np.int64)),
                pa.array(code[t]),
                pa.array(code[t - 1], mask=~met[t]),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)),
            ]
            yield pa.record_batch(cols, names=[c.split()[0] for c in RUN.split(", ")])


def _filter(seeds: DataFrame, count: int) -> np.ndarray:
    """Bits of the seeds, one for each of SHIFTS; the size follows their number up to MAX_BITS."""
    bits = 1 << 18
    while bits < min(MAX_BITS, 16 * count):
        bits *= 2
    full = np.zeros(bits // 8, np.uint8)
    at = F.array(*[F.shiftrightunsigned("seed", shift).bitwiseAND(bits - 1) + 1 for shift in SHIFTS])
    marks = seeds.select(F.explode(at).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    for b, found in marks.collect():
        full[(b - 1) * 4096 : b * 4096] = np.frombuffer(found, np.uint8)[: len(full) - (b - 1) * 4096]
    return full


def _classes(found: DataFrame) -> DataFrame:
    """A row per class: its occurrences ``c``, an occurrence's edges, and the one class before all its occurrences, if there is one."""
    one = F.when((F.count("before") == F.count("*")) & (F.min("before") == F.max("before")), F.min("before"))
    return found.groupBy("seed", "code").agg(F.count("*").alias("c"), one.alias("before"), F.first("edges").alias("edges"))


def repeated_spans(docs: DataFrame, text: str = "text", doc: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """k1, k2 (the document's id, or the least long, and the hash of its text), start, windows, path, sources.

    Every window that occurs elsewhere is in exactly one span: ``windows`` consecutive ones
    from word ``start`` on, which all occur ``sources`` times or more. ``path`` is equal for
    the sources of a path, null for a span within a run that occurs once. Texts of fewer words than
    ``width``, null texts and an empty table give no span. Equal rows are sources of their
    own: each gives its spans.
    """
    spark = docs.sparkSession
    texts = docs.select(*_key(docs, text, doc), F.col(text).cast("binary").alias("t"))
    counted = texts.select("t").mapInArrow(lambda it: _seeds(it, width), "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
    seeds = scratch.keep(counted.filter("n > 1"), "seeds")
    full = spark.sparkContext.broadcast(_filter(seeds, seeds.count()))
    found = scratch.keep(texts.mapInArrow(lambda it: _runs(it, width, full), RUN), "runs")
    total = found.count()
    classes = scratch.keep(_classes(found), "classes")
    edges = classes.select("seed", "c", F.explode("edges").alias("edge"))
    twice = edges.groupBy("seed", "edge").agg(F.sum("c").alias("w"), F.count_if(F.col("c") == 1).alias("size")).filter("w > 1 AND size > 0")
    single = classes.filter("c = 1").select("seed", "code", F.posexplode("edges").alias("at", "edge"))
    part = lookup(single, twice, ["seed", "edge"], "size", 24 * total).groupBy("seed", "code").agg(F.array_sort(F.collect_list(F.struct("at", "w"))).alias("own"))
    solid = classes.filter("c > 1")
    # All of b follow a, and there are no more of a than of b: then all of a are followed by b.
    ahead = solid.select(F.col("code").alias("before"), F.col("c").alias("of"))
    paths = solid.select("seed", "code", "c", "before").join(ahead, "before", "left").select("seed", "code", "c", F.coalesce(F.col("of") == F.col("c"), F.lit(False)).alias("joins"), F.lit(None).cast(part.schema["own"].dataType).alias("own"))
    ends = part.select("seed", "code", F.lit(1).cast("long").alias("c"), F.lit(False).alias("joins"), "own")
    at = lookup(found.select("k1", "k2", "start", "n", "seed", "code"), paths.unionByName(ends).withColumn("size", F.col("c")), ["seed", "code"], "size", total).drop("seed")
    if texts.groupBy("k1", "k2").count().filter("count > 1").limit(1).count():  # repeated rows have their spans once
        at = at.dropDuplicates(["k1", "k2", "start"])
    at = scratch.keep(at, "occurrences")
    # A path's occurrences all begin at its first class: the class that joins no other.
    order = Window.partitionBy("k1", "k2").orderBy("start")
    whole = at.filter("own is null").withColumn("no", F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(order))
    spans = whole.groupBy("k1", "k2", "no").agg(F.min("start").alias("start"), F.sum("n").cast("long").alias("windows"), F.min_by("code", "start").alias("path"), F.min("c").alias("sources"))
    own = at.filter("own is not null").select("k1", "k2", "start", F.explode("own").alias("o"))
    own = own.select("k1", "k2", (F.col("start") + F.col("o.at")).alias("start"), F.lit(1).cast("long").alias("windows"), F.lit(None).cast("long").alias("path"), F.col("o.w").alias("sources"))
    scratch.drop(seeds)
    return spans.drop("no").unionByName(own)


def _key(docs: DataFrame, text: str, doc: str) -> list[Column]:
    return [F.coalesce(F.col(doc).cast("long"), F.lit(-(1 << 63))).alias("k1"), F.xxhash64(F.col(text)).alias("k2")]


def cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """Words, words that spans (first, end) cover, and the other words joined by a space."""
    if not spans:
        n, out = 0, []
        for words in segments(text):
            n += len(words)
            out.append(b" ".join(words))
        return n, 0, b" ".join(x for x in out if x)
    a, b = (np.array(x) for x in zip(*spans))
    edge = np.zeros(int(b.max()) + 1, np.int64)
    np.add.at(edge, a, 1)
    np.add.at(edge, b, -1)
    gone = np.cumsum(edge) > 0
    n, lost, out = 0, 0, []
    for words in segments(text):
        own = gone[n : n + len(words)].tolist()
        own += [False] * (len(words) - len(own))
        out.append(b" ".join(w for w, g in zip(words, own) if not g))
        n += len(words)
        lost += sum(own)
    return n, lost, b" ".join(x for x in out if x)


def _apply(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        spans = batch.column(names.index("__spans")).to_pylist()
        done = [cut(t.as_py() or b"", [(s["a"], s["b"]) for s in own or []]) for t, own in zip(batch.column(names.index(text)), spans)]
        n, lost, kept = zip(*done) if done else ((), (), ())
        cols = {c: v for c, v in zip(names, batch.columns) if c != "__spans"}
        cols[text] = pa.array(kept, pa.binary()).cast(pa.string())
        cols |= {"n_words": pa.array(n, pa.int64()), "n_removed": pa.array(lost, pa.int64())}
        yield pa.record_batch(list(cols.values()), names=list(cols))


def dedup_substrings(docs: DataFrame, text: str = "text", doc: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """All columns of ``docs``, ``text`` with its kept words joined by one space, and n_words, n_removed.

    A word goes if it is in a window of ``width`` consecutive words that also starts anywhere
    else, be it in the same text; all sources go, the first as well. Words are what white space
    of ASCII separates, unchanged. A null text has no words and becomes an empty one. Repeated
    rows of one id are sources of their own, null ids are allowed, and other columns pass through;
    columns called n_words or n_removed are replaced. An empty table gives an empty table.
    """
    docs = docs.drop("n_words", "n_removed")
    spans = repeated_spans(docs, text, doc, width)
    own = spans.groupBy(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).agg(F.collect_list(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("windows") + width - 1).alias("b"))).alias("__spans"))
    k1, k2 = _key(docs, text, doc)
    keyed = docs.withColumns({"__k1": k1, "__k2": k2, text: F.col(text).cast("binary")})
    wide = keyed.join(own, ["__k1", "__k2"], "left").select(*docs.columns, "__spans")
    out = T.StructType([T.StructField(f.name, T.StringType() if f.name == text else f.dataType) for f in docs.schema] + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    return wide.mapInArrow(lambda it: _apply(it, text), out)
