"""Document fingerprints from prefix polynomial hashes.

``PrefixHash`` keeps, for two bases modulo 2^31 - 1, the hash of every prefix, so the
equality of any two spans takes two subtractions, and the longest common extension of
two positions a binary search. ``fingerprint`` reads a text in blocks: the hash of every
span of WIDTH code points (fewer in short texts) comes from the same prefix arrays, the smallest in each of
SLOTS classes is kept, and the hash of the whole stands in front. Equal texts have equal
fingerprints; the likeness of two is the share of spans (as Dice's coefficient) that
their texts have in common, as far as the kept ones tell.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

P = (1 << 31) - 1
BASES = (911382323, 972663749)
WIDTH = 24
#: Shorter texts have shorter spans: (code points below which, width).
SHORT = ((24, 2), (192, 6))
SLOTS = 128
BLOCK = 1 << 16
_U = np.uint64


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1 for x below 2^62."""
    x = (x & _U(P)) + (x >> _U(31))
    x = (x & _U(P)) + (x >> _U(31))
    return np.where(x >= P, x - _U(P), x)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, _U)
    step = base % P
    while len(out) < n:
        out = np.concatenate((out, _mod(out * _U(step))))
        step = step * step % P
    return out[:n]


POW = tuple(_powers(b, BLOCK + WIDTH) for b in BASES)
INV = _powers(pow(BASES[0], -1, P), BLOCK + WIDTH)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _prefix(codes: np.ndarray, side: int) -> np.ndarray:
    """Prefix hashes of a block, relative to its start: one more than it has code points."""
    terms = _mod((codes.astype(_U) + _U(1)) * POW[side][: len(codes)])
    out = np.zeros(len(codes) + 1, _U)
    np.cumsum(terms, out=out[1:])
    return _mod(out)


class PrefixHash:
    """Hashes at the start of every block for both bases; inside a block they are computed when asked for."""

    def __init__(self, text: str | np.ndarray):
        self.codes = codes_of(text) if isinstance(text, str) else text
        n = len(self.codes)
        self.at = [[0] for _ in BASES]
        for a in range(0, n, BLOCK):
            part = self.codes[a : a + BLOCK]
            for side, base in enumerate(BASES):
                self.at[side].append((self.at[side][-1] + pow(base, a, P) * int(_prefix(part, side)[-1])) % P)
        self._last: dict[int, list[np.ndarray]] = {}

    def __len__(self) -> int:
        return len(self.codes)

    def _block(self, k: int) -> list[np.ndarray]:
        if k not in self._last:
            if len(self._last) > 8:
                self._last.clear()
            part = self.codes[k * BLOCK : (k + 1) * BLOCK]
            self._last[k] = [_prefix(part, side) for side in range(len(BASES))]
        return self._last[k]

    def prefix(self, i: int) -> tuple[int, int]:
        """Hash of the first i code points."""
        k, r = divmod(i, BLOCK)
        if not r:
            return tuple(s[k] for s in self.at)
        block = self._block(k)
        return tuple((self.at[side][k] + pow(BASES[side], k * BLOCK, P) * int(block[side][r])) % P for side in range(len(BASES)))

    def span(self, i: int, j: int) -> tuple[int, int]:
        """Hash of the code points from i to j, the same wherever they stand."""
        a, b = self.prefix(i), self.prefix(j)
        return tuple((y - x) * pow(base, -i, P) % P for x, y, base in zip(a, b, BASES))

    def whole(self) -> str:
        a, b = self.prefix(len(self))
        return f"{a:08x}{b:08x}{len(self):010x}"


def same(a: PrefixHash, i: int, b: PrefixHash, j: int, n: int) -> bool:
    return i + n <= len(a) and j + n <= len(b) and a.span(i, i + n) == b.span(j, j + n)


def extension(a: PrefixHash, i: int, b: PrefixHash, j: int) -> int:
    """How many code points from position i of a and j of b on agree."""
    low, high = 0, min(len(a) - i, len(b) - j)
    while low < high:
        mid = (low + high + 1) // 2
        if same(a, i, b, j, mid):
            low = mid
        else:
            high = mid - 1
    return low


def _least(codes: np.ndarray) -> np.ndarray:
    """Per slot the smallest mixed hash of a span of WIDTH code points; all ones where there is none."""
    out = np.full(SLOTS, np.iinfo(np.uint64).max, _U)
    n = len(codes)
    if not n:
        return out
    width = min(n, next((w for below, w in SHORT if n < below), WIDTH))
    for a in range(0, n - width + 1, BLOCK):
        part = codes[a : a + BLOCK + width - 1]
        pre = _prefix(part, 0)
        h = _mod(_mod(pre[width:] + _U(P) - pre[:-width]) * INV[: len(pre) - width])
        h = (h + _U(1)) * _U(0x9E3779B97F4A7C15)
        h ^= h >> _U(29)
        h *= _U(0xBF58476D1CE4E5B9)
        h ^= h >> _U(32)
        slot = (h & _U(SLOTS - 1)).astype(np.intp)
        if len(h) > 32 * SLOTS:  # the smallest are far below this bound, nearly always
            low = h < _U(min((1 << 64) - 1, (1 << 64) // len(h) * 16 * SLOTS))
            few = np.full(SLOTS, np.iinfo(np.uint64).max, _U)
            np.minimum.at(few, slot[low], h[low])
            if (few != np.iinfo(np.uint64).max).all():
                np.minimum(out, few, out=out)
                continue
        np.minimum.at(out, slot, h)
    return out


def fingerprint(text: str | PrefixHash) -> str:
    """38 hex digits of the whole, then 4 for each slot (---- where no span falls)."""
    own = text if isinstance(text, PrefixHash) else PrefixHash(text)
    least = _least(own.codes)
    none = np.iinfo(np.uint64).max
    return own.whole() + ":" + "".join("----" if x == none else f"{(int(x) >> 7) & 0xFFFF:04x}" for x in least)


def likeness(a: str, b: str) -> float:
    """Of two fingerprints, 0 to 1."""
    if a == b:
        return 1.0
    x, y = a.partition(":")[2], b.partition(":")[2]
    pairs = [(x[i : i + 4], y[i : i + 4]) for i in range(0, len(x), 4)]
    used = [(p, q) for p, q in pairs if p != "----" or q != "----"]
    if not used:
        return 0.0
    jaccard = sum(p == q for p, q in used) / len(used)
    return 2 * jaccard / (1 + jaccard)


def edited(text: str, following: str) -> str:
    """The last half of the text (rounded down) replaced by as much of the start of the next."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _tops(batches: Iterator[pa.RecordBatch], bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(range, top): the largest id of this task in each range."""
    top: dict[int, int] = {}
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        part = np.searchsorted(bounds, keys, side="right")
        order = np.lexsort((keys, part))
        last = np.flatnonzero(np.diff(part[order], append=-1))
        for p, k in zip(part[order][last].tolist(), keys[order][last].tolist()):
            top[p] = max(top.get(p, k), k)
    yield pa.record_batch([pa.array(list(top), pa.int32()), pa.array(list(top.values()), pa.int64())], names=["range", "top"])


def _deal(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Rows by range of id; the first document of a range also goes to the range before as a guest."""
    bounds, guests = shared.value  # guests: id -> part
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        packed = [press.compress(t.as_buffer() or b"") if t.is_valid else press.compress(b"") for t in batch.column(2)]
        part = np.searchsorted(bounds, keys, side="right").tolist()
        null = batch.column(1).is_null().to_pylist()
        rows = [(p, False, k, n, z) for p, k, n, z in zip(part, keys.tolist(), null, packed)]
        rows += [(guests[k], True, k, n, z) for _, _, k, n, z in rows if k in guests]
        cols = list(zip(*rows)) if rows else [[]] * 5
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.bool_(), pa.int64(), pa.bool_(), pa.binary()))], names=["part", "guest", "key", "anon", "z"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by part, own rows first, then by falling id: each is compared with the row behind it."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_prefix"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
    press = zstandard.ZstdDecompressor()
    before = None  # part, key, anon, text, hash, fingerprint of the row that waits for its next

    def row(a, text: str, fp: str) -> tuple:
        new = edited(a[3], text)
        hashed = PrefixHash(new)
        efp = fingerprint(hashed)
        return (None if a[2] else a[1], len(a[3]), hashlib.sha256(new.encode()).hexdigest(), a[5], efp, likeness(a[5], efp), likeness(a[5], fp), extension(a[4], 0, hashed, 0))

    for batch in batches:
        out = []
        for part, guest, key, anon, z in zip(*(batch.column(i).to_pylist() for i in range(5))):
            text = press.decompress(z).decode() if z else ""
            if before is None and guest:
                continue
            hashed = PrefixHash(text)
            fp = fingerprint(hashed)
            if before is not None:
                out.append(row(before, text, fp))
            before = None if guest else (part, key, anon, text, hashed, fp)
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


def fingerprints(docs: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, common_prefix.

    The next document is the next smaller id; after the last comes the first. Ids are cut
    into ranges, and the document that follows a range is sent to it as well, so no task
    sees more than its range. A null text is an empty one. Null ids come after all others;
    rows of one id follow each other in an order that is fixed but has no meaning, and a
    document alone is its own next. Other columns are not read; an empty table gives an
    empty table.
    """
    spark = docs.sparkSession
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long"
    last = -(1 << 63)
    key = F.coalesce(F.col(doc).cast("long"), F.lit(last))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = docs.select(key.alias("key"))
    if not ids.take(1):
        return spark.createDataFrame([], schema)
    cuts = ids.select(F.col("key").cast("double").alias("key")).approxQuantile("key", [i / (4 * parts) for i in range(1, 4 * parts)], 0.1 / (4 * parts))
    bounds = np.unique(np.array([int(c) for c in cuts], np.int64))
    # at most 4 x parts ranges: the largest id of each
    heads = {}
    found = ids.mapInArrow(lambda it: _tops(it, bounds), "range int, top long").groupBy("range").agg(F.max("top").alias("top")).collect()
    ranges = sorted(((r["range"], r["top"]) for r in found), reverse=True)
    for (_, top), (to, _) in zip(ranges, [ranges[-1], *ranges[:-1]]):
        heads[top] = to
    shared = spark.sparkContext.broadcast((bounds, heads))
    dealt = docs.select(key.alias("key"), F.col(doc).cast("long").alias("d"), F.col(text).cast("binary").alias("t")).mapInArrow(lambda it: _deal(it, shared), "part int, guest boolean, key long, anon boolean, z binary")
    ordered = dealt.repartition(parts, "part").sortWithinPartitions("part", "guest", F.desc("key"), "z")
    return ordered.mapInArrow(_compare, schema)
