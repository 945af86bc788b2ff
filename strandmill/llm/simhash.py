"""SimHash near-dedup by deletion variants.

A fingerprint of 64 bits is cut into two segments of 32. Of two fingerprints that
differ in at most three bits one segment differs in at most one, so both have, for
that segment, a variant in common in which one bit is a wildcard. The 64 variants of
every different fingerprint are the index; rows of one variant are met in one sorted
run and verified. Instead of all pairs a run gives the edges of a spanning forest,
which is all that components need and is never longer than the run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .components import components
from .skew import lookup

#: Beyond so many fingerprints in one run neighbours are looked up by flipping bits,
#: which is linear in the run, and no longer by comparing each with each.
DENSE = 20_000


def fingerprint(text: bytes | None, size: int = 3) -> int:
    """SimHash of the word shingles of a text; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - size + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(size, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        part = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[at : at + (1 << 15)], ends[at : at + (1 << 15)])), np.uint64)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def _prints(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t.as_py(), size) for t in batch.column(1)], np.uint64).view(np.int64)
        yield pa.record_batch([batch.column(0), pa.array(found)], names=["doc", "fp"])


def fingerprints(docs: DataFrame, text: str = "text", doc: str = "doc_id", size: int = 3) -> DataFrame:
    """(doc, fp): a row per row of ``docs``, fp as a signed long."""
    return docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).cast("binary").alias("t")).mapInArrow(lambda it: _prints(it, size), "doc long, fp long")


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def variants(fps: DataFrame) -> DataFrame:
    """(key, fp, ...): one row per segment and wildcard. key: segment, wildcard, the segment with that bit off."""
    which = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("w")
    seg = F.expr("CASE WHEN w < 32 THEN fp & 4294967295L ELSE shiftrightunsigned(fp, 32) END")
    return fps.select(*fps.columns, which).select((F.col("w").cast("long") * F.lit(1 << 32) + seg.bitwiseAND(F.expr("~shiftleft(1L, w % 32)"))).alias("key"), *fps.columns)


#: Six groups of the bits of a segment, by threes: three differing bits leave three groups untouched.
_GROUPS = [0x1F << s for s in (0, 5, 10, 15)] + [0x3F << s for s in (20, 26)]
_THREES = [_GROUPS[i] | _GROUPS[j] | _GROUPS[k] for i in range(6) for j in range(i) for k in range(j)]


def _finer(rows: DataFrame) -> DataFrame:
    """Runs of one variant cut by three groups of the bits of the other segment, in all 20 ways; of one key at most 2^17 fingerprints are left."""
    other = F.expr("CASE WHEN key < 137438953472L THEN shiftrightunsigned(fp, 32) ELSE fp & 4294967295L END")
    cut = rows.withColumn("mask", F.explode(F.array(*[F.lit(m).cast("long") for m in _THREES])))
    return cut.select(F.xxhash64("key", "mask", other.bitwiseAND(F.col("mask"))).alias("key"), *[c for c in rows.columns if c != "key"])


def _dense(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning edges (positions) of the graph that links at ``radius`` bits or fewer: each one looks at those not reached yet."""
    out = []
    left = np.arange(len(fps))
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(fps[left] ^ fps[x]) <= radius
            if near.any():
                new = left[near]
                out.extend((x, y) for y in new)
                front.extend(new)
                left = left[~near]
    return out


def _flipped(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """The same for large runs: looks up every fingerprint within ``radius`` flips of the bits in which the run varies."""
    order = np.argsort(fps)
    srt = fps[order]
    free = [np.uint64(1 << b) for b in range(64) if len(np.unique((fps >> np.uint64(b)) & np.uint64(1))) > 1]
    label = np.arange(len(fps))
    out = []

    def masks(at: int, mask: np.uint64, deep: int):
        for i in range(at, len(free)):
            m = mask ^ free[i]
            yield m
            if deep > 1:
                yield from masks(i + 1, m, deep - 1)

    def root(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for m in masks(0, np.uint64(0), radius):
        to = srt ^ m
        at = np.minimum(np.searchsorted(srt, to), len(srt) - 1)
        for i in np.flatnonzero((srt[at] == to) & (srt < to)):
            a, b = root(i), root(at[i])
            if a != b:
                label[max(a, b)] = min(a, b)
                out.append((order[a], order[b]))
    return out


def spanning(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    return _dense(fps, radius) if len(fps) <= DENSE else _flipped(fps, radius)


def _edges(parts: list[pa.RecordBatch], radius: int) -> pa.RecordBatch | None:
    """Edges of the whole runs in ``parts`` (key, fp, name of the fingerprint), which are sorted by key."""
    keys, fps, names = (np.concatenate([p.column(i).to_numpy(zero_copy_only=False) for p in parts]) for i in range(3))
    fps = fps.view(np.uint64)
    cuts = np.flatnonzero(np.diff(keys)) + 1
    a, b = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)]))
    size = b - a
    two = a[size == 2]
    ok = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= radius]
    u, v = [names[ok]], [names[ok + 1]]
    for i, j in zip(a[size > 2], b[size > 2]):
        _, first = np.unique(fps[i:j], return_index=True)
        found = spanning(fps[i:j][first], radius)
        if found:
            pos = first[np.array(found)] + i
            u.append(names[pos[:, 0]])
            v.append(names[pos[:, 1]])
    u, v = np.concatenate(u), np.concatenate(v)
    return pa.record_batch([pa.array(u), pa.array(v), pa.nulls(len(u), pa.int64()), pa.nulls(len(u), pa.int64())], names=["u", "v", "key", "fp"]) if len(u) else None


def _links(batches: Iterator[pa.RecordBatch], radius: int, hot: int | None) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of runs; rows come sorted by key. Of a run of more than ``hot`` the rows are passed on (u, key, fp)."""

    def onward(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([part.column(2), pa.nulls(len(part), pa.int64()), part.column(0), part.column(1)], names=["u", "v", "key", "fp"])

    held: list[pa.RecordBatch] = []  # the run that may go on
    n, key, over = 0, None, False
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        if over:
            same = int(np.searchsorted(keys, key, "right"))
            if same:
                yield onward(batch.slice(0, same))
                batch, keys = batch.slice(same), keys[same:]
        if not len(keys):
            continue
        over = False
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut or key != keys[-1]:
            whole = [*held, batch.slice(0, cut)]
            held, n, key = [], 0, keys[-1]
            if any(map(len, whole)) and (out := _edges(whole, radius)):
                yield out
        held.append(batch.slice(cut))
        n += len(keys) - cut
        if hot and n > hot:
            yield from map(onward, held)
            held, n, over = [], 0, True
    if held and (out := _edges(held, radius)):
        yield out


def link(fps: DataFrame, radius: int = 3, hot: int = DENSE) -> DataFrame:
    """Edges (u, v) that connect all fingerprints (column fp, different ones) within ``radius`` <= 3 bits.

    The ends are fingerprints or, where ``fps`` has a column node, those. Runs of more than
    ``hot`` rows are dealt out again by bits of the other segment, so that no task holds them.
    """
    if radius > 3:
        raise ValueError("two segments with one wildcard find at most three differing bits")
    parts = max(1, int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    named = "node" in fps.columns

    def met(rows: DataFrame, most: int | None) -> DataFrame:
        ordered = rows.repartition(parts, "key").sortWithinPartitions("key").select("key", "fp", *["node"] * named)

        def run(it):
            yield from _links((b if named else pa.record_batch([b.column(0), b.column(1), b.column(1)], names=["key", "fp", "node"]) for b in it), radius, most)

        return ordered.mapInArrow(run, "u long, v long, key long, fp long")

    found = scratch.keep(met(variants(fps), hot), "met")
    edges = found.filter("key is null").select("u", "v")
    long_runs = found.filter("key is not null")
    if not long_runs.take(1):
        return edges
    return edges.unionByName(met(_finer(long_runs.select("key", "fp", *[F.col("u").alias("node")] * named)), None).select("u", "v"))


def near_duplicates(docs: DataFrame, text: str = "text", doc: str = "doc_id", size: int = 3, radius: int = 3) -> DataFrame:
    """(doc, fp, component): per row of ``docs`` its fingerprint and the smallest id reachable.

    Texts without words (null, empty, blank) have fingerprint zero and link like any other.
    Repeated rows of an id get equal results. A null id names no component: its row gets
    that of its fingerprint, null if all ids there are null. Other columns are not read.
    An empty table gives an empty table.
    """
    prints = scratch.keep(fingerprints(docs, text, doc, size), "prints")
    classes = scratch.keep(prints.groupBy("fp").agg(F.min("doc").alias("least"), F.count("*").alias("n")), "classes")
    joint = components(link(classes.select("fp"), radius))
    member = classes.join(joint.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    member = scratch.keep(member, "member")
    least = member.groupBy("component").agg(F.min("least").alias("component_id"), F.sum("n").alias("all"), F.count("*").alias("size"))
    shared = lookup(member.select("fp", "n", "component"), least.filter(F.col("all") > 1).drop("all"), "component", "size", member.count())
    shared = scratch.keep(shared.select("fp", "n", "component_id"), "shared")
    scratch.drop(classes, member)
    out = lookup(prints, shared, "fp", "n", prints.count(), "left")
    return out.select("doc", "fp", F.coalesce("component_id", "doc").alias("component"))


# Near copies by similarity. Two texts that share four fifths of their word shingles
# differ in some 15 of 100 bits, too many for deletion variants and too vague for a longer
# SimHash. Their sets of shingles have a band of minima in common instead (MinHash), which
# only proposes: the sets of those that meet are compared, and the edges of a spanning
# forest leave a run.

BANDS, ROWS = 20, 3


def majority(rows: np.ndarray) -> np.ndarray:
    """Per bit of the rows (n, words) whether over half have it, counted by carry-save adders on whole words."""
    n = len(rows)
    total = np.zeros(rows.shape[1] * 64, np.int64)
    weight = 0
    while len(rows):
        carries = []
        while len(rows) > 2:
            m = len(rows) // 3
            x, y, z = rows[:m], rows[m : 2 * m], rows[2 * m : 3 * m]
            half = x ^ y
            carries.append((x & y) | (z & half))
            rows = np.concatenate((half ^ z, rows[3 * m :]))
        total += np.unpackbits(np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little").sum(0, dtype=np.int64) << weight
        rows = np.concatenate(carries) if carries else rows[:0]
        weight += 1
    return np.packbits(total * 2 > n, bitorder="little").view(np.uint64)


_ODD = (np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(text: bytes | None, size: int = 5) -> np.ndarray:
    """The different hashes of the word shingles of a text, sorted; fewer words than ``size`` are one shingle, none give none."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - size + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(size, len(words)) - 1 :].tolist()
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b]) for a, b in zip(starts, ends)), np.uint64, n))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key per band: of ROWS minima of the set under as many orders."""
    low = np.full(len(_ODD), ~np.uint64(0))
    for at in range(0, len(hashes), 1 << 12):
        x = hashes[None, at : at + (1 << 12)] * _ODD[:, None]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        np.minimum(low, x.min(1), out=low)
    low = low.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        key = (key ^ low[:, i]) * np.uint64(0x94D049BB133111EB)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def set_id(hashes: np.ndarray) -> int | None:
    """64 bits, as a signed long, that name the set; null for none."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).view(np.int64)) if len(hashes) else None


def _set_prints(batches: Iterator[pa.RecordBatch], short: int, size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps, ids, keys = [], [], []
        for t in batch.column(1):
            t = t.as_py()
            h = shingles(t, size)
            fps.append(fingerprint(t, short))
            ids.append(set_id(h))
            keys.append(bands(h) if len(h) else None)
        yield pa.record_batch([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(ids, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc", "fp", "id", "keys"])


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingles(t.as_py(), size) for t in batch.column(0)]
        yield pa.record_batch([pa.array([set_id(h) for h in found], pa.int64()), pa.array([h.tobytes() for h in found], pa.binary())], names=["id", "hashes"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list]]:
    """(keys, other columns) of whole runs; rows come sorted by key, and parts of a run are put together once."""
    held = []
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        if not len(keys):
            continue
        cut = int(np.searchsorted(keys, keys[-1]))
        if held and (cut or keys[-1] != held[-1].column(0)[-1].as_py()):
            held.append(batch.slice(0, cut))
            yield pa.Table.from_batches(held)
            held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(run, size, id, doc) of the runs of more than one, which come sorted by key and id; runs of the same members get one name."""
    for table in _runs(batches):
        keys, ids, docs = (table.column(i).to_numpy() for i in range(3))
        cut = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]))
        size = np.diff(cut)
        some = np.flatnonzero(size > 1)
        if len(some):
            names = np.array([xxhash.xxh3_64_intdigest(ids[cut[i] : cut[i + 1]].tobytes()) for i in some], np.uint64).view(np.int64)
            many = np.repeat(size > 1, size)
            yield pa.record_batch([pa.array(np.repeat(x, size[some])) for x in (names, size[some])] + [pa.array(ids[many]), pa.array(docs[many])], names=["run", "size", "id", "doc"])


def enough(common: np.ndarray, a, b, least: float, measure: str) -> np.ndarray:
    """Whether ``common`` members of sets of ``a`` and ``b`` are a likeness of ``least``: the Jaccard one, or the cosine of the sets."""
    return common >= (least * (a + b - common) if measure == "jaccard" else least * np.sqrt(np.asarray(a * b, float))) - 1e-9


def alike(sets: list[np.ndarray], least: float, measure: str = "jaccard") -> list[tuple[int, int]]:
    """Spanning edges (positions) of the graph that links sets of a likeness of ``least`` or more."""
    size = np.array([len(s) for s in sets])
    which, flat = np.unique(np.concatenate(sets), return_inverse=True)
    parts = np.split(flat, np.cumsum(size)[:-1])
    mask = np.zeros(len(which), bool)
    out = []
    left = held = np.arange(len(sets))
    starts = np.concatenate(([0], np.cumsum(size)[:-1]))
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            if 2 * len(left) < len(held):  # those reached are no longer counted
                held = left
                flat = np.concatenate([parts[i] for i in held])
                starts = np.concatenate(([0], np.cumsum(size[held])[:-1]))
            mask[parts[x]] = True
            common = np.add.reduceat(mask[flat], starts, dtype=np.int64)[np.searchsorted(held, left)]
            mask[parts[x]] = False
            hit = enough(common, size[x], size[left], least, measure)
            if hit.any():
                new = left[hit]
                out.extend((x, y) for y in new)
                front.extend(new)
                left = left[~hit]
    return out


def _verified(batches: Iterator[pa.RecordBatch], least: float, measure: str) -> Iterator[pa.RecordBatch]:
    """Edges between documents (run, doc, hashes), sorted by run."""
    for table in _runs(batches):
        keys, docs = (table.column(i).to_numpy() for i in (0, 1))
        raw = table.column(2)
        cut = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]))
        u, v = [], []
        for a, b in zip(cut[:-1], cut[1:]):
            if b - a > 1:
                for i, j in alike([np.frombuffer(r.as_py(), np.uint64) for r in raw[int(a) : int(b)]], least, measure):
                    u.append(docs[a + i])
                    v.append(docs[a + j])
        if u:
            yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _to_pivot(batches: Iterator[pa.RecordBatch], least: float, measure: str) -> Iterator[pa.RecordBatch]:
    """(run, id, doc, pivot, near): whether the set is alike to that of the first of its run."""
    for batch in batches:
        near = []
        for own, first in zip(batch.column(4), batch.column(5)):
            x, y = (np.frombuffer(s.as_py(), np.uint64) for s in (own, first))
            near.append(bool(enough(np.int64(len(np.intersect1d(x, y, assume_unique=True))), len(x), len(y), least, measure)))
        yield pa.record_batch([*(batch.column(i) for i in range(4)), pa.array(near, pa.bool_())], names=["run", "id", "doc", "pivot", "near"])


def _crowded(big: DataFrame, hashes: DataFrame, least: float, measure: str, hot: int, parts: int) -> tuple[DataFrame, DataFrame]:
    """Of runs too long for a task: edges to the run's first member, and rows (run, doc, hashes) still to be compared.

    All that are alike to the first are of its component and need no comparison among
    themselves. Those that are not meet all others of the run, in pairs of blocks.
    """
    salts = F.ceil(F.col("size") / hot).cast("int")
    pivots = big.groupBy("run").agg(F.min(F.struct("id", "doc")).alias("p"), F.max("size").alias("size"))
    pivots = pivots.select("run", F.col("p.id").alias("id"), F.col("p.doc").alias("pivot"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    pivots = pivots.join(hashes, "id").select("run", "salt", "pivot", F.col("hashes").alias("first"))
    met = big.withColumn("salt", F.pmod(F.xxhash64("id"), salts).cast("int")).join(hashes, "id").join(pivots, ["run", "salt"])
    judged = scratch.keep(met.select("run", "id", "doc", "pivot", "hashes", "first").mapInArrow(lambda it: _to_pivot(it, least, measure), "run long, id long, doc long, pivot long, near boolean"), "judged")
    edges = judged.filter("near").select(F.col("doc").alias("u"), F.col("pivot").alias("v"))
    counts = judged.groupBy("run").agg(F.count("*").alias("n"), F.count_if(~F.col("near")).alias("far")).filter("far > 0")
    blocks = counts.select("run", "n", F.ceil(F.col("n") / hot).cast("int").alias("all"), F.ceil(F.col("far") / hot).cast("int").alias("odd"))
    rows = lookup(judged, blocks, "run", "n", judged.count())
    own = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    span = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    far = rows.filter(~F.col("near")).withColumn("i", own("odd")).withColumn("j", span("all"))
    each = rows.withColumn("j", own("all")).withColumn("i", span("odd"))
    dealt = far.select("run", "i", "j", "id", "doc").unionByName(each.select("run", "i", "j", "id", "doc")).distinct()
    return edges, dealt.join(hashes, "id").select(F.xxhash64("run", "i", "j").alias("run"), "doc", "hashes")


#: So many ids of documents to compare are sent to every task; more are joined.
MOST_SENT = 1_000_000
#: Longer runs of a band are cut.
CROWD = 8192


def near_copies(docs: DataFrame, text: str = "text", doc: str = "doc_id", short: int = 3, radius: int = 3, size: int = 5, least: float = 0.8, measure: str = "jaccard", crowd: int = CROWD, most_sent: int = MOST_SENT) -> DataFrame:
    """(node, component): documents with near copies and the smallest id reachable.

    Documents link if their fingerprints of ``short``-word shingles differ in ``radius`` bits
    or fewer (deletion variants), or if their sets of ``size``-word shingles have a likeness
    of ``least`` or more, which is the Jaccard one or, with ``measure`` cosine, the one that
    SimHash estimates: equal sets always, others if they share a band, which proposes them,
    and the comparison of the sets themselves confirms it. Runs of more than ``crowd`` sets
    are dealt to several tasks. Null ids are left out, null texts have no words; an empty
    table, and documents without copies, give no rows; repeated rows of an id are one node.
    Other columns are not read, so their names may be any.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.filter(F.col(doc).isNotNull()).select(F.col(doc).cast("long").alias("doc"), F.col(text).cast("binary").alias("t"))
    prints = scratch.keep(rows.mapInArrow(lambda it: _set_prints(it, short, size), "doc long, fp long, id long, keys array<long>"), "prints")
    total = prints.count()
    fps = scratch.keep(prints.groupBy("fp").agg(F.min("doc").alias("least"), F.count("*").alias("n")), "classes")
    edges = [link(fps.select("fp", F.col("least").alias("node")), radius)]
    sets = scratch.keep(prints.filter("id IS NOT NULL").groupBy("id").agg(F.min("doc").alias("least"), F.count("*").alias("n"), F.first("keys").alias("keys")), "sets")
    dealt = sets.select(F.explode("keys").alias("key"), "id", F.col("least").alias("doc")).repartition(parts, "key").sortWithinPartitions("key", "id")
    met = scratch.keep(dealt.mapInArrow(_meetings, "run long, size long, id long, doc long").distinct(), "met")
    written = [prints, fps, sets, met]
    asked = scratch.keep(met.select("doc").distinct(), "asked")
    written.append(asked)
    if asked.count() <= most_sent:
        asked = F.broadcast(asked)
    hashes = rows.join(asked, "doc", "left_semi").select("t").mapInArrow(lambda it: _sets(it, size), "id long, hashes binary").dropDuplicates(["id"])
    big = met.filter(F.col("size") > crowd)
    if big.take(1):
        hashes = scratch.keep(hashes, "hashes")
        written.append(hashes)
        some, more = _crowded(big, hashes, least, measure, crowd, parts)
        edges += [some, more.repartition(parts, "run").sortWithinPartitions("run").mapInArrow(lambda it: _verified(it, least, measure), "u long, v long")]
    paired = met.filter(F.col("size") <= crowd).join(hashes, "id").select("run", "doc", "hashes").repartition(parts, "run").sortWithinPartitions("run")
    edges.append(paired.mapInArrow(lambda it: _verified(it, least, measure), "u long, v long"))
    edges.append(lookup(prints.select("doc", "fp"), fps, "fp", "n", total).filter("doc <> least").select(F.col("doc").alias("u"), F.col("least").alias("v")))
    edges.append(lookup(prints.filter("id IS NOT NULL").select("doc", "id"), sets.select("id", "least", "n"), "id", "n", total).filter("doc <> least").select(F.col("doc").alias("u"), F.col("least").alias("v")))
    every = edges[0]
    for e in edges[1:]:
        every = every.unionByName(e)
    out = components(every)
    scratch.drop(*written)
    return out
