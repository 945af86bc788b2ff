"""SentencePiece encoding and decoding.

Best path (unigram scoring): a max-plus scan. The state at a boundary is how far the
piece that covers it reaches beyond, so a chunk of a document gives a small matrix of
best scores from state to state. The matrices of neighbouring chunks are combined by
max-plus products in a tree, level by level; from its root the states at all boundaries
follow downward, and with them each chunk is traced back on its own. A text of one chunk
has state 0 at both ends and needs no matrix.

No piece crosses a place where two characters meet that stand together in no piece.
Between two such cuts lies a unit; at a cut the state is 0, so a unit's matrix is a
single number. Scores and ids of units are remembered, and a chunk's matrix is put
together from what leads to its first cut, the units, and what follows its last cut.

Merges (BPE models): ids of such a model are not a best path. The library merges the
units, each of which belongs to the chunk in which it starts.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

MARK = "▁"
#: Fixed value: what a character that no piece covers costs below the least score.
PENALTY = 10.0
_MOST = 240_000
#: Characters of short texts that are encoded together.
_AT_ONCE = 1 << 18
BETWEEN = re.compile(r"(?<=[0-9A-Za-z]) (?=[0-9A-Za-z])")
_NONE = float("-inf")


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a serialized message."""
    at = 0

    def number() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = raw[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(raw):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        elif kind == 2:
            size = number()
            yield tag >> 3, raw[at : at + size]
            at += size
        else:
            size = 8 if kind == 1 else 4
            yield tag >> 3, raw[at : at + size]
            at += size


class Pieces:
    """A model file: its pieces, scores and scheme, and what was encoded before."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        sp = self.sp
        trainer = next((v for k, v in _fields(sp.serialized_model_proto()) if k == 2), b"")
        self.merges = next((v for k, v in _fields(trainer) if k == 3), 1) == 2
        n = sp.get_piece_size()
        self.names = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = {int(self.names[i][3:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.score = {self.names[i]: (sp.get_score(i), i) for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.unknown = min((s for s, _ in self.score.values()), default=0.0) - PENALTY
        self.reach = max(map(len, self.score), default=1)
        used = set("".join(self.score))
        self.alone = next(c for c in map(chr, range(0xE000, 0xF8FF)) if c not in used)  # a character that no piece has
        self.skip = len(sp.encode(self.alone))
        self.value = {i: b for b, i in self.bytes.items()}
        self.high = {i for i, b in self.value.items() if b > 127}
        self.shown = [chr(self.value[i]) if self.value.get(i, 255) < 128 else p.replace(MARK, " ") for i, p in enumerate(self.names)]
        self.known: dict[str, tuple[bytes, bytes, float]] = {}

    @cached_property
    def trie(self) -> dict:
        """Character: (score of the piece that ends here, minus infinity if none does, what follows, the piece's id)."""
        top: dict = {}
        for p, (score, number) in sorted(self.score.items()):
            node = top
            for c in p[:-1]:
                if c not in node:
                    node[c] = (_NONE, {}, -1)
                node = node[c][1]
            node[p[-1]] = (score, node[p[-1]][1] if p[-1] in node else {}, number)
        return top

    @cached_property
    def together(self) -> np.ndarray:
        """Pairs of characters that stand together in some piece, by hash; another pair may pass for one, which only misses a cut."""
        out = np.zeros(1 << 20, bool)
        for p in self.score:
            if len(p) > 1:
                out[self._pairs(p)] = True
        return out

    def normal(self, text: str) -> str:
        """With space marks, as the model sees it; empty for an empty text."""
        return self.sp.normalize(text) if text else ""

    def arcs(self, s: str, i: int) -> list[tuple[int, float]]:
        """(end, score) of what may stand at i; a single character always may."""
        out = []
        node, j = self.trie, i
        for c in s[i : i + self.reach]:
            hit = node.get(c)
            if hit is None:
                break
            j += 1
            if hit[0] != _NONE:
                out.append((j, hit[0]))
            node = hit[1]
        if not out or out[0][0] > i + 1:
            out.insert(0, (i + 1, self.unknown))
        return out

    def ids(self, piece: str) -> list[int]:
        hit = self.score.get(piece)
        if hit:
            return [hit[1]]
        return [self.bytes[b] for b in piece.encode()] if self.bytes else [self.sp.unk_id()]

    def best(self, s: str, start: int = 0, end: int | None = None) -> tuple[list[str], float]:
        """The best path from ``start`` to ``end``; the later of two equal arcs loses."""
        end = len(s) if end is None else end
        top = [_NONE] * (end - start + 1)
        back = [0] * (end - start + 1)
        top[0] = 0.0
        trie, unknown, reach = self.trie, self.unknown, self.reach
        part = s if end - start == len(s) else s[start:end]
        for i in range(end - start):
            own = top[i]
            node, j = trie, i
            for c in part[i : i + reach]:
                hit = node.get(c)
                if hit is None:
                    break
                j += 1
                score, node, _ = hit
                score += own
                if score > top[j]:
                    top[j] = score
                    back[j] = i
            if own + unknown > top[i + 1] and trie.get(part[i], (_NONE,))[0] == _NONE:
                top[i + 1] = own + unknown
                back[i + 1] = i
        out, j = [], end - start
        while j:
            out.append(s[start + back[j] : start + j])
            j = back[j]
        return out[::-1], top[-1]

    def path(self, unit: str) -> tuple[bytes, float]:
        """Ids and score of the best path, as ``best`` finds it."""
        n, trie, unknown = len(unit), self.trie, self.unknown
        top, back, number = [_NONE] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        top[0] = 0.0
        for i, c in enumerate(unit):
            own, hit, j = top[i], trie.get(c), i + 1
            if (hit is None or hit[0] == _NONE) and own + unknown > top[j]:
                top[j], back[j], number[j] = own + unknown, i, -1
            while hit is not None:
                score = hit[0] + own
                if score > top[j]:
                    top[j], back[j], number[j] = score, i, hit[2]
                if j == n:
                    break
                hit = hit[1].get(unit[j])
                j += 1
        out, j = [], n
        while j:
            i = back[j]
            if number[j] < 0:
                out += reversed(self.ids(unit[i:j]))
            else:
                out.append(number[j])
            j = i
        return array("I", out[::-1]).tobytes(), top[n]

    def merge(self, units: list[str]) -> list[bytes]:
        """Ids of the model's own scheme by unit; behind a character that joins nothing the library puts no space mark."""
        asked = [u[1:].replace(MARK, " ") if u[0] == MARK else self.alone + u.replace(MARK, " ") for u in units]
        own = (self.score[MARK][1],) if MARK in self.score else ()
        got = self.sp.encode(asked, num_threads=1)
        return [array("I", own if u == MARK and own else ids if u[0] == MARK else ids[self.skip :]).tobytes() for u, ids in zip(units, got)]

    def learn(self, units: list[str]) -> dict[str, tuple[bytes, bytes, float]]:
        """By unit the ids of the model's scheme, ids and score of the best path; remembered until enough is."""
        paths = [self.path(u) for u in units]
        merged = self.merge(units) if self.merges else [p[0] for p in paths]
        out = {u: (m, *p) for u, m, p in zip(units, merged, paths)}
        if len(self.known) < _MOST:
            self.known.update((u, x) for u, x in out.items() if len(u) <= 64)
        return out

    @staticmethod
    def _pairs(s: str) -> np.ndarray:
        c = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
        return (c[:-1] * np.uint32(0x9E3779B1) ^ c[1:] * np.uint32(0x85EBCA6B)) >> np.uint32(12)

    def cuts(self, s: str) -> np.ndarray:
        """Positions in a string that no piece can cross, because no piece has the two characters there together."""
        if len(s) < 2:
            return np.empty(0, np.int64)
        return np.flatnonzero(~self.together[self._pairs(s)]) + 1

    def units(self, s: str) -> list[str]:
        at = self.cuts(s).tolist()
        return [s[i:j] for i, j in zip([0, *at], [*at, len(s)])] if s else []

    def resolve(self, units: list[str]) -> list[tuple[bytes, bytes, float]]:
        got = list(map(self.known.get, units))
        gaps = [i for i, x in enumerate(got) if x is None]
        if gaps:
            new = self.learn(list({units[i] for i in gaps}))
            for i in gaps:
                got[i] = new[units[i]]
        return got

    def encode(self, s: str) -> tuple[bytes, bytes, float]:
        """Of a normal string: ids of the model's scheme, ids and score of the best path."""
        return self.encode_all([s])[0]

    def encode_all(self, strings: list[str]) -> list[tuple[bytes, bytes, float]]:
        """The same of several; units of theirs that are not known yet are learned at once, each a single time."""
        units = [self.units(s) for s in strings]
        got = [list(map(self.known.get, u)) for u in units]
        gaps = [None in g for g in got]
        new = self.learn(list({u for us, g, gap in zip(units, got, gaps) if gap for u, x in zip(us, g) if x is None})) if any(gaps) else {}
        out = []
        for us, g, gap in zip(units, got, gaps):
            found = [new[u] if x is None else x for u, x in zip(us, g)] if gap else g
            ids, best, scores = zip(*found) if found else ((), (), ())
            out.append((b"".join(ids), b"".join(best), float(sum(scores))))
        return out

    def encode_best(self, s: str) -> tuple[bytes, float]:
        return self.encode(s)[1:]

    def encode_merged(self, s: str) -> bytes:
        return self.encode(s)[0]

    def decode(self, ids: bytes) -> str:
        numbers = array("I", ids)
        if self.high.isdisjoint(numbers):
            text = "".join(map(self.shown.__getitem__, numbers))
        else:
            out, held = [], bytearray()
            for i in numbers:
                if i in self.value:
                    held.append(self.value[i])
                    continue
                if held:
                    out.append(held.decode("utf-8", "replace"))
                    held.clear()
                out.append(self.shown[i])
            text = "".join(out) + held.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    def normal_parts(self, text: str, size: int) -> Iterator[str]:
        """The normal string of a text in parts, from slices of some ``size`` characters cut before a space between letters or digits."""
        lead = self.normal("a")
        at = 0
        while at < len(text):
            cut = BETWEEN.search(text, at + size)
            end = cut.start() if cut else len(text)
            yield self.normal("a" + text[at:end])[len(lead) :] if at else self.normal(text[:end])
            at = end

    def plain_transfer(self, s: str, own: int, last: bool) -> np.ndarray:
        """Best scores from state to state over the first ``own`` characters of s, which goes on behind them unless ``last``.

        State k: the piece over the boundary ends k characters behind it.
        """
        width = self.reach
        out = np.full((width, width), _NONE)
        span = own + (0 if last else min(width - 1, len(s) - own))
        top = np.full((span + 1, width), _NONE)
        for k in range(min(width, span + 1)):
            if k <= own or not last:
                top[k, k] = 0.0
        for i in range(own):
            row = top[i]
            if not np.isfinite(row).any():
                continue
            for j, score in self.arcs(s, i):
                if j <= span:
                    np.maximum(top[j], row + score, out=top[j])
        for k in range(min(width, span - own + 1)):
            out[:, k] = top[own + k]
        for k in range(own + 1, width):  # a piece may reach over the whole chunk
            if not last and k - own < width:
                out[k, k - own] = max(out[k, k - own], 0.0)
        return out


    def transfer(self, s: str, own: int, last: bool) -> np.ndarray:
        """The same matrix by way of the cuts, where there are some."""
        cuts = self.cuts(s[: own + 1])
        if last and own:
            cuts = np.append(cuts, own)
        if not len(cuts):
            return self.plain_transfer(s, own, last)
        first, end = int(cuts[0]), int(cuts[-1])
        width = self.reach
        out = np.full((width, width), _NONE)
        lead = [_NONE] * first + [0.0]  # best score from a place to the first cut
        for i in reversed(range(first)):
            lead[i] = max((score + lead[j] for j, score in self.arcs(s[:first], i)), default=_NONE)
        middle = sum(x[2] for x in self.resolve([s[i:j] for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist())]))
        span = own - end + (0 if last else width - 1)
        after = [0.0] + [_NONE] * span  # best score from the last cut on, by pieces that start in this chunk
        for i in range(own - end):
            for j, score in self.arcs(s, end + i):
                if j - end <= span:
                    after[j - end] = max(after[j - end], after[i] + score)
        into, beyond = np.array(lead[:width]), np.array(after[own - end :][:width])
        out[: len(into), : len(beyond)] = into[:, None] + middle + beyond[None, :]
        return out


_models: dict[str, Pieces] = {}


def model(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def product(matrices: list[np.ndarray]) -> np.ndarray:
    """Max-plus product, combined in pairs."""
    while len(matrices) > 1:
        pairs = [(a[:, :, None] + b[None]).max(1) for a, b in zip(matrices[::2], matrices[1::2])]
        matrices = pairs + matrices[len(pairs) * 2 :]
    return matrices[0]


def states(matrices: list[np.ndarray], enter: int = 0, leave: int = 0) -> list[int]:
    """The state at every boundary of the best path from state ``enter`` to ``leave``."""
    front = np.full(matrices[0].shape[0], _NONE)
    front[enter] = 0.0
    steps = []
    for m in matrices:
        ways = front[:, None] + m
        steps.append(ways.argmax(0))
        front = ways.max(0)
    out = [leave]
    for s in reversed(steps):
        out.append(int(s[out[-1]]))
    return out[::-1]


SCHEMA = "row long, n_ids long, ids binary, n_best long, best_ids binary, best_score double"


def _whole(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    m = model(path)
    for batch in batches:
        rows, held = [], []

        def flush():
            rows.extend((row, len(ids) // 4, ids, len(best) // 4, best, score) for (row, _), (ids, best, score) in zip(held, m.encode_all([s for _, s in held])))
            held.clear()

        chars = 0
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            held.append((row, m.normal(text.as_py() or "")))
            chars += len(held[-1][1])
            if chars >= _AT_ONCE:
                flush()
                chars = 0
        flush()
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.float64()))], names=["row", "n_ids", "ids", "n_best", "best_ids", "best_score"])


CHUNK = "row long, i long, s string, own long, skip long, until long, last boolean"


def next_cut(m: Pieces, s: str, at: int) -> int | None:
    """The first cut behind ``at``; it mostly is near, so a little is looked through first."""
    step = 256
    while at + 1 < len(s):
        found = m.cuts(s[at : at + step])
        if len(found):
            return at + int(found[0])
        at, step = at + step - 1, 4 * step
    return None


def cut_up(m: Pieces, text: str, size: int) -> Iterator[tuple[str, int, int, int, bool]]:
    """Chunks (s, own, skip, until, last) of ``size`` characters of a normal string; of s the first ``own`` are the chunk's.

    Behind them s goes on as far as a piece or a unit that starts in the chunk may reach.
    Units of the chunk lie between ``skip`` and ``until``. A unit of many chunks is whole in
    the first of them only, so a text without any cut is written about twice.
    """
    parts = m.normal_parts(text, size)
    buffer, at, skip, ended = "", 0, 0, False

    def fill(n: int, cut: bool = False) -> None:
        """At least ``n`` characters from ``at`` on, with ``cut`` as many more as it takes to a cut in what is new."""
        nonlocal buffer, at, ended
        more, have, found = [], len(buffer) - at, False
        while not ended and (have < n or cut and not found):
            part = next(parts, None)
            ended = part is None
            if part:
                found = cut and len(m.cuts((more[-1] if more else buffer)[-1:] + part)) > 0
                more.append(part)
                have += len(part)
        if more:
            buffer, at = buffer[at:] + "".join(more), 0

    fill(size + m.reach)
    while at < len(buffer):
        own = min(size, len(buffer) - at)
        if skip >= own:  # a unit that started before goes on behind this chunk
            rest = skip - own
            skip = until = own
        else:
            cut = next_cut(m, buffer, at + own - 1)
            if own < len(buffer) - at and cut is None:
                fill(len(buffer) - at, cut=True)
                cut = next_cut(m, buffer, at + own - 1)
            until = own if own == len(buffer) - at else len(buffer) - at if cut is None else cut - at
            rest = until - own
        yield buffer[at : at + max(until, own + m.reach - 1)], own, skip, until, own == len(buffer) - at
        at += own
        skip = rest
        fill(size + m.reach)


def _chunks(batches: Iterator[pa.RecordBatch], path: str, size: int) -> Iterator[pa.RecordBatch]:
    m = model(path)
    for batch in batches:
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for i, (s, own, skip, until, last) in enumerate(cut_up(m, text.as_py() or "", size)):
                yield pa.record_batch([pa.array([x]) for x in (row, i, s, own, skip, until, last)], names=["row", "i", "s", "own", "skip", "until", "last"])


def _transfers(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    m = model(path)
    for batch in batches:
        got = [m.transfer(s, own, last).tobytes() for s, own, last in zip(*(batch.column(c).to_pylist() for c in ("s", "own", "last")))]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(got, pa.binary())], names=["row", "i", "m"])


def _matrices(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions in order, and the matrices of a block in that order."""
    order = np.argsort(table.column("i").to_numpy())
    raw = table.column("m").to_pylist()
    width = int((len(raw[0]) // 8) ** 0.5)
    return order, [np.frombuffer(raw[k]).reshape(width, width) for k in order]


def _combined(table: pa.Table) -> pa.Table:
    """The product of a block's matrices."""
    _, m = _matrices(table)
    return pa.table({"row": table.column("row")[:1], "i": table.column("block")[:1], "m": pa.array([product(m).tobytes()], pa.binary())})


def _resolved(table: pa.Table) -> pa.Table:
    """The states at the boundaries in a block, of which those at its ends are known."""
    order, m = _matrices(table)
    found = states(m, table.column("enter")[0].as_py(), table.column("leave")[0].as_py())
    return pa.table({"row": table.column("row"), "i": table.column("i").take(pa.array(order)), "enter": pa.array(found[:-1], pa.int64()), "leave": pa.array(found[1:], pa.int64())})


def boundaries(matrices: DataFrame, chunks: int, fan: int) -> DataFrame:
    """(row, i, enter, leave): states of the best path, by products of ``fan`` matrices upward and their resolution downward.

    ``chunks`` is the largest number of chunks of a row; there are log(chunks) / log(fan) levels.
    """
    blocks = F.expr(f"i div {fan}").alias("block")
    levels, most = [matrices], chunks
    while most > fan:
        up = levels[-1].select("row", "i", "m", blocks).groupBy("row", "block").applyInArrow(_combined, "row long, i long, m binary")
        levels.append(scratch.keep(up, "products"))
        most = -(-most // fan)
    known = levels[-1].select("row", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("enter"), F.lit(0).cast("long").alias("leave")).distinct()
    for level in reversed(levels):
        down = level.select("row", "i", "m", blocks).join(known, ["row", "block"]).groupBy("row", "block").applyInArrow(_resolved, "row long, i long, enter long, leave long")
        known = down.withColumnRenamed("i", "block")
    return known.withColumnRenamed("block", "i")


def _trace(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Ids of the units of a chunk, and ids and score of its part of the best path."""
    m = model(path)
    for batch in batches:
        ids, best, scores = [], [], []
        for s, own, skip, until, a, b in zip(*(batch.column(batch.schema.names.index(c)).to_pylist() for c in ("s", "own", "skip", "until", "enter", "leave"))):
            ids.append(m.encode_merged(s[skip:until]) if m.merges else b"")
            raw, score = m.encode_best(s[a : own + b]) if a < own + b else (b"", 0.0)
            best.append(raw)
            scores.append(score)
        yield pa.record_batch([*(batch.column(batch.schema.names.index(c)) for c in ("row", "i")), pa.array(ids, pa.binary()), pa.array(best, pa.binary()), pa.array(scores, pa.float64())], names=["row", "i", "ids", "best_ids", "score"])


def encode(docs: DataFrame, text: str = "text", path: str | None = None, chunk: int = 1 << 15, fan: int = 16) -> DataFrame:
    """Columns of ``docs`` but the text, and ids, n_ids (the model's scheme), best_ids, n_best, best_score (the best path).

    Ids are little-endian unsigned 32-bit numbers. A text of more than ``chunk`` characters
    is dealt out in chunks of that size, however long it is; its ids come together in one
    row at the end. A null or empty text has no ids and score 0. Of paths of equal score any
    may be given. Repeated rows are encoded alike; columns of these names are replaced,
    others pass through. An empty table gives an empty table.
    """
    path = path or piece_model()
    others = [c for c in docs.columns if c not in (text, "ids", "n_ids", "best_ids", "n_best", "best_score")]
    kind = docs.schema
    from pyspark.sql import types as T

    small = docs.filter(F.coalesce(F.length(text), F.lit(0)) <= chunk)

    def direct(it):
        for batch in (whole.slice(k, 500) for whole in it for k in range(0, whole.num_rows, 500)):
            at = batch.schema.names.index(text)
            row = pa.record_batch([pa.array(range(batch.num_rows), pa.int64()), batch.column(at)], names=["row", "t"])
            out = next(_whole(iter([row]), path))
            yield pa.record_batch([batch.column(batch.schema.names.index(c)) for c in others] + out.columns[1:], names=others + out.schema.names[1:])

    tail = [T.StructField("n_ids", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("n_best", T.LongType()), T.StructField("best_ids", T.BinaryType()), T.StructField("best_score", T.DoubleType())]
    out = small.mapInArrow(direct, T.StructType([kind[c] for c in others] + tail))
    large = docs.filter(F.length(text) > chunk)
    if not large.take(1):
        return out
    large = scratch.keep(large.select(F.struct(*others).alias("__others"), F.col(text).alias("__t"), F.monotonically_increasing_id().alias("row")), "large")
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    chunks = scratch.keep(large.select("row", "__t").mapInArrow(lambda it: _chunks(it, path, chunk), CHUNK).repartition(parts, "row", "i"), "chunks")
    matrices = scratch.keep(chunks.mapInArrow(lambda it: _transfers(it, path), "row long, i long, m binary"), "matrices")
    at = boundaries(matrices, (chunks.agg(F.max("i")).first()[0] or 0) + 1, fan)
    traced = chunks.join(at, ["row", "i"]).mapInArrow(lambda it: _trace(it, path), "row long, i long, ids binary, best_ids binary, score double")
    along = lambda c: F.expr(f"coalesce(listagg({c}) WITHIN GROUP (ORDER BY i), X'')").alias(c)
    found = traced.groupBy("row").agg(along("ids"), along("best_ids"), F.sum("score").alias("best_score"))
    count = lambda c: (F.octet_length(c) / 4).cast("long")
    own = "ids" if model(path).merges else "best_ids"
    both = large.select("__others", "row").join(found, "row", "left").select("__others.*", count(own).alias("n_ids"), F.col(own).alias("ids"), count("best_ids").alias("n_best"), "best_ids", "best_score")
    return out.unionByName(both)


def decode(encoded: DataFrame, ids: str = "ids", path: str | None = None, to: str = "text") -> DataFrame:
    """``encoded`` with the text of its ids; null ids give an empty text.

    Repeated rows are decoded alike, texts of any length whole; a column called as ``to`` is
    replaced, others pass through. An empty table gives an empty table.
    """
    path = path or piece_model()
    from pyspark.sql import types as T

    kept = [c for c in encoded.columns if c != to]

    def run(it):
        m = model(path)
        for batch in it:
            texts = [m.decode(x.as_py() or b"") for x in batch.column(batch.schema.names.index(ids))]
            yield pa.record_batch([batch.column(batch.schema.names.index(c)) for c in kept] + [pa.array(texts, pa.string())], names=[*kept, to])

    return encoded.mapInArrow(run, T.StructType([encoded.schema[c] for c in kept] + [T.StructField(to, T.StringType())]))
