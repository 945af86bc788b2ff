"""Best-fit packing planned on the histogram of lengths.

Best fit decreasing runs over at most ``capacity`` (length, count) pairs on the
driver; its plan is a few thousand segments whatever the corpus: pieces of one length
with ranks in a range go, k to a sequence, behind each other into consecutive
sequences. Pieces then take their slots by joining on the rank within their length.
Ranks are dealt within (length, salt), with as many salts as the histogram says that a
length needs, so that a common length is no hot key.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from unicodedata import is_normalized

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

#: So many pieces of one length are ranked by one task.
RANKED = 100_000
_MOST_STRINGS = 150_000
_MOST_WORDS = 250_000
#: Byte-level models write each byte as one character: itself where it is printable, else the next one from 256 on.
_OPEN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_SHOWN = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _OPEN)}
_coders: dict[str, "WordCoder"] = {}


class WordCoder:
    """Ids of a tokenizer whose tokens never cross white space, remembered by word.

    Two memories, both filled until they hold enough and then left as they are, so that
    they hold what is common: strings between white space, and below them words in lower
    case without the punctuation mark at their end. The second is used only in texts
    for which lower case first and normal form first give the same.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.strings: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _fresh(self, words: list[str]) -> dict[str, bytes]:
        """Words of lower-case letters go to the model as they are, others through all steps."""
        out, odd = {}, []
        for w in words:
            if w.isalpha() and w.islower() and is_normalized("NFC", w):
                raw = w if w.isascii() else w.encode().decode("latin-1").translate(_SHOWN)
                out[w] = array("I", [t.id for t in self.model.tokenize(raw)]).tobytes()
            else:
                odd.append(w)
        if odd:
            out |= {w: array("I", e.ids).tobytes() for w, e in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False))}
        return out

    def encode(self, text: str) -> bytes:
        """Little-endian uint32 ids, without special tokens added."""
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to str.split alone
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        strings = text.split()
        out = list(map(self.strings.get, strings))
        gaps = [i for i, x in enumerate(out) if x is None]
        if not gaps:
            return b"".join(out)
        plain = text.isascii() or ("\u03a3" not in text and is_normalized("NFC", text) and is_normalized("NFC", text.lower()))
        need, split = {}, []
        words = self.words
        for i in gaps:
            w = strings[i]
            if plain and w.isalpha():
                pair = (w.lower(), "")
            elif plain and len(w) > 1 and w[-1] in ".,;:!?" and w[:-1].isalpha():
                pair = (w[:-1].lower(), w[-1])
            else:
                pair = (w, "")
            split.append(pair)
            for x in pair:
                if x and x not in words:
                    need[x] = None
        new = self._fresh(list(need)) if need else {}
        if len(words) < _MOST_WORDS:
            words.update((k, v) for k, v in new.items() if len(k) <= 64)
        keep = len(self.strings) < _MOST_STRINGS
        for i, (w, mark) in zip(gaps, split):
            ids = new[w] if w in new else words[w]
            if mark:
                ids += new[mark] if mark in new else words[mark]
            out[i] = ids
            if keep and len(strings[i]) <= 64:
                self.strings[strings[i]] = ids
        return b"".join(out)


def coder(path: str) -> WordCoder:
    if path not in _coders:
        _coders[path] = WordCoder(path)
    return _coders[path]


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, ids: bool) -> Iterator[pa.RecordBatch]:
    code = coder(path)
    end = b"\0\0\0\0"
    for batch in batches:
        doc, piece, start, length, crc, body = [], [], [], [], [], []
        for d, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = code.encode(t.as_py() or "") + end
            for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                part = raw[at : at + 4 * capacity]
                doc.append(d)
                piece.append(k)
                start.append(at // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
                if ids:
                    body.append(part)
        cols = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if ids:
            cols.append(pa.array(body, pa.binary()))
            names.append("ids")
        yield pa.record_batch(cols, names=names)


def pieces(docs: DataFrame, text: str = "text", doc: str = "doc_id", path: str | None = None, capacity: int = 2048, ids: bool = False) -> DataFrame:
    """Per document its ids and a closing 0, cut into pieces of ``capacity``; with ``ids`` the ids themselves, as bytes."""
    path = path or word_tokenizer()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids
    return docs.select(F.col(doc).cast("long"), F.col(text)).mapInArrow(lambda it: _pieces(it, path, capacity, ids), schema)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Segments (length, first rank, number of ranks, first sequence, pieces to a sequence, offset)."""
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: ranges of sequences
    out, opened = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = next((r for r in range(length, capacity) if free.get(r)), capacity)
            each = room // length
            if room < capacity:
                first, n = free[room].pop()
            else:
                n = -(-left // each)
                first, opened = opened, opened + n
            whole = min(n, left // each)
            if whole:
                out.append((length, rank, whole * each, first, each, capacity - room))
                free[room - each * length].append((first, whole))
                rank, left = rank + whole * each, left - whole * each
            if left and whole < n:
                out.append((length, rank, left, first + whole, left, capacity - room))
                free[room - left * length].append((first + whole, 1))
                rank, left, whole = rank + left, 0, whole + 1
            if whole < n:
                free[room].append((first + whole, n - whole))
    return out


def assign(parts: DataFrame, capacity: int = 2048, ranked: int | None = None) -> DataFrame:
    """``parts`` (doc_id, piece, start, length, ids_crc32, ...) with sequence_id and offset; lengths over some ``ranked`` pieces are dealt to as many tasks as they need.

    Without ``ranked`` that is an even share of the pieces of a shuffle partition, and RANKED at most.
    """
    spark = parts.sparkSession
    counted = {int(r["length"]): int(r["n"]) for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranked = ranked or max(1, min(RANKED, sum(counted.values()) // tasks))
    rows = plan(counted, capacity)
    plans = spark.createDataFrame(rows or [(0, 0, 0, 0, 1, 0)], "p_length long, p_rank long, p_n long, p_first long, p_each long, p_offset long")
    salts = F.array(*[F.lit(-(-counted.get(k, 1) // ranked)).cast("long") for k in range(capacity + 1)])
    salted = parts.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.get(salts, F.col("length").cast("int"))))
    by = Window.partitionBy("length", "__salt")
    counts = salted.groupBy("length", "__salt").agg(F.count("*").alias("n"))
    before = counts.select("length", "__salt", (F.sum("n").over(Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("__before"))
    ranked = salted.withColumn("__row", F.row_number().over(by.orderBy("doc_id", "piece")) - 1).join(before, ["length", "__salt"]).withColumn("__rank", F.col("__row") + F.col("__before"))
    slot = F.col("__rank") - F.col("p_rank")
    placed = ranked.join(F.broadcast(plans), (F.col("length") == F.col("p_length")) & (slot >= 0) & (slot < F.col("p_n")))
    keep = [c for c in parts.columns if c not in ("sequence_id", "offset")]
    return placed.select(*keep, (F.col("p_first") + F.expr("(__rank - p_rank) div p_each")).alias("sequence_id"), (F.col("p_offset") + (slot % F.col("p_each")) * F.col("length")).alias("offset"))


def pack(docs: DataFrame, text: str = "text", doc: str = "doc_id", path: str | None = None, capacity: int = 2048, ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids on request).

    A null or empty text is the closing id alone, so every row has at least one piece; a very
    long one has as many as it needs.
    Repeated rows, and rows whose id is null, are packed as documents of their own. Equal
    ids are told apart in no further way: which of two equal pieces takes which of two slots
    is not fixed. Other columns are not read. An empty table gives an empty table.
    """
    return assign(scratch.keep(pieces(docs, text, doc, path, capacity, ids), "pieces"), capacity)
