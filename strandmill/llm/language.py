"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts are gathered from a bounded sample: about ``per_language`` labelled
documents of each language (all, where there are fewer), chosen by a hash of their
id, so the cost of training does not grow with the corpus. Scoring covers every whole
text: the matrix of log probabilities is broadcast (buckets x languages, float32) and
a batch is scored as one flat run of n-gram buckets, in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 15
ORDERS = (2, 3)
BLOCK = 1 << 19
UND = "und"
#: As much evidence as so many n-grams counts; more of it does not make a score surer.
EVIDENCE = 60.0


def _folded(text: str) -> str:
    return text.lower()


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def buckets(codes: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each code point but the last order - 1."""
    h = np.full(len(codes) - order + 1, order, np.uint32)
    for i in range(order):
        h = (h ^ codes[i : len(codes) - order + 1 + i]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return h >> np.uint32(32 - BITS)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer((" " + _folded(text) + " ").encode("utf-32-le", "replace"), np.uint32)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            codes = _codes(text.as_py())
            n = held.setdefault(lang, np.zeros(1 << BITS, np.int64))
            for at in range(0, len(codes), BLOCK):
                part = codes[at : at + BLOCK + max(ORDERS) - 1]
                for order in ORDERS:
                    if len(part) >= order:
                        own = buckets(part, order)[:BLOCK]
                        n += np.bincount(own, minlength=1 << BITS)
    for lang, n in held.items():
        hit = np.flatnonzero(n)
        yield pa.record_batch([pa.array([lang] * len(hit), pa.string()), pa.array(hit.astype(np.int32)), pa.array(n[hit])], names=["lang", "bucket", "n"])


def train(rows: DataFrame, lang: str, text: str, doc: str, per_language: int = 2000) -> tuple[list[str], np.ndarray]:
    """Languages in order and the matrix (buckets, languages) of log probabilities; uniform priors."""
    spark = rows.sparkSession
    use = rows.select(F.col(lang).alias("lang"), F.col(text).alias("t"), F.xxhash64(F.col(doc)).alias("h")).filter("lang is not null")
    have = {r["lang"]: r["n"] for r in use.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(have)
    if not langs:
        return [], np.zeros((1 << BITS, 0), np.float32)
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, per_language / have[k])))])
    chosen = use.filter(F.col("t").isNotNull() & (F.expr("pmod(h, 1000003)") < share[F.col("lang")] * 1000003))
    counted = chosen.select("lang", "t").mapInArrow(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    m = np.full((1 << BITS, len(langs)), 0.5, np.float64)
    at = {k: i for i, k in enumerate(langs)}
    np.add.at(m, (counted.column("bucket").to_numpy(), np.array([at[k] for k in counted.column("lang").to_pylist()], int)), counted.column("n").to_numpy())
    return langs, np.log(m / m.sum(0)).astype(np.float32)


def _score(texts: list[str], matrix: np.ndarray) -> np.ndarray:
    """Mean log probability per n-gram: (texts, languages). Texts are run together and scored in blocks."""
    totals = np.zeros((len(texts), matrix.shape[1]))
    grams = np.zeros(len(texts))

    def run(codes: np.ndarray, starts: np.ndarray, ids: list[int], own: int) -> None:
        """Adds the first ``own`` positions of a run in which the text ids[i] starts at starts[i]."""
        for order in ORDERS:
            if len(codes) < order:
                continue
            b = buckets(codes, order)[:own]
            first = starts[starts < len(b)]
            k = ids[: len(first)]
            totals[k] += np.add.reduceat(matrix[b], first, axis=0, dtype=np.float64)
            grams[k] += np.diff(first, append=len(b))

    held, ids, size = [], [], 0

    def flush() -> None:
        nonlocal held, ids, size
        if held:
            run(np.concatenate(held), np.cumsum([0] + [len(x) for x in held[:-1]]), ids, size)
        held, ids, size = [], [], 0

    for i, text in enumerate(texts):
        codes = _codes(text)
        if len(codes) > BLOCK:
            flush()
            for at in range(0, len(codes), BLOCK):
                run(codes[at : at + BLOCK + max(ORDERS) - 1], np.array([0]), [i], BLOCK)
            continue
        held.append(codes)
        ids.append(i)
        size += len(codes)
        if size >= BLOCK:
            flush()
    flush()
    return totals / np.maximum(grams, 1)[:, None]


def _predict(batches: Iterator[pa.RecordBatch], text: str, shared) -> Iterator[pa.RecordBatch]:
    langs, matrix = shared.value
    for batch in batches:
        texts = batch.column(batch.schema.names.index(text)).to_pylist()
        pred, score = [UND] * len(texts), np.zeros(len(texts))
        real = [i for i, t in enumerate(texts) if has_letter(t)]
        if real and langs:
            mean = _score([texts[i] for i in real], matrix)
            n = np.array([min(EVIDENCE, len(texts[i]) + 1.0) for i in real])
            z = mean * n[:, None]
            z = np.exp(z - z.max(1, keepdims=True))
            z /= z.sum(1, keepdims=True)
            for i, k, p in zip(real, z.argmax(1), z.max(1)):
                pred[i] = langs[k]
                score[i] = p
        cols = dict(zip(batch.schema.names, batch.columns)) | {"lang_pred": pa.array(pred, pa.string()), "score": pa.array(score)}
        yield pa.record_batch(list(cols.values()), names=list(cols))


def held_out(doc: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1; false for a null id."""
    return F.coalesce(F.crc32(doc.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", doc: str = "doc_id", per_language: int = 2000, keep: list[str] | None = None) -> DataFrame:
    """Columns of ``docs`` (or ``keep`` of them) and held_out, lang_pred, score.

    Learns from rows that are not held out and whose language and id are not null. A text
    that is null or has no letter is ``und`` with score 0, and so is every text if nothing
    could be learned. Very long texts are scored whole, in blocks. Columns of the same names
    are replaced, others pass through. Repeated rows are scored alike; ties between languages
    go to the first by name. An empty table gives an empty table. The matrix has a column of
    128 KB for every different value of ``lang``, so it should name languages and nothing else.
    """
    spark = docs.sparkSession
    langs, matrix = train(docs.filter(F.col(doc).isNotNull() & ~held_out(F.col(doc))), lang, text, doc, per_language)
    shared = spark.sparkContext.broadcast((langs, matrix))
    rows = docs.select(*(keep or docs.columns)).withColumns({"held_out": held_out(F.col(doc))}).drop("lang_pred", "score")
    schema = T.StructType([*rows.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(lambda it: _predict(it, text, shared), schema)
