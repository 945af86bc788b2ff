"""Secret scans: an Aho-Corasick automaton finds keywords, regular expressions are
matched only at its hits, and formats that embed a checksum are validated by it.

Long runs of hexadecimal digits have no keyword; their expression is anchored on the
first character of a run.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The kinds in the order in which they are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "hub", "npm", "jwt", "pem")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
HUB = re.compile(r"gh[pousr]_[0-9A-Za-z]{36}(?![0-9A-Za-z])")
NPM = re.compile(r"npm_[0-9A-Za-z]{36}(?![0-9A-Za-z])")
JWT = re.compile(r"(?<![0-9A-Za-z_-])eyJ[0-9A-Za-z_-]+\.eyJ[0-9A-Za-z_-]+\.[0-9A-Za-z_-]{16,}")
PEM = re.compile(r"-----BEGIN ([A-Z]+ ){0,3}PRIVATE KEY-----[\sA-Za-z0-9+/=]*-----END ([A-Z]+ ){0,3}PRIVATE KEY-----", re.A)
KEYWORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "api_key": "assign", "apikey": "assign", "akia": "access", "ghp_": "hub", "gho_": "hub", "ghu_": "hub", "ghs_": "hub", "ghr_": "hub", "npm_": "npm", "eyj": "jwt", "-----begin": "pem"}
PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hub": HUB, "npm": NPM, "jwt": JWT, "pem": PEM}
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_automaton = None


def automaton():
    global _automaton
    if _automaton is None:
        a = ahocorasick.Automaton()
        for word, kind in KEYWORDS.items():
            a.add_word(word, (kind, len(word)))
        a.make_automaton()
        _automaton = a
    return _automaton


def base62(n: int, width: int) -> str:
    out = ""
    while n:
        n, r = divmod(n, 62)
        out = DIGITS[r] + out
    return out.rjust(width, "0")


def checksum_ok(token: str) -> bool:
    """The last six characters of the part behind the prefix are the CRC-32 of the others, in base 62."""
    body = token.partition("_")[2]
    return base62(zlib.crc32(body[:-6].encode()), 6) == body[-6:]


def _jwt_ok(token: str) -> bool:
    head = token.split(".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, TypeError, binascii.Error):
        return False


def _valid(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[2]) >= 6
    if kind == "access":
        return m.end() - m.start() >= 20
    if kind in ("hub", "npm"):
        return checksum_ok(m[0])
    return kind == "pem" or _jwt_ok(m[0])


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in code points, by start and then in the order of KINDS."""
    text = text or ""
    found = []
    done = dict.fromkeys(PATTERNS, 0)
    low = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    hits = sorted((end - n + 1, kind) for end, (kind, n) in automaton().iter(low))
    for start, kind in hits:
        if start >= done[kind] and (m := PATTERNS[kind].match(text, start)):
            done[kind] = m.end()
            if _valid(kind, m):
                found.append((start, KINDS.index(kind), m.end()))
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


def _spans(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        rows = [[{"kind": k, "start": a, "end": b} for k, a, b in scan(t.as_py())] for t in batch.column(batch.schema.names.index(text))]
        cols = {n: c for n, c in zip(batch.schema.names, batch.columns) if n not in (text, "secrets")} | {"secrets": pa.array(rows, kind)}
        yield pa.record_batch(list(cols.values()), names=list(cols))


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, and secrets: array of (kind, start, end), end exclusive.

    A null or empty text has none; texts of any length are scanned whole, each keyword once.
    Spans of one start come in the order of KINDS. Repeated rows are scanned alike; a column
    called secrets is replaced, others pass through. An empty table gives an empty table.
    """
    from pyspark.sql import types as T

    kept = docs.drop("secrets")
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([f for f in kept.schema if f.name != text] + [T.StructField("secrets", span)])
    return kept.mapInArrow(lambda it: _spans(it, text), schema)


def joined(spans, kinds=None):
    """kind:start:end, comma-joined."""
    if kinds:
        spans = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
