"""Rewriting of translated texts: formula fragments put together, paragraphs put into chunks.

Both go from piece to piece with what has been decided before, over marks that pair up
across pieces, so they are small Python functions on one text, handed over in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Escaped dollars, displays, and formulas between single dollars; of several dollars in a row the last one closes.
PIECES = re.compile(r"\\\$|\$\$(?:[\s\S]*?\$\$)?|\$(?P<inner>(?:\\\$|\$(?=\$)|[^$])*+)\$(?!\$)")
#: What a gap between two formulas of one may not have, and its length; what makes a formula a display.
BREAKS = re.compile("[.。!！?？;:；:]|[一-鿿㐀-䶿぀-ゟ가-힯]")
GAP = 35
STRUCTURAL = re.compile(r"\\(?:frac|dfrac|tfrac|sum|prod|int|iint|iiint|oint|sqrt|begin|lim|max|min|argmin|argmax|sup|inf|det|gcd|lcm)\b")
NUMBERED = re.compile(r"\s*\(\d+[a-z]?\)")
DISPLAY, INLINE = re.compile(r"\$\$(.+?)\$\$", re.DOTALL), re.compile(r"(?<!\$)\$(?!\$)([^$\n]+?)\$(?!\$)")
#: Rewritings within a formula, in this order.
REWRITES = (
    (re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"), ""),
    (re.compile(r"[#%]"), r"\\\g<0>"),
    (re.compile(r"(?<!\\)~(?!textasciitilde)"), r"\\textasciitilde{}"),
    (re.compile(r"(?<!\\)([_^])([a-zA-Z][a-zA-Z0-9,.]{0,10})(?![\w{])"), r"\1{\2}"),
)
SENTENCE_END = re.compile(r"[.。!！?？]\s*$")


def _joins(gap: str) -> bool:
    """Whether what stands between two formulas belongs to them: short, no end of a sentence, no ideographs, not five words of which three are long."""
    gap = gap.strip()
    if len(gap) > GAP or BREAKS.search(gap):
        return False
    words = gap.split()
    return len(words) < 5 or sum(bool(re.search("[a-zA-Z]{3,}", w)) for w in words) < 3


def _inlines(text: str) -> Iterator[re.Match]:
    return (m for m in PIECES.finditer(text) if m["inner"] is not None)


def _chained(text: str) -> str:
    """One pass: neighbours between which every gap joins become one."""
    out, last, chain = [], 0, []

    def close() -> None:
        if chain:
            whole = " ".join(" ".join(chain).split())
            out.append(f"${whole}$" if len(chain) > 1 else f"${chain[0]}$")
            chain.clear()

    for m in _inlines(text):
        gap = text[last : m.start()]
        if chain and _joins(gap):
            chain += [gap.strip(), m["inner"]]
        else:
            close()
            out.append(gap)
            chain.append(m["inner"])
        last = m.end()
    close()
    return "".join(out) + text[last:]


def merge_fragments(text: str | None) -> str | None:
    """Formula fragments of a text put together until nothing changes, what looks like a display made one, indices in braces."""
    if not text or "$" not in text:
        return text
    before = None
    while before != text:
        before, text = text, _chained(text)
    out, last = [], 0
    for m in _inlines(text):
        inner, after = m["inner"], text[m.end() : m.end() + 20]
        display = STRUCTURAL.search(inner) or ("=" in inner and len(inner) > 50) or NUMBERED.match(after)
        out += [text[last : m.start()], f"\n\n$${inner.strip()}$$\n\n" if display else m[0]]
        last = m.end()
    text = "".join(out) + text[last:]

    def rewritten(mark: str):
        def one(m: re.Match) -> str:
            inner = m[1]
            for what, by in REWRITES:
                inner = what.sub(by, inner)
            return mark + inner + mark

        return one

    return INLINE.sub(rewritten("$"), DISPLAY.sub(rewritten("$$"), text))


def single_dollars(text: str) -> int:
    """Dollars that no pair of two takes."""
    return text.count("$") - 2 * text.count("$$")


def _forced(paragraph: str, most: int) -> list[str]:
    """Pieces from every ``most`` characters on; one that would end within a formula ends behind it, and what it has beyond comes again."""
    out = []
    for at in range(0, len(paragraph), most):
        end = at + most
        if end < len(paragraph) and single_dollars(paragraph[:end]) % 2:
            closing = paragraph.find("$", end)
            end = closing + 1 if closing >= 0 else end
        out.append(paragraph[at:end])
    return out


def _whole(chunks: list[str], marks) -> list[str]:
    """A chunk with an odd number of marks takes the next one with it."""
    out, rest = [], iter(chunks)
    for chunk in rest:
        if marks(chunk) % 2 and (more := next(rest, None)) is not None:
            chunk = f"{chunk}\n\n{more}"
        out.append(chunk)
    return out


def build_chunks(paragraphs: list[str] | None, most: int) -> list[str] | None:
    """Chunks of about ``most`` characters, of whole paragraphs.

    A paragraph of over twice the size is cut. Where a chunk is full and its last paragraph
    does not end a sentence, that paragraph goes over to the next chunk, if it is not the
    only one. Chunks that would cut a display or a formula are joined.
    """
    if paragraphs is None:
        return None
    done: list[list[str]] = []
    held: list[str] = []
    size = 0
    for p in paragraphs:
        if len(p) > 2 * most:
            for piece in _forced(p, most):
                done.append(held)
                held, size = [piece], len(piece)
        elif held and size + len(p) > most:
            over = [held.pop()] if len(held) > 1 and not SENTENCE_END.search(held[-1].strip()) else []
            done.append(held)
            held = [*over, p]
            size = sum(map(len, held))
        else:
            held.append(p)
            size += len(p)
    chunks = ["\n\n".join(c) for c in (*done, held) if c]
    return _whole(_whole(chunks, lambda c: c.count("$$")), single_dollars)


def merged_fragments(text: Column) -> Column:
    @F.pandas_udf("string")
    def merged(s: pd.Series) -> pd.Series:
        return s.map(merge_fragments, na_action="ignore")

    return merged(text)


def chunked(paragraphs: Column, most: int) -> Column:
    """Array of chunks of an array of paragraphs; null of null."""

    @F.pandas_udf("array<string>")
    def built(s: pd.Series) -> pd.Series:
        return s.map(lambda p: build_chunks(None if p is None else list(p), most))

    return built(paragraphs)
