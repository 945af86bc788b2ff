"""Repair of conversation structure by shortest paths over (turn index, grammar state).

A repaired conversation has role initials ``(s?(ua)+)?``. Nodes of the lattice are pairs
of a turn index and a grammar state; edits (keep, rerole, delete, insert) are its edges,
made only when a node is reached. Dijkstra's queue is keyed by (cost, audit): the audit is
the edits' initials in order, so of the cheapest repairs the ASCII-least is popped first.
No audit of a node is the beginning of another one of the same cost (an insertion costs),
so the order of audits stays when both are continued.

Conversations of up to ``long_at`` rows are whole in one task. A longer one is dealt out in
ranges of its order; a range gives the best (cost, audit) from each state to each state,
piece by piece, and such transfers are combined in a tree, 16 ranges to a node.
Its digest is sequential and goes by one task that holds the audit and one batch of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch
from .skew import lookup

#: Costs of edits.
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
#: States of the grammar: nothing yet, after s, after u, after a; by the initial that comes next.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NAMES = {"u": "user", "a": "assistant"}
ENDS = (0, 3)
SPACE = " \t\n\x0b\x0c\r"
#: Rows of a piece, whose transfers are found by four searches.
PIECE = 256
FAULTS = ("", "blank", "duplicate", "truncated")

#: (cost, audit) from a state to a state, None where there is no way.
Transfer = list[list[tuple[int, str] | None]]


def search(turns: list[tuple[str, str]], start: int, ends: tuple[int, ...], first: bool) -> dict[int, tuple[int, str]]:
    """The best (cost, audit) from ``start`` before ``turns``, (role initial, fault) each, to the states ``ends`` behind them.

    With ``first`` the search stops at the first end that is popped.
    """
    n = len(turns)
    queue = [(0, "", 0, start)]
    done = set()
    found: dict[int, tuple[int, str]] = {}
    while queue:
        cost, audit, i, state = heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n and state in ends:
            found[state] = (cost, audit)
            if first or len(found) == len(ends):
                break
        follow = NEXT[state]
        if i < n:
            role, fault = turns[i]
            heappush(queue, (cost + DELETE, audit + "D", i + 1, state))
            if fault in ("", "truncated"):
                more = cost + (CUT if fault else 0)
                if role in follow:
                    heappush(queue, (more, audit + "K", i + 1, follow[role]))
                for c in NAMES:
                    if c in follow:
                        heappush(queue, (more + REROLE, audit + "R", i + 1, follow[c]))
        for c in NAMES:
            if c in follow:
                heappush(queue, (cost + INSERT, audit + "I", i, follow[c]))
    return found


def repair(turns: list[tuple[str, str]]) -> tuple[int, str]:
    """Cost and audit of the whole of ``turns``."""
    if len(turns) <= PIECE:
        return min(search(turns, 0, ENDS, True).values())
    return best(transfer(turns))


def joined(a: Transfer, b: Transfer) -> Transfer:
    """Transfers one after the other."""

    def cell(s: int, t: int) -> tuple[int, str] | None:
        ways = [(x[0] + y[0], x[1], y[1]) for q in range(4) if (x := a[s][q]) and (y := b[q][t])]
        least = min((w[0] for w in ways), default=None)
        return min(((w[0], w[1] + w[2]) for w in ways if w[0] == least), default=None)

    return [[cell(s, t) for t in range(4)] for s in range(4)]


class Tree:
    """Transfers that arrive in order, combined two of a size at a time, so that an audit is copied a few times only."""

    def __init__(self) -> None:
        self.held: list[tuple[int, Transfer]] = []

    def add(self, t: Transfer) -> None:
        level = 0
        while self.held and self.held[-1][0] == level:
            t = joined(self.held.pop()[1], t)
            level += 1
        self.held.append((level, t))

    def all(self) -> Transfer:
        out = self.held[-1][1]
        for _, t in self.held[-2::-1]:
            out = joined(t, out)
        return out


def piece(turns: list[tuple[str, str]]) -> Transfer:
    out: Transfer = []
    for s in range(4):
        found = search(turns, s, (0, 1, 2, 3), False)
        out.append([found.get(t) for t in range(4)])
    return out


def transfer(turns: list[tuple[str, str]]) -> Transfer:
    tree = Tree()
    for at in range(0, len(turns), PIECE):
        tree.add(piece(turns[at : at + PIECE]))
    return tree.all()


def best(t: Transfer) -> tuple[int, str]:
    return min(t[0][e] for e in ENDS if t[0][e])


def fault(text: str, seen: bool) -> str:
    said = text.strip(SPACE)
    return "blank" if not said else "duplicate" if seen else "" if said[-1] in ".!?" else "truncated"


def illegal(before: str, now: str) -> bool:
    return before + now not in ("su", "ua", "au")


class Digest:
    """SHA-256 of the repaired ``role:text`` lines, fed with turns in order."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state, self.sha, self.any = audit, 0, 0, hashlib.sha256(), False

    def _say(self, role: str, text: str, initial: str) -> None:
        self.sha.update((("\n" if self.any else "") + role + ":" + text).encode())
        self.any, self.state = True, NEXT[self.state][initial]

    def _new(self) -> str:
        return next(c for c in NAMES if c in NEXT[self.state])

    def _inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            c = self._new()
            self._say(NAMES[c], "", c)
            self.at += 1

    def turn(self, role: str, text: str) -> None:
        self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self._say(role, text, role[:1])
        elif edit == "R":
            c = self._new()
            self._say(NAMES[c], text, c)

    def hex(self) -> str:
        self._inserted()
        return self.sha.hexdigest()


def gaps(turns: set[int]) -> int:
    return max(turns) - min(turns) + 1 - len(turns) if turns else 0


OUT = T.StructType([T.StructField("k", T.StringType())] + [T.StructField(c, T.LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
KINDS = [pa.string()] + [pa.int64()] * 6 + [pa.string()] * 2


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, turn, role, text) sorted; a row of the result per k."""

    def done(k: str, rows: list[tuple]) -> tuple:
        seen: set = set()
        turns, count, wrong, before = [], dict.fromkeys(FAULTS, 0), 0, None
        for _, role, text in rows:
            f = fault(text, (role, text) in seen)
            seen.add((role, text))
            count[f] += 1
            wrong += before is not None and illegal(before, role[:1])
            before = role[:1]
            turns.append((before, f))
        cost, audit = repair(turns)
        out = Digest(audit)
        for _, role, text in rows:
            out.turn(role, text)
        return k, gaps({r[0] for r in rows if r[0] is not None}), count["blank"], count["duplicate"], count["truncated"], wrong, cost, audit, out.hex()

    key, held = None, []
    for batch in batches:
        found = []
        for k, turn, role, text in zip(*(batch.column(batch.schema.names.index(c)).to_pylist() for c in ("k", "turn", "role", "text"))):
            if k != key and held:
                found.append(done(key, held))
                held = []
            key = k
            held.append((turn, role, text))
        if found:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found), KINDS)], names=OUT.names)
    if held:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*[done(key, held)]), KINDS)], names=OUT.names)


PART = "k string, part int, blank long, duplicate long, truncated long, illegal long, first string, last string, cost array<long>, audit array<string>"
PART_KINDS = [pa.string(), pa.int32()] + [pa.int64()] * 4 + [pa.string()] * 2 + [pa.list_(pa.int64()), pa.list_(pa.string())]
PART_NAMES = ["k", "part", "blank", "duplicate", "truncated", "illegal", "first", "last", "cost", "audit"]


def _flat(t: Transfer) -> tuple[list, list]:
    cells = [c or (None, None) for line in t for c in line]
    return [c[0] for c in cells], [c[1] for c in cells]


def _square(cost: list, audit: list) -> Transfer:
    return [[None if cost[4 * s + t] is None else (cost[4 * s + t], audit[4 * s + t]) for t in range(4)] for s in range(4)]


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (k, part, role, text, copies, anew) of one range each: counts and the transfer of a conversation's rows in this range."""

    class Held:
        def __init__(self, k: str, part: int) -> None:
            self.k, self.part, self.tree, self.turns = k, part, Tree(), []
            self.count, self.wrong, self.first, self.last = dict.fromkeys(FAULTS, 0), 0, None, None

        def add(self, role: str, f: str) -> None:
            self.count[f] += 1
            if self.last is None:
                self.first = role
            else:
                self.wrong += illegal(self.last, role)
            self.last = role
            self.turns.append((role, f))
            if len(self.turns) == PIECE:
                self.tree.add(piece(self.turns))
                self.turns = []

        def row(self) -> tuple:
            if self.turns:
                self.tree.add(piece(self.turns))
            return (self.k, self.part, self.count["blank"], self.count["duplicate"], self.count["truncated"], self.wrong, self.first, self.last, *_flat(self.tree.all()))

    held = None
    for batch in batches:
        found = []
        for k, part, role, text, copies, anew in zip(*(batch.column(batch.schema.names.index(c)).to_pylist() for c in ("k", "part", "role", "text", "copies", "anew"))):
            if held is None or (held.k, held.part) != (k, part):
                if held:
                    found.append(held.row())
                held = Held(k, part)
            for i in range(copies):
                held.add(role[:1], fault(text, i > 0 or not anew))
        if found:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found), PART_KINDS)], names=PART_NAMES)
    if held:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*[held.row()]), PART_KINDS)], names=PART_NAMES)


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of PART sorted by (k, up, part): one row per (k, up), as part."""

    def add(a: list, row: tuple) -> list:
        *counts, first, last, cost, audit = row
        if a is None:
            return [counts, first, last, _square(cost, audit)]
        old, head, tail, t = a
        new = [x + y for x, y in zip(old, counts)]
        new[3] += illegal(tail, first)
        return [new, head, last, joined(t, _square(cost, audit))]

    key, acc = None, None
    for batch in batches:
        found = []
        for k, up, *row in zip(*(batch.column(batch.schema.names.index(c)).to_pylist() for c in ("k", "up", *PART_NAMES[2:]))):
            if (k, up) != key:
                if acc:
                    found.append((*key, *acc[0], acc[1], acc[2], *_flat(acc[3])))
                acc = None
            key = (k, up)
            acc = add(acc, row)
        if found:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found), PART_KINDS)], names=PART_NAMES)
    if acc:
        yield pa.record_batch([pa.array([c], t) for c, t in zip((*key, *acc[0], acc[1], acc[2], *_flat(acc[3])), PART_KINDS)], names=PART_NAMES)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (k, body, order): first the audit (body false), then the turns, told by ``copies``."""
    key, now = None, None
    for batch in batches:
        found = []
        for k, body, role, text, copies in zip(*(batch.column(batch.schema.names.index(c)).to_pylist() for c in ("k", "body", "role", "text", "copies"))):
            if not body:
                if now:
                    found.append((key, now.hex()))
                key, now = k, Digest(text)
                continue
            for _ in range(copies):
                now.turn(role, text)
        if found:
            yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*found)], names=["k", "repaired_sha256"])
    if now:
        yield pa.record_batch([pa.array([c], pa.string()) for c in (key, now.hex())], names=["k", "repaired_sha256"])


def _by_ranges(rows: DataFrame, parts: int) -> DataFrame:
    """The result of conversations that are dealt out in ranges of their order."""
    said = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary"), 256).alias("said")
    same = scratch.keep(rows.groupBy("k", "turn", "role", "text").agg(F.count("*").alias("copies")).withColumn("said", said), "turns")
    total = same.count()
    least = same.groupBy("k", "said").agg(F.min(F.struct(F.col("turn").isNotNull().alias("some"), "turn")).alias("least"), F.count("*").alias("__n"))
    marked = lookup(same, least, ["k", "said"], "__n", total).withColumn("anew", F.col("least.turn").eqNullSafe(F.col("turn"))).drop("said", "least")
    order = ["k", F.asc_nulls_first("turn"), "role", "text"]
    ranged = scratch.keep(marked.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "ranges")
    level = scratch.keep(ranged.repartition(parts, "part").sortWithinPartitions("part", *order).mapInArrow(_ranges, PART), "transfers")
    up, most = 1, level.agg(F.max("part")).first()[0] or 0
    while up <= most:
        dealt = level.withColumn("up", F.floor(F.col("part") / 16).cast("int")).repartition(parts, "k", "up").sortWithinPartitions("k", "up", "part")
        level, up = scratch.keep(dealt.mapInArrow(_combine, PART), "transfers"), up * 16
    ends = F.array_min(F.array(*[F.when(F.col("cost")[e].isNotNull(), F.struct(F.col("cost")[e].alias("cost"), F.col("audit")[e].alias("audit"))) for e in ENDS]))
    found = scratch.keep(level.select("k", "blank", "duplicate", "truncated", "illegal", ends.alias("b")).select("*", "b.cost", "b.audit").drop("b"), "audits")
    spread = same.groupBy("k").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    body = same.select("k", F.lit(True).alias("body"), "turn", "role", "text", "copies")
    head = found.select("k", F.lit(False).alias("body"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(1).cast("long").alias("copies"))
    digests = body.unionByName(head).repartition(parts, "k").sortWithinPartitions("k", "body", F.asc_nulls_first("turn"), "role", "text").mapInArrow(_digests, "k string, repaired_sha256 string")
    return found.join(spread, "k").join(digests, "k").select(*OUT.names)


def repair_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", long_at: int = 4096) -> DataFrame:
    """k (the conversation's id as a string, one space for null) with gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    Rows of a conversation go by turn, nulls first, then by role and text, so ties do not
    depend on the input's order. A row's first fault counts: blank, duplicate (role and text
    seen earlier) or truncated (its last visible character is not one of ``.!?``). Null roles
    and texts are one space; an empty role has no initial, so its turn is never kept as it is;
    rows without conversation id are one conversation. Repeated
    rows are duplicates of the first. Other columns are not read; an empty table gives an
    empty table. Conversations of over ``long_at`` rows are dealt out; the result is the same.
    """
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    t = rows.select(blank(conv).alias("k"), F.col(turn).cast("long").alias("turn"), blank(role).alias("role"), blank(text).alias("text"))
    sizes = scratch.keep(t.groupBy("k").agg(F.count("*").alias("n")).filter(F.col("n") > long_at).withColumn("size", F.col("n")), "long")
    n_long, total = sizes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    short = t
    if n_long:
        marked = lookup(t, sizes, "k", "size", total, "left")
        short = marked.filter("n is null").drop("n")
    order = [F.asc("k"), F.asc_nulls_first("turn"), "role", "text"]
    out = short.repartition(parts, "k").sortWithinPartitions(*order).mapInArrow(_whole, OUT)
    return out.unionByName(_by_ranges(marked.filter("n is not null").drop("n"), parts)) if n_long else out


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text after reproducible damage: crc32 of ``conv:turn`` modulo 20 drops (0), empties (1), takes ``.!?`` (2), repeats (3) or sets role user (4); nulls are one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.pmod(F.crc32(F.concat(blank(conv), F.lit(":"), blank(turn)).cast("binary")), F.lit(20))
    hurt = rows.withColumn("__what", what).filter("__what <> 0")
    said = F.when(F.col("__what") == 1, "").when(F.col("__what") == 2, F.regexp_replace(blank(text), "[.!?]", "")).otherwise(blank(text))
    return hurt.select(F.col(conv), F.col(turn), F.when(F.col("__what") == 4, "user").otherwise(blank(role)).alias(role), said.alias(text), F.explode(F.when(F.col("__what") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("__copy")).drop("__copy")
