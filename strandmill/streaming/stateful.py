"""Keyed state that follows event time: debounced groups, coalesced pieces, entries that expire.

Rows of a key are held back until the watermark has passed them and then go through a fold
in the order of (time, sequence), so the result does not depend on the batches in which
they come, nor on their order within the allowed delay. What is held is bounded by the
rows of a key within that delay; a fold's own state is said with it. Timers wake a key
when its next row is due or its deadline has passed; a key with neither holds no state.
Keys that are whole numbers go to the store in blocks of adjacent ones (TOGETHER), as
Spark's way to a group and back takes far longer than the rows of a key do.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Name of a row's own key where keys share a group.
OWN = "__key"
#: Adjacent numbers that share a group, a power of two: a visit of a group takes Spark a few milliseconds, of a key in it the fold alone.
TOGETHER = 64


def _block(key: Column, kind: str, together: int) -> Column | None:
    """The first number of the block of a whole-number key; None where keys stand alone."""
    if together & (together - 1):
        raise ValueError(f"{together} is no power of two")
    if together > 1 and kind in ("tinyint", "smallint", "int", "bigint"):
        return key.bitwiseAND(F.lit(-together).cast(kind))
    return None


class Fold:
    """State of a key as a JSON object, None while there is nothing to hold."""

    def step(self, state: dict | None, at: int, row: dict) -> tuple[dict | None, list[tuple]]:
        raise NotImplementedError

    def deadline(self, state: dict) -> int | None:
        """Microseconds at which ``state`` ends by itself."""
        return None

    def end(self, state: dict) -> list[tuple]:
        return []


class InOrder(StatefulProcessor):
    """Feeds the rows of each key (__at in microseconds, __seq, __row as JSON) to a fold.

    A group is a key, or a block of keys whose rows have theirs in OWN. What the keys of
    a group hold is one value, as a call of the store takes longer than the fold of a row.
    """

    def __init__(self, fold: Fold, names: list[str]) -> None:
        self.fold, self.names = fold, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows string")
        self.state = handle.getValueState("state", "fold string")
        self.row = Row(*self.names)

    def _wake(self, waiting: dict, states: dict) -> int | None:
        """The millisecond of the group's one timer; as it follows from what is held, it is not looked up."""
        ends = [rows[0][0] for rows in waiting.values()]
        ends += [end for s in states.values() if (end := self.fold.deadline(s)) is not None]
        return -(-min(ends) // 1000) if ends else None

    def _key(self, waiting: list, state: dict | None, now: int) -> tuple[list, dict | None, list[tuple]]:
        """One key: what still waits, its state, and what comes out."""
        rows, out = sorted(waiting, key=lambda r: r[:2]), []

        def close(until: int) -> None:
            nonlocal state
            end = None if state is None else self.fold.deadline(state)
            if end is not None and end <= until:
                out.extend(self.fold.end(state))
                state = None

        due = bisect_right(rows, now, key=lambda r: r[0])
        for at, _, row in rows[:due]:
            close(at)
            state, found = self.fold.step(state, at, row)
            out.extend(found)
        close(now)
        return rows[due:], state, out

    def _go(self, key: tuple, new: list[tuple], watermark: int, woken: bool = False) -> Iterator[Row]:
        held, kept = next(iter(self.waiting.get()), None), self.state.get()
        waiting = dict(json.loads(held[0])) if held else {}
        states = dict(json.loads(kept[0])) if kept else {}
        timer = None if woken else self._wake(waiting, states)  # one that went off is gone
        for (at, seq, _), row in zip(new, json.loads(f"[{','.join(r[2] for r in new)}]")):
            waiting.setdefault(row.pop(OWN, None), []).append([at, seq, row])
        out: list[tuple] = []
        for own in {**waiting, **states}:
            rest, state, found = self._key(waiting.pop(own, []), states.pop(own, None), watermark * 1000)
            if rest:
                waiting[own] = rest
            if state is not None:
                states[own] = state
            out += [(key[0] if own is None else own, *o) for o in found]
        self._put(self.waiting, held, waiting, lambda text: self.waiting.put([(text,)]))
        self._put(self.state, kept, states, lambda text: self.state.update((text,)))
        wake = self._wake(waiting, states)
        if wake != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if wake is not None:
                self.handle.registerTimer(wake)
        for o in out:
            yield self.row(*o)

    @staticmethod
    def _put(store, before: tuple | None, now: dict, write: Callable[[str], None]) -> None:
        text = json.dumps(list(now.items()), separators=(",", ":")) if now else None
        if text is None and before:
            store.clear()
        elif text is not None and (not before or before[0] != text):
            write(text)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        yield from self._go(key, [(r["__us"], r["__seq"], r["__row"]) for r in rows], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._go(key, [], timerValues.getCurrentWatermarkInMs(), woken=True)

    def close(self) -> None:
        pass


def folded(events: DataFrame, fold: Fold, out: str, key: str, ts: str, seq: str, more: list[str], late: str, together: int = TOGETHER) -> DataFrame:
    """``fold`` over the rows of each key; ``out`` is the schema of what it gives, behind the key.

    Blocks of ``together`` adjacent whole numbers share one entry of the store, which is
    written anew when one of them has rows; keys of other types have each their own.
    """
    kind = dict(events.dtypes)[key]
    names = [key, *(c.split()[0] for c in out.split(", "))]
    at, block = F.col(ts).cast("timestamp"), _block(F.col(key), kind, together)
    own = [] if block is None else [F.col(key).alias(OWN)]
    row = F.to_json(F.struct(F.col(seq).alias("seq"), *more, *own), {"ignoreNullFields": "false"})
    rows = events.select((F.col(key) if block is None else block).alias(key), at.alias("__at"), F.unix_micros(at).alias("__us"), F.col(seq).cast("long").alias("__seq"), row.alias("__row"))
    return rows.withWatermark("__at", late).groupBy(key).transformWithState(InOrder(fold, names), f"{key} {kind}, {out}", "append", "eventTime")


class Debounce(Fold):
    """Entries until none has come for ``gap``; each arrival starts the wait anew. Holds the entries of the open group."""

    def __init__(self, gap: int) -> None:
        self.gap = gap

    def step(self, state, at, row):
        state = state or {"items": []}
        return {"items": [*state["items"], row["item"]], "last": at}, []

    def deadline(self, state):
        return state["last"] + self.gap

    def end(self, state):
        return [(",".join(map(str, state["items"])), len(state["items"]))]


def debounced(events: DataFrame, key: str, ts: str, seq: str, item: str, seconds: float, late: str = "1 second", together: int = TOGETHER) -> DataFrame:
    """(key, flushed, entries): the entries that a timer of ``seconds``, set anew by each arrival, flushes together."""
    return folded(events, Debounce(int(seconds * 1e6)), "flushed string, entries long", key, ts, seq, [F.col(item).alias("item")], late, together)


class Coalesce(Fold):
    """Consecutive deltas are one text until an end marker (its text belongs to it), another message, or ``timeout`` without a row. Holds the open text."""

    def __init__(self, timeout: int) -> None:
        self.timeout = timeout

    def step(self, state, at, row):
        kind, text = row["kind"], row["text"] or ""
        if kind == "delta":
            state = state or {"seq": row["seq"], "texts": []}
            return {**state, "texts": [*state["texts"], text], "last": at}, []
        if state and kind == "end":
            return None, [(state["seq"], "".join([*state["texts"], text]), len(state["texts"]) + 1, True)]
        return None, [*(self.end(state) if state else []), (row["seq"], text, 1, kind == "end")]

    def deadline(self, state):
        return state["last"] + self.timeout

    def end(self, state):
        return [(state["seq"], "".join(state["texts"]), len(state["texts"]), False)]


def coalesced(events: DataFrame, key: str, ts: str, seq: str, kind: str, text: str, seconds: float, late: str = "1 second", together: int = TOGETHER) -> DataFrame:
    """(key, seq, text, merged, ended): deltas of a key put together, other messages as they are.

    ``kind`` is "delta", "end" or anything else; ``seq`` orders rows of one time and names
    what starts with it. What never ends is given out after ``seconds`` without a row.
    """
    return folded(events, Coalesce(int(seconds * 1e6)), "seq long, text string, merged long, ended boolean", key, ts, seq, [F.col(kind).alias("kind"), F.col(text).alias("text")], late, together)


class Expiring(Fold):
    """A counter and the last value of a key, gone ``ttl`` after its last update. Holds one value."""

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def step(self, state, at, row):
        n = state["n"] + 1 if state else 1
        return {"n": n, "value": row["value"], "last": at}, [(row["seq"], n, state["value"] if state else None)]

    def deadline(self, state):
        return state["last"] + self.ttl


def progress(events: DataFrame, key: str, ts: str, seq: str, value: str, seconds: float, late: str = "1 second", together: int = TOGETHER) -> DataFrame:
    """(key, seq, updates, before): the how-manieth update of its entry a row is, and the value before; an entry is dropped ``seconds`` after its last update."""
    return folded(events, Expiring(int(seconds * 1e6)), "seq long, updates long, before string", key, ts, seq, [F.col(value).cast("string").alias("value")], late, together)


class Remember(StatefulProcessor):
    """State with a time to live on the processing clock: a key is forgotten ``ttl`` after it was last written.

    The store itself drops a group that long after its last key was written; of one that is
    written again, keys that are too old are left out, by the clock that the store goes by.
    """

    def __init__(self, ttl: int, names: list[str]) -> None:
        self.ttl, self.names = ttl, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "keys string", ttlDurationMs=self.ttl)
        self.row = Row(*self.names)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now, kept = timerValues.getCurrentProcessingTimeInMs(), self.last.get()
        last = {own: (seq, at) for own, seq, at in (json.loads(kept[0]) if kept else ()) if at + self.ttl > now}
        for seq, own in sorted(((r["__seq"], r[OWN]) for r in rows), key=lambda r: r[0]):
            yield self.row(key[0] if own is None else own, seq, last.get(own, (None,))[0])
            last[own] = (seq, now)
        self.last.update((json.dumps([(own, *v) for own, v in last.items()], separators=(",", ":")),))

    def close(self) -> None:
        pass


def remembered(events: DataFrame, key: str, seq: str, seconds: float, together: int = TOGETHER) -> DataFrame:
    """(key, seq, last): each row with the one before it of its key, if that was seen within ``seconds`` on the clock of the machine; rows of a batch go by ``seq``.

    Blocks of ``together`` adjacent whole numbers share an entry of the store, with a time for each of them.
    """
    kind = dict(events.dtypes)[key]
    block = _block(F.col(key), kind, together)
    own = F.lit(None).cast("long") if block is None else F.col(key).cast("long")
    rows = events.select((F.col(key) if block is None else block).alias(key), own.alias(OWN), F.col(seq).cast("long").alias("__seq"))
    return rows.groupBy(key).transformWithState(Remember(int(seconds * 1000), [key, "seq", "last"]), f"{key} {kind}, seq long, last long", "append", "processingTime")
