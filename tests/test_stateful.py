"""Stateful streams: folds over random batches against the batch form, state that vanishes, breaks and replays."""

import random
import time

from pyspark.sql import functions as F

from strandmill.plans import QUERIES
from strandmill.streaming import sinks, stateful

SF = "/root/testdata/sf0.001"


class Store:
    """The handle of one key, without Spark."""

    def __init__(self):
        self.timers, self.value, self.rows = set(), None, []

    def getListState(self, name, schema):
        return self

    def getValueState(self, name, schema):
        own, store = type("V", (), {})(), self
        own.exists = lambda: store.value is not None
        own.get = lambda: store.value
        own.update = lambda v: setattr(store, "value", v)
        own.clear = lambda: setattr(store, "value", None)
        return own

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = list(rows)

    def clear(self):
        self.rows = []

    def listTimers(self):
        return iter(sorted(self.timers))

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class Clock:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


def fed(fold, names, batches):
    """What a key gives for batches of (us, seq, row), each behind the watermark of those before; and its store at the end."""
    import json

    p, store, out, mark = stateful.InOrder(fold, names), Store(), [], 0
    p.init(store)
    for batch in [*batches, None]:
        if batch:
            rows = [{"__us": us, "__seq": seq, "__row": json.dumps(row)} for us, seq, row in batch]
            out += [tuple(r)[1:] for r in p.handleInputRows(("k",), iter(rows), Clock(mark))]
            mark = max(mark, *(us // 1000 - 5000 for us, _, _ in batch))
        mark = 1 << 50 if batch is None else mark
        for t in sorted(store.timers):
            if t <= mark and t in store.timers:
                store.timers.discard(t)
                out += [tuple(r)[1:] for r in p.handleExpiredTimer(("k",), Clock(mark), None)]
    return out, store


def shuffled(rng, rows):
    """Batches whose rows come up to five seconds out of order."""
    rows = sorted(rows, key=lambda r: r[0] + rng.random() * 4e6)
    cuts = sorted(rng.sample(range(len(rows) + 1), 4))
    return [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]


def test_folds_do_not_depend_on_batches():
    rng = random.Random(1)
    for _ in range(60):
        at, rows = 0, []
        for i in range(40):
            at += rng.choice((500_000, 2_000_000, 30_000_000))
            rows.append((at, i, {"seq": i, "item": i, "kind": rng.choice(("delta", "delta", "end", "note")), "text": f"<{i}>", "value": str(i)}))
        groups, last = [], None
        for us, i, _ in rows:
            if last is None or us - last >= 10_000_000:
                groups.append([])
            groups[-1].append(i)
            last = us
        got, store = fed(stateful.Debounce(10_000_000), ["k", "flushed", "entries"], shuffled(rng, rows))
        assert got == [(",".join(map(str, g)), len(g)) for g in groups] and not store.rows and store.value is None and not store.timers
        got, store = fed(stateful.Expiring(10_000_000), ["k", "seq", "updates", "before"], shuffled(rng, rows))
        assert got == [(i, n, str(g[n - 2]) if n > 1 else None) for g in groups for n, i in enumerate(g, 1)] and store.value is None
        want, held = [], []
        for (us, i, row), back in zip(rows, [None, *rows]):
            if held and us - back[0] >= 10_000_000:
                want.append((held[0], "".join(f"<{j}>" for j in held), len(held), False))
                held = []
            if row["kind"] == "delta":
                held.append(i)
                continue
            if row["kind"] == "end" and held:
                held.append(i)
                want.append((held[0], "".join(f"<{j}>" for j in held), len(held), True))
            else:
                want += [(held[0], "".join(f"<{j}>" for j in held), len(held), False)] if held else []
                want.append((i, row["text"], 1, row["kind"] == "end"))
            held = []
        want += [(held[0], "".join(f"<{j}>" for j in held), len(held), False)] if held else []
        got, store = fed(stateful.Coalesce(10_000_000), ["k", "seq", "text", "merged", "ended"], shuffled(rng, rows))
        assert got == want and store.value is None


def test_state_is_empty_at_the_end(spark, tmp_path):
    from strandmill.plans.streams import BEAT, sliced

    p = str(tmp_path / "out")
    out = sinks.drained(spark, stateful.debounced(sliced(spark, SF), "user_id", "ts", "event_id", "event_id", 3600), p)
    assert out.select("batch").distinct().count() >= 3 and out.count() > 0
    for name in ("waiting", "state"):
        left = spark.read.format("statestore").option("stateVarName", name).load(f"{p}-state")
        assert left.filter(F.col("key.user_id") != BEAT).count() == 0


def test_the_store_forgets_after_its_time(spark, tmp_path):
    src = str(tmp_path / "in")
    for seconds, last in ((3600, 1), (2, None)):
        p = str(tmp_path / f"out{seconds}")
        spark.createDataFrame([(7, 1)], "k long, n long").coalesce(1).write.mode("overwrite").parquet(src)
        stream = lambda: stateful.remembered(spark.readStream.schema("k long, n long").parquet(src), "k", "n", seconds)  # noqa: E731, B023
        sinks.drain(stream(), p, idle=False)
        time.sleep(3)
        spark.createDataFrame([(7, 2)], "k long, n long").coalesce(1).write.mode("append").parquet(src)
        rows = {tuple(r)[:3] for r in sinks.drained(spark, stream(), p, idle=False).collect()}
        assert rows == {(7, 1, None), (7, 2, last)}


def test_a_batch_written_twice_is_there_once(spark, tmp_path):
    handle = sinks.once(str(tmp_path / "b"))
    for n in (3, 5):
        handle(spark.range(n), 0)
    handle(spark.range(2), 1)
    assert spark.read.parquet(str(tmp_path / "b")).count() == 7


def test_replay_adds_only_what_is_not_there(spark):
    rng = random.Random(2)
    rows = [([rng.choice("ab") for _ in range(rng.randrange(6))], [rng.choice("ab") for _ in range(rng.randrange(6))]) for _ in range(200)]

    def want(h, r):
        k = next(k for k in range(min(len(h), len(r)), -1, -1) if h[len(h) - k :] == r[:k])
        return h + r[k:]

    got = spark.createDataFrame(rows, "h array<string>, r array<string>").select("h", "r", sinks.resumed(F.col("h"), F.col("r")).alias("x")).collect()
    assert all(g["x"] == want(g["h"], g["r"]) for g in got)


def test_broken_run_goes_on(spark):
    got = QUERIES["r11_stream_recovery"](spark, SF)
    assert got.count() == got.distinct().count() == spark.read.parquet(f"{SF}/events.parquet").count()


def test_slices_of_several_files_are_batches(spark, tmp_path):
    """Two files a slice and more: a batch is a slice, nothing is late, and groups are those of the batch form."""
    from strandmill.plans.streams import BEAT, SLICES, sliced

    out = sinks.drained(spark, stateful.progress(sliced(spark, SF, rows_a_file=60), "user_id", "ts", "event_id", "event_type", 12 * 3600), str(tmp_path / "out")).filter(F.col("user_id") != BEAT)
    want = QUERIES["r9_stream_expiry"](spark, SF)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, out.select("user_id", "seq", "updates", "before").collect())) == sorted(map(key, want.collect()))
    assert SLICES <= out.select("batch").distinct().count() <= SLICES + 2


def test_keys_of_a_block_share_calls_of_the_store():
    """Forty keys in a group give what each gives alone, with no more calls of the store than one."""
    rng, calls = random.Random(3), []

    class Counted(Store):
        def __getattribute__(self, name):
            if name in ("get", "put", "clear", "registerTimer", "deleteTimer"):
                calls.append(name)
            return super().__getattribute__(name)

    import json

    def rows(keys):
        return [{"__us": us, "__seq": i, "__row": json.dumps({"seq": i, "item": i, stateful.OWN: k})} for us, i, k in keys]

    data = [(rng.randrange(60) * 1_000_000, i, rng.randrange(40)) for i in range(400)]
    alone = {k: fed(stateful.Debounce(5_000_000), ["k", "flushed", "entries"], [[(us, i, {"seq": i, "item": i}) for us, i, o in data if o == k]])[0] for k in range(40)}
    p, store = stateful.InOrder(stateful.Debounce(5_000_000), ["k", "flushed", "entries"]), Counted()
    p.init(store)
    out = []
    for part in (data[:200], data[200:]):
        out += p.handleInputRows((0,), iter(rows(part)), Clock(0))
    out += p.handleExpiredTimer((0,), Clock(1 << 50), None)
    assert {k: [tuple(r)[1:] for r in out if r[0] == k] for k in range(40)} == alone
    assert not store.rows and store.value is None and len(calls) <= 12


def test_the_store_forgets_keys_of_a_block_one_by_one():
    class Batch:
        def __init__(self, ms):
            self.getCurrentProcessingTimeInMs = lambda: ms

    class Value:
        held = None
        get = lambda self: self.held
        update = lambda self, v: setattr(self, "held", v)

    class Handle:
        getValueState = lambda self, *a, **kw: Value()

    p = stateful.Remember(1000, ["k", "seq", "last"])
    p.init(Handle())
    seen = lambda ms, *rows: [tuple(r) for r in p.handleInputRows((0,), iter([{stateful.OWN: k, "__seq": n} for k, n in rows]), Batch(ms))]
    assert seen(0, (1, 10), (2, 20)) == [(1, 10, None), (2, 20, None)]
    assert seen(600, (2, 21)) == [(2, 21, 20)]
    assert seen(1000, (1, 11), (2, 22)) == [(1, 11, None), (2, 22, 21)]


def test_blocks_of_keys_give_what_single_keys_give(spark, tmp_path):
    from strandmill.plans.streams import BEAT, sliced

    got = []
    for together in (1, 64):
        out = sinks.drained(spark, stateful.progress(sliced(spark, SF), "user_id", "ts", "event_id", "event_type", 12 * 3600, together=together), str(tmp_path / f"out{together}"))
        got.append(sorted(map(str, out.filter(F.col("user_id") != BEAT).drop("batch").collect())))
    assert got[0] == got[1] and got[0]
