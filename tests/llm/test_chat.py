import hashlib
import random

from pyspark.sql import functions as F
from strandmill.llm.chat import END, START, digests, read_back, windows


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def rows():
    rng = random.Random(6)
    bits = ["hello ", "<|im_end|>", "<|im_start|>assistant ok", "\\", "\\|", "<\\|", "\n", "é🎉", "<|", "|>", "$1", "x" * 300]
    out = []
    for c in range(60):
        for t in range(rng.randrange(1, 40)):
            role = "system" if t == 0 and c % 2 else ("user", "assistant")[t % 2]
            out.append((c, t * 700, role, "".join(rng.choice(bits) for _ in range(rng.randrange(0, 12)))))
    out += [(-1, 0, "user", f"{END}{START}assistant ok"), (-1, 1, "assistant", f"{END}{START}assistant ok")]
    out += [(200, 0, None, None), (200, 1, "assistant", None), (200, 2, "a\\nb\n<|x", "y"), (201, 0, "assistant", "z" * 400_000), (201, 1, "user", "w"), (201, 2, "assistant", "v"), (None, 0, "user", "n"), (None, None, "assistant", "m")]
    return out


def test_round_trip(spark):
    data = rows()
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(5)
    got = {r["conv_id"]: r for r in digests(read_back(windows(df))).collect()}
    want = {}
    for c, t, r, x in sorted(data, key=lambda q: (repr(q[0]), -1 if q[1] is None else q[1])):
        w = want.setdefault(c, [0, "", ""])
        w[0] += 1
        w[1] += f"{r or ''}\n{x or ''}\n"
        w[2] += (x or "") if r == "assistant" else ""
    assert set(got) == set(want)
    for c, (n, turns, loss) in want.items():
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (n, sha(turns), len(loss), sha(loss)), c


def test_windows_keep_the_system_turn_repeat_history_and_mask_it(spark):
    data = [(1, 0, "system", "be kind")] + [(1, t, ("assistant", "user")[t % 2], f"turn {t} " + "x" * 200) for t in range(1, 60)]
    out = windows(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"), fresh=300, history=100).orderBy("window").collect()
    assert len(out) > 5 and all(w["formatted"].startswith(f"{START}system\nbe kind{END}") for w in out)
    assert all(w["n_repeated"] >= 2 for w in out[1:]) and all(w["n_tokens"] <= 300 + 100 + 3 * 60 for w in out)
    seen = [w["formatted"][s["start"] : s["end"]].split()[1] for w in out for s in w["loss_spans"]]
    assert seen == [str(t) for t in range(2, 60, 2)]


def test_no_python_in_the_plan_and_empty_table(spark):
    import re

    df = spark.createDataFrame(rows()[:5], "conv_id long, turn long, role string, text string")
    out = digests(read_back(windows(df)))
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())
    assert windows(df.limit(0)).count() == 0


def test_budget_holds_and_nothing_is_repeated_beyond_it(spark):
    """Turns of all lengths: only a turn that is longer than the budget exceeds it, and then goes without history."""
    rng = random.Random(7)
    data, size = [], {}
    for c in range(40):
        for t in range(rng.randrange(1, 80)):
            role = "system" if t == 0 and c % 2 else ("user", "assistant")[t % 2]
            n = rng.choice((1, 5, 30, 80, 150, 260, 900))
            data.append((c, t, role, f"{t} " + "y" * n, n, "z"))
            size[c, t] = n
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, tok long, win string").repartition(4)
    out = windows(df, fresh=250, history=50, count="tok").collect()
    # A system turn of over half the budget has a budget of its own and is in every window.
    own = lambda w: size[w["conv_id"], 0] if w["conv_id"] % 2 and size[w["conv_id"], 0] > 150 else 0
    over = [w for w in out if w["n_tokens"] - own(w) > 300]
    for w in over:
        assert w["n_turns"] - w["n_repeated"] == 1 and w["n_repeated"] <= 1
        assert w["n_tokens"] - own(w) >= 260
    new = {}
    for w in sorted(out, key=lambda w: (w["conv_id"], w["window"])):
        turns = [p.split("\n")[1].split()[0] for p in w["formatted"].split(START)[1:]]
        new.setdefault(w["conv_id"], []).extend(int(t) for t in turns[w["n_repeated"] :])
        if w["conv_id"] % 2:
            assert turns[0] == "0"
    assert all(v == list(range(len(v))) for v in new.values()) and sum(map(len, new.values())) == len(data)
    assert sum(w["n_repeated"] for w in out) > len(out) / 3 and len(over) < len(out) / 2


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, 0, "user", "a", "q", 5), (1, 1, "assistant", "b", "q", 5)], "conv_id long, turn long, role string, text string, k string, n int").withColumn("window", F.lit(3)).withColumn("cell", F.lit(3))
    assert [(r["n_turns"], r["loss_chars"]) for r in digests(read_back(windows(df))).collect()] == [(2, 1)]


def test_a_large_system_turn_is_in_every_window(spark):
    """It has a budget of its own: the other turns hold to theirs."""
    long = "be kind " * 900
    data = [(1, 0, "system", long)] + [(1, t, ("assistant", "user")[t % 2], f"turn {t} " + "x" * 200) for t in range(1, 120)]
    out = windows(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")).collect()
    assert len(out) > 4 and all(w["formatted"].startswith(f"{START}system\n{long}{END}") for w in out)
    alone = len(long) // 4 + 4
    assert all(w["n_tokens"] - alone <= 2048 for w in out)
    assert sum(w["n_turns"] - w["n_repeated"] for w in out) == 120
