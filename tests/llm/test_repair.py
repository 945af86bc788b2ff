import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from strandmill.llm.repair import damaged, fault, piece, repair, repair_conversations, transfer

GRAMMAR = re.compile("(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """(cost, audit, repaired) by trying all edits that cost no more than deleting everything."""
    best = [(2 * len(rows), "D" * len(rows), "")]
    seen, faults = set(), []
    for role, text in rows:
        faults.append(fault(text, (role, text) in seen))
        seen.add((role, text))

    def go(i, cost, audit, out):
        if (cost, audit) > best[0][:2] and cost >= best[0][0]:
            return
        if i == len(rows) and GRAMMAR.fullmatch("".join(x[:1] or "-" for x, _ in out)):
            best[0] = min(best[0], (cost, audit, "\n".join(f"{r}:{t}" for r, t in out)))
        if i < len(rows):
            role, text = rows[i]
            go(i + 1, cost + 2, audit + "D", out)
            if faults[i] in ("", "truncated"):
                more = cost + 5 * (faults[i] == "truncated")
                go(i + 1, more, audit + "K", [*out, (role, text)])
                for r in ("user", "assistant"):
                    go(i + 1, more + 1, audit + "R", [*out, (r, text)])
        for r in ("user", "assistant"):
            go(i, cost + 5, audit + "I", [*out, (r, "")])

    go(0, 0, "", [])
    return best[0]


def told(rows):
    """The row of the result for rows (turn, role, text) in order."""
    seen, count, turns = set(), dict.fromkeys(("", "blank", "duplicate", "truncated"), 0), {t for t, _, _ in rows if t is not None}
    for _, role, text in rows:
        count[fault(text, (role, text) in seen)] += 1
        seen.add((role, text))
    wrong = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, text = cheapest([r[1:] for r in rows])
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, count["blank"], count["duplicate"], count["truncated"], wrong, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def made(rng, n):
    return [(rng.choice((None, *range(9))), rng.choice(("system", "user", "assistant", "assistant", "user", "tool", "")), rng.choice(("a.", "b?", "c!", "d", " \n", "", "e. ", "f;", "g."))) for _ in range(n)]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def test_equals_trying_all_edits(spark):
    rng = random.Random(11)
    all_ = {c: ordered(made(rng, rng.randrange(1, 5))) for c in range(250)}
    df = spark.createDataFrame([(c, *r) for c, rows in all_.items() for r in rows], SCHEMA).repartition(4)
    for long_at in (4096, 2):
        got = {int(r["k"]): tuple(r)[1:] for r in repair_conversations(df, long_at=long_at).collect()}
        assert got == {c: told(rows) for c, rows in all_.items()}


def test_pieces_give_what_one_search_gives():
    rng = random.Random(3)
    for _ in range(30):
        turns = [(rng.choice("suat"), rng.choice(("", "", "blank", "truncated"))) for _ in range(rng.randrange(260, 700))]
        whole = piece(turns)
        assert transfer(turns) == whole
        assert repair(turns) == min(x for x in (whole[0][0], whole[0][3]) if x)


def test_long_conversation_dealt_out(spark):
    """One conversation of many ranges, with repeated rows, equals the same in one task."""
    rng = random.Random(4)
    rows = [(7, t // 2, *made(rng, 1)[0][1:]) for t in range(1500)] + [(7, 900, "user", "again.")] * 400 + [(8, 1, "user", "x.")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    one, many = (sorted(map(tuple, repair_conversations(df, long_at=n).collect())) for n in (10_000, 50))
    assert one == many and len(one) == 2 and len(one[0][7].replace("I", "")) == 1900


def test_nulls_ties_and_empty_tables(spark):
    rows = [(None, None, None, None), (None, 1, "user", "hi."), (None, 1, "assistant", "yes."), (1, 5, "user", "q?"), (1, 5, "user", "q?"), (1, 6, "assistant", "a.")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("k", F.lit("clash")).withColumn("cost", F.lit(1))
    got = {r["k"]: (r["gaps"], r["blank"], r["duplicate"], r["illegal"], r["cost"], r["audit"]) for r in repair_conversations(df).collect()}
    assert got == {" ": (0, 1, 0, 1, 4, "DRR"), "1": (0, 0, 1, 1, 2, "KDK")}
    assert repair_conversations(df.limit(0)).count() == 0 and damaged(df.limit(0)).count() == 0


def test_damage_follows_the_checksum(spark):
    rows = [(c, t, "assistant", f"One {t}. Two? Three!") for c in (1, 2, None) for t in (*range(60), None)]
    want = []
    for c, t, role, text in rows:
        what = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if what:
            row = (c, t, "user" if what == 4 else role, "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text)
            want += [row] * (2 if what == 3 else 1)
    assert sorted(map(tuple, damaged(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr) == sorted(want, key=repr)
