"""The source of session headers with its pushed filters, hooks around batches, and single validators against plain Python."""

import json
import random
import re

from pyspark.sql import functions as F

from strandmill.functions import validators as V
from strandmill.sources.headers import session_headers
from strandmill.streaming import hooks


def test_headers_only_of_what_is_asked_for(spark, tmp_path):
    for i in range(150):
        lines = [json.dumps({"_type": "metadata", "key": f"k{i}", "created_at": str(i)}), *["x" * 50] * 5]
        (tmp_path / f"k{i}.jsonl").write_text("\n".join(lines if i % 10 else lines[1:]))
    (tmp_path / "empty.jsonl").write_text("")
    (tmp_path / "other.txt").write_text("{}")
    whole = session_headers(spark, f"file://{tmp_path}")
    assert whole.count() == 135 and whole.rdd.getNumPartitions() == 3
    some = whole.filter(F.col("key").isin("k3", "k77", "k20", "none") & (F.length("created_at") > 1))
    assert [tuple(r)[:2] for r in some.collect()] == [("k77", "77")]
    plan = some._jdf.queryExecution().executedPlan().toString()
    # The reader has taken the filter on the key; the other one is left to Spark.
    left = next(line for line in plan.split("\n") if "Filter (" in line)
    assert "created_at" in left and "key" not in left, plan
    assert session_headers(spark, f"file://{tmp_path}").filter("key = 'k5' AND key = 'k6'").count() == 0


def test_hooks_do_not_stop_each_other():
    told = []

    class Fails:
        def batch(self, *args):
            raise ValueError

        ended = started = batch

    class Tells:
        def batch(self, run, number, rows):
            told.append((number, rows))

    h = hooks.Hooks(Fails(), Tells(), object())
    h._tell("started", "r")
    h._tell("batch", "r", 3, 7)
    h._tell("ended", "r", None)
    assert told == [(3, 7)]


def plain(latex):
    out = []
    depth = over = 0
    for t in re.findall(r"\\[a-zA-Z]+|\\.|\S", latex, re.DOTALL):
        depth += (t == "{") - (t == "}")
        over += depth < 0
        depth = max(depth, 0)
    out += ["braces: unexpected"] * over + [f"braces: unclosed:{depth}"] * (depth > 0)
    out += [f"commands: {c}" for c in re.findall(r"\\([a-zA-Z]{2,}|\{E\})", latex) if c not in V.COMMANDS]
    bare = re.sub(r"\\[a-zA-Z]+(?:\{[^}]*\})*", " ", latex)
    if not re.search("[_^]", latex):
        run = []
        for t in [*re.sub(V.SIGNS, " ", re.sub(r"\\[^a-zA-Z]", " ", bare)).split(), "stop"]:
            t = re.sub("[^a-zA-Z]", "", t)
            if len(t) > 2:
                out += [f"garbled: {' '.join(run)}"] * (len(run) >= 3)
                run = []
            elif t:
                run.append(t)
    for m in re.finditer(r"(?i)(?<![^\W])(?:" + "|".join(V.WORDS) + r")(?![^\W])", latex):
        if not re.search(r"[_^{}\\]", latex[max(0, m.start() - 3) : m.end() + 3]):
            out.append(f"prose: {m[0]}")
    ops = re.findall(V.OPERATORS, bare)
    out += [f"naked_operator: {o}" for o in ops if len(ops) == 1 and len(re.findall("[a-zA-Z0-9]", bare)) < 2]
    parts = re.sub(V.SIGNS, " ", bare).split()
    short = [t for t in parts if 1 <= len(re.sub("[^a-zA-Z0-9]", "", t)) <= 2]
    out += [f"lost_index: {t}" for t in short if len(short) >= 2 and len(parts) >= 3 and not re.search("[_^]", latex)]
    return out


def test_validators_equal_plain_python(spark):
    rng = random.Random(4)
    bits = ["{", "}", "\\{", "\\alpha", "\\foo", "\\frac{a}{b}", "\\x", "ab", "the", "Where", "model", "x", "12", " ", " ", " ", "=", "+", "_", "^", "\\\\", "é", "a b c", "(", ","]
    rows = ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(1200)] + ["", " "]
    for r in spark.createDataFrame([(r,) for r in rows], "x string").select("x", V.errors(F.col("x")).alias("e")).collect():
        assert r["e"] == plain(r["x"]), r["x"]
    assert spark.createDataFrame([(None,)], "x string").select(V.errors(F.col("x")).alias("e")).first()["e"] is None
