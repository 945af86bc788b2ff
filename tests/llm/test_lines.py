import hashlib

from strandmill.llm.lines import dedup_lines, line_key


def brute(rows, least=20, docs=3):
    where = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            k = line_key(line.encode()).decode()
            if len(k) >= least and d is not None:
                where.setdefault(k, set()).add(d)
    keep = {k: max(v) for k, v in where.items() if len(v) >= docs}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if d is None or keep.get(line_key(x.encode()).decode(), d) == d]
        out.append((d, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=repr)


LONG = "A line of more than twenty characters"
ROWS = (
    [(i, f"{LONG}\n own line of document number {i} here\n{LONG.upper()} \nshort") for i in range(40)]
    + [(100, None), (101, ""), (102, "\n\n"), (103, "é" * 20), (104, "É" * 20 + "\r"), (105, "é" * 20 + "\t"), (106, "é" * 20 + " "), (None, LONG), (None, None)]
    + [(200, "x" * 2_000_000 + "\n" + LONG), (3, "twice the same row, it is one document"), (3, "twice the same row, it is one document"), (4, "twice the same row, it is one document")]
)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return sorted([(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in dedup_lines(df, **kw).collect()], key=repr)


def test_equals_brute_force(spark):
    assert run(spark, ROWS) == brute(ROWS)


def test_join_path_equals_broadcast_path(spark):
    assert run(spark, ROWS, max_sent=0) == brute(ROWS)


def test_small_filter_only_lets_more_through(spark):
    assert run(spark, ROWS, max_bits=1 << 16) == brute(ROWS)


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([(1, "a", 7, "x")], "doc_id long, text string, n_lines int, block string")
    row = dedup_lines(df).first()
    assert (row["n_lines"], row["n_dropped"], row["block"]) == (1, 0, "x")


def test_query_digest(spark):
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
