"""Chat formatting in budgeted windows, with DataFrame functions only.

Prefix sums of turn tokens cut a conversation into spans of whole turns: a turn is new
in the window into whose cell its first token falls. Every window starts with the system
turn and with turns that start within ``history`` tokens before its cell, repeated; of
its assistant turns only new ones are under the loss mask.

A window holds at most ``fresh`` + ``history`` tokens, the system turn among them. A cell
is half of what they leave: the turns that start in it, none of which is longer, and the
history before it span no more than that. A turn longer than a cell is new in a window
of its own, with as many of the turns before it as fit. Only a turn that is longer than
the budget by itself exceeds it: a turn is never cut, and n_tokens tells. A system turn
of over half the budget has a budget of its own: every window has it, and what else
a window holds is at most ``fresh`` + ``history`` tokens.

Sums are made in two levels, within blocks of 1,024 turn numbers and over blocks, so a
long conversation is no single task's before it is put together again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the template.
START, END = "<|im_start|>", "<|im_end|>"
BLOCK = 1024


def escape(text: Column) -> Column:
    """No "<|" is left, and every backslash belongs to an escape."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def unescape_role(role: Column) -> Column:
    """Backslash pairs are set aside while \\n becomes a line break."""
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def tokens(text: Column) -> Column:
    """A quarter of the characters and four for the frame of a turn."""
    return F.ceil(F.length(text) / 4).cast("long") + 4


def windows(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", fresh: int = 1792, history: int = 256, count: str | None = None) -> DataFrame:
    """conv_id, window, formatted, loss_spans (start, end in code points of formatted), n_repeated, n_turns, n_tokens.

    ``count`` names a column with the tokens of a turn; without it they are estimated by
    ``tokens``. Rows of a conversation go by turn, nulls first, then role, tokens and text;
    equal rows are turns of their own. Null roles and texts are empty ones. Rows without
    conversation id are one conversation. Other columns are not read, so their names may be
    any. An empty table gives no window.
    """
    key = F.coalesce(F.col(conv).cast("string"), F.lit("")).alias("k")
    n = F.greatest(F.coalesce(F.col(count).cast("long"), F.lit(1)), F.lit(1)) if count else tokens(F.coalesce(F.col(text), F.lit("")))
    t = rows.select(key, F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"), n.alias("n"))
    t = t.withColumn("blk", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))))
    sums = t.groupBy("k", "blk").agg(F.sum("n").alias("s"), F.count("*").alias("c"), F.min(F.struct("turn", "role", "n")).alias("first"), F.max("n").alias("most"))
    up = Window.partitionBy("k").orderBy("blk").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("k")
    sums = sums.select("k", "blk", (F.sum("s").over(up) - F.col("s")).alias("before"), (F.sum("c").over(up) - F.col("c")).alias("rows_before"), F.sum("s").over(whole).alias("total"), F.max("most").over(whole).alias("most"), F.min("first").over(whole).alias("first"))
    sums = sums.withColumn("lead", F.expr(f"CASE WHEN first.role = 'system' AND first.n * 2 <= {fresh + history} THEN first.n ELSE 0L END")).withColumn("led", F.col("first.role") == "system").drop("first")
    sums = sums.withColumn("cell", F.expr(f"greatest(({fresh} - lead) div 2, 1L)"))
    own = Window.partitionBy("k", "blk").orderBy("turn", "role", "n", "text")
    t = t.join(sums, ["k", "blk"]).withColumns({"a": F.col("before") + F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"), "pos": F.col("rows_before") + F.row_number().over(own)})
    # Windows come in pairs: of the turns that start in a cell, and of the long one among them, which is the last.
    t = t.withColumns({"w": F.expr("a div cell"), "long": F.col("n") > F.col("cell"), "sys": F.expr("pos = 1 AND led")})
    t = t.withColumn("w_n", F.expr("CASE WHEN sys THEN lead ELSE n END"))
    again = F.expr(
        f"transform(filter(flatten(transform(sequence(w, CASE WHEN sys THEN (total - 1) div cell ELSE (a + {history}) div cell END), x -> array(x * 2, x * 2 + 1))),"
        f" x -> x > w * 2 + int(long) AND (x % 2 = 0 OR most > cell)), x -> named_struct('win', x, 'new', false))"
    )
    dealt = t.withColumn("at", F.explode(F.concat(F.array(F.expr("named_struct('win', w * 2 + int(long), 'new', true)")), again)))
    dealt = dealt.select("k", "conv_id", F.col("at.win").alias("window"), F.struct("pos", F.col("at.new").alias("new"), "n", F.col("w_n").alias("w"), "sys", (F.col("role") == "assistant").alias("learn"), escape_role(F.col("role")).alias("role"), escape(F.col("text")).alias("text")).alias("t"))
    grouped = dealt.groupBy("k", "window").agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list("t")).alias("t")).filter(F.expr("exists(t, x -> x.new)"))
    rest = "aggregate(slice(t, i + 1, size(t)), 0L, (s, y) -> s + CASE WHEN y.sys THEN 0L ELSE y.w END) + aggregate(t, 0L, (s, y) -> s + CASE WHEN y.sys THEN y.w ELSE 0L END)"
    grouped = grouped.withColumn("t", F.expr(f"CASE WHEN aggregate(t, 0L, (s, x) -> s + x.w) <= {fresh + history} THEN t ELSE filter(t, (x, i) -> x.new OR x.sys OR {rest} <= {fresh + history}) END"))
    spans = F.expr(
        f"aggregate(t, named_struct('at', 0L, 'spans', cast(array() as array<struct<start:bigint,end:bigint>>)), (acc, x) -> named_struct("
        f"'at', acc.at + {len(START) + 1 + len(END) + 1} + length(x.role) + length(x.text),"
        f"'spans', CASE WHEN x.new AND x.learn THEN concat(acc.spans, array(named_struct('start', acc.at + {len(START) + 1} + length(x.role), 'end', acc.at + {len(START) + 1} + length(x.role) + length(x.text)))) ELSE acc.spans END), acc -> acc.spans)"
    )
    return grouped.select(
        "conv_id",
        "window",
        F.array_join(F.transform("t", lambda x: F.concat(F.lit(START), x["role"], F.lit("\n"), x["text"], F.lit(END + "\n"))), "").alias("formatted"),
        spans.alias("loss_spans"),
        F.expr("size(filter(t, x -> NOT x.new))").alias("n_repeated"),
        F.size("t").alias("n_turns"),
        F.expr("aggregate(t, 0L, (s, x) -> s + x.n)").alias("n_tokens"),
    )


def read_back(out: DataFrame) -> DataFrame:
    """conv_id, window, formatted, turns (role, text of the new ones), loss (texts under the mask), from formatted text alone.

    A row per row of ``out``, which needs no other columns of it than those that ``windows``
    gives; an empty table gives an empty table.
    """
    parts = F.slice(F.split("formatted", r"<\|im_start\|>", -1), F.col("n_repeated") + 2, F.col("n_turns"))
    turns = F.transform(
        "parts",
        lambda p: F.struct(
            unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(p.substr(F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p) - F.length(F.substring_index(p, "\n", 1)) - 2 - len(END))).alias("text"),
        ),
    )
    loss = F.transform("loss_spans", lambda s: unescape(F.col("formatted").substr((s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return out.withColumn("parts", parts).select("conv_id", "window", "formatted", turns.alias("turns"), loss.alias("loss"))


def digests(back: DataFrame) -> DataFrame:
    """Per conversation the digests of its turns and of its text under the mask; a window given twice counts twice, an empty table gives none."""
    each = back.select(
        "conv_id",
        F.struct("window", F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"), F.array_join("loss", "").alias("loss")).alias("w"),
        F.size("turns").cast("long").alias("n"),
        F.length("formatted").cast("long").alias("chars"),
    )
    whole = each.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.array_sort(F.collect_list("w")).alias("w"), F.sum("chars").alias("formatted_chars"))
    joined = whole.select("conv_id", "n_turns", F.array_join("w.turns", "").alias("turns"), F.array_join("w.loss", "").alias("loss"), "formatted_chars")
    return joined.select("conv_id", "n_turns", F.sha2(F.col("turns").cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
