"""Single validators of a formula, each an array of what it finds, on a stream of LaTeX tokens.

A token is a command, an escaped sign, a run of letters or digits, or one other sign. Folds
over the stream know depth and what came before; nothing is counted over the raw text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound

TOKEN = r"\\[a-zA-Z]+|\\(?s:.)|[a-zA-Z]+|[0-9]+|\S"
#: Commands that are known.
COMMANDS = """alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau upsilon phi chi psi omega
Gamma Delta Theta Lambda Xi Pi Sigma Phi Psi Omega varepsilon vartheta varpi varrho varsigma varphi
leq geq neq approx equiv propto sim simeq triangleq doteq mapsto implies iff colon times cdot pm mp div ast star circ
oplus ominus otimes odot oslash leftarrow rightarrow uparrow downarrow Leftarrow Rightarrow Uparrow Downarrow leftrightarrow Leftrightarrow
sum prod coprod int iint iiint oint bigcap bigcup bigwedge bigvee sin cos tan cot sec csc arcsin arccos arctan
log ln exp lim det gcd lcm min max argmin argmax sup inf dim ker deg arg mod frac dfrac tfrac sqrt binom
mathbf mathcal mathbb boldsymbol mathit mathrm mathsf mathtt text textrm partial nabla infty emptyset forall exists
in notin subset supset subseteq supseteq cap cup wedge vee langle rangle Pr left right big Big bigg Bigg
hat tilde bar vec dot ddot begin end tag label notag quad qquad ni mid parallel bot top triangle
Box square diamond clubsuit spadesuit heartsuit diamondsuit ell wp aleph hbar imath jmath triangleleft triangleright
setminus smallsetminus lfloor rfloor lceil rceil textstyle displaystyle scriptstyle scriptscriptstyle""".split()
#: Words of sentences.
WORDS = """the and for are was not but all has had have can may our their this that with from they were been will would using based given
shown found used made taken seen said proposed defined described obtained derived computed method system model result paper figure
table section problem approach algorithm scheme strategy technique performance simulation experiment analysis scenario respectively
therefore however moreover furthermore denotes represents indicates corresponds follows satisfies line lines where which each such""".split()
#: Signs between which short tokens stand, and operators.
SIGNS, OPERATORS = r"[\[\]{}()|,.;:+\-*/=<>≤≥≠≈≡∈⊂⊆∪∩∫∑∏∇∂⋅×±−]", r"[=+\-*/<>≤≥≠≈≡∈⊂⊆∪∩]"


def tokens(latex: Column) -> Column:
    return F.regexp_extract_all(latex, F.lit(TOKEN), F.lit(0))


def _bare(latex: Column) -> Column:
    """Without commands and the groups right behind them."""
    return F.regexp_replace(latex, r"\\[a-zA-Z]+(?:\{[^}]*\})*", " ")


def _blank(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+", -1), lambda t: t != "")


def _indexed(latex: Column) -> Column:
    return latex.rlike("[_^]")


def braces(latex: Column) -> Column:
    """"unexpected" for every brace that closes nothing, and "unclosed:n" for those left open."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("over"))

    def step(acc: Column, t: Column) -> Column:
        depth = acc["depth"] + F.when(t == "{", 1).when(t == "}", -1).otherwise(0)
        return F.struct(F.greatest(depth, F.lit(0)).alias("depth"), (acc["over"] + (depth < 0).cast("int")).alias("over"))

    def told(acc: Column) -> Column:
        left = F.when(acc["depth"] > 0, F.array(F.concat(F.lit("unclosed:"), acc["depth"].cast("string")))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.array_repeat(F.lit("unexpected"), acc["over"]), left)

    return F.aggregate(tokens(latex), start, step, told)


def commands(latex: Column) -> Column:
    """Commands of two letters or more that are not known, also right behind a line break, where a backslash is often lost."""
    named = F.regexp_extract_all(latex, F.lit(r"\\([a-zA-Z]{2,}|\{E\})"), F.lit(1))
    return F.filter(named, lambda t: ~t.isin(*COMMANDS))


def garbled(latex: Column) -> Column:
    """Runs of three or more tokens with one or two letters, where no index is marked."""
    parts = _blank(F.regexp_replace(F.regexp_replace(_bare(latex), r"\\[^a-zA-Z]", " "), SIGNS, " "))
    letters = F.filter(F.transform(parts, lambda t: F.regexp_replace(t, "[^a-zA-Z]", "")), lambda t: t != "")
    # Short ones between blanks, longer ones as breaks: runs are what stands between breaks.
    lined = F.array_join(F.transform(letters, lambda t: F.when(F.length(t) <= 2, t).otherwise("\n")), " ")
    runs = F.filter(F.transform(F.split(lined, "\n", -1), lambda r: F.trim(r)), lambda r: F.size(F.split(r, " ")) >= 3)
    return F.when(_indexed(latex), F.array().cast("array<string>")).otherwise(runs)


def prose(latex: Column) -> Column:
    """Words of a sentence with no sign of LaTeX within three characters."""
    word = r"(?i)(?<![\p{L}\p{N}_])(?:" + "|".join(WORDS) + r")(?![\p{L}\p{N}_])"

    def found(t: Column) -> Column:
        from .latex import placed

        alone = lambda m: ~t.substr(F.greatest(m["start"] - 3, F.lit(0)) + 1, F.least(m["start"], F.lit(3)) + F.length(m["hit"]) + 3).rlike(r"[_^{}\\]")
        return F.transform(F.filter(placed(t, word), alone), lambda m: m["hit"])

    return bound(latex, found)


def naked_operator(latex: Column) -> Column:
    """A single operator with fewer than two letters or digits beside it."""
    bare = _bare(latex)
    rest = F.regexp_count(bare, F.lit("[a-zA-Z]")) + F.regexp_count(bare, F.lit("[0-9]"))
    op = F.regexp_extract_all(bare, F.lit(OPERATORS), F.lit(0))
    return F.when((F.size(op) == 1) & (rest < 2), op).otherwise(F.array().cast("array<string>"))


def lost_index(latex: Column) -> Column:
    """Two short tokens among three or more, where no index is marked."""
    parts = _blank(F.regexp_replace(_bare(latex), SIGNS, " "))
    short = F.filter(parts, lambda t: F.length(F.regexp_replace(t, "[^a-zA-Z0-9]", "")).between(1, 2))
    return F.when(~_indexed(latex) & (F.size(short) >= 2) & (F.size(parts) >= 3), short).otherwise(F.array().cast("array<string>"))


VALIDATORS = {"braces": braces, "commands": commands, "garbled": garbled, "prose": prose, "naked_operator": naked_operator, "lost_index": lost_index}


def _named(name: str):
    return lambda e: F.concat(F.lit(f"{name}: "), e)


def errors(latex: Column) -> Column:
    """Array of "validator: finding" of all validators; empty for a formula that passes. Null of null."""
    told = [F.transform(check(latex), _named(name)) for name, check in VALIDATORS.items()]
    return F.when(latex.isNotNull(), F.concat(*told))
