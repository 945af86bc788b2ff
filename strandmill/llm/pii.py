"""Personal data by candidate gradient boosting, with DataFrame functions only.

Four base detectors (email, ip, card, phone) give spans that always stay. Beside them
high-recall generators propose candidates that may overlap each other and the base spans;
boosted trees over format and context features score each, and it becomes a span if its
score passes the threshold calibrated for its generator and no overlapping candidate
passes its own by more. A candidate within or across a base span gives way; one that
holds a base span and more (an account number around a card number) stays beside it. The trees are fitted on examples made here from a fixed
seed, and compiled to one SQL expression.

Every expression is written so that matching is linear in the text: runs are taken
possessively and only from their first character (or from the end of the match before).
Positions come from the lengths of the pieces between matches, summed in blocks of 64.
"""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The base kinds in the order in which they are listed, then the generators'.
KINDS = ("email", "ip", "card", "phone", "written_email", "local_phone", "national_id", "iban")
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "written_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+ ?(?:\[at\]|\(at\)|\{at\}|<at>| at ) ?[A-Za-z0-9-]{2,63}+(?: ?(?:\[dot\]|\(dot\)|\{dot\}|<dot>| dot |\.) ?[A-Za-z0-9-]{2,24}+){1,3}(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9A-Za-z+./_-])(?:\([0-9]{2,5}+\) ?[0-9]{2,8}+(?:[ ./-][0-9]{2,8}+){0,3}|[0-9]{2,5}+(?:[ ./-][0-9]{2,8}+){1,4}|0[0-9]{8,11}+)(?![0-9A-Za-z]|[./-][0-9])",
    "national_id": r"(?<![0-9A-Za-z-])(?:[0-9]{3}([- ]?)[0-9]{2}\1[0-9]{4}|[A-CEGHJ-PR-TW-Z]{2} ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[A-D])(?![0-9A-Za-z]|-[0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ -]?[A-Z0-9]{4}){2,7}(?:[ -]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
#: A number of at most 255 with any zeros before it; zeros alone are 0. Hits have a digit in every part.
PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9][0-9]?)?+"
NEED = {
    "email": "contains({t}, '@')",
    "phone": "contains({t}, '+')",
    "written_email": "(contains({t}, 'at]') OR contains({t}, 'at)') OR contains({t}, 'at}}') OR contains({t}, 'at>') OR contains({t}, ' at '))",
}
CONTEXT = 40
WORDS = {
    "written_email": r"mail|contact|write|reach|address|kontakt|correo",
    "local_phone": r"phone|call|\btel|mobile|mobil|\bcell|\bfax|dial|reach|ring|whatsapp|sms|\bruf",
    "national_id": r"\bssn|social|security|taxpayer|national|insurance|\bnino|\btin\b",
    "iban": r"\biban|account|bank|transfer|konto|compte|cuenta",
}
AGAINST = r"order|isbn|version|invoice|part no|serial|ticket|\bitem|\bdate|\bpage|room|flight|score|ratio|figure|\bsku|model|pixel|census"
TLDS = "com|org|net|edu|gov|io|info|de|fr|es|it|uk|eu|us|ca|ch|at|nl|pl|ru|jp|cn|in|br|au|co|me|biz"
_models: dict[int, tuple[str, dict[str, float]]] = {}
FEATURES = ("generator", "length", "digits", "marks", "helps", "harms", "checked", "distance", "spaces", "groups", "zero", "spelt")


def _sql(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _found(df: DataFrame, text: str, name: str, pattern: str, digits: str) -> DataFrame:
    """Adds <name>: array of (start, end, hit, before), all matches of a pattern in code points."""
    need = NEED.get(name, digits).format(t=text)
    none = "cast(array() as array<string>)"
    df = df.withColumn("__hits", F.expr(f"CASE WHEN {need} THEN regexp_extract_all({text}, {_sql(pattern)}, 0) ELSE {none} END"))
    df = df.withColumn("__gaps", F.expr(f"CASE WHEN size(__hits) > 0 THEN split({text}, {_sql(pattern)}, -1) ELSE {none} END"))
    df = df.withColumn("__lens", F.expr("transform(__hits, (h, i) -> cast(length(h) + length(__gaps[i]) as bigint))"))
    df = df.withColumn("__sums", F.expr("transform(sequence(0, greatest(size(__lens) - 1, 0) div 64), b -> aggregate(slice(__lens, cast(b * 64 + 1 as int), 64), 0L, (s, x) -> s + x))"))
    df = df.withColumn("__offs", F.expr("transform(__sums, (x, b) -> aggregate(slice(__sums, 1, b), 0L, (s, y) -> s + y))"))
    # Named twice, so that the optimizer keeps them as columns and does not compute them again for every match.
    at = "transform(__hits, (h, i) -> __offs[cast(i div 64 as int)] + aggregate(slice(__lens, cast((i div 64) * 64 + 1 as int), cast(i % 64 as int)), 0L, (s, x) -> s + x) + length(__gaps[i]))"
    df = df.withColumn("__at", F.expr(f"CASE WHEN size(__hits) > 0 AND size(__gaps) > 0 AND size(__lens) > 0 AND size(__offs) > 0 THEN {at} ELSE cast(array() as array<bigint>) END"))
    around = f", 'before', lower(right(__gaps[i], {CONTEXT}))" if name in GENERATORS else ""
    df = df.withColumn(name, F.expr(f"transform(__hits, (h, i) -> named_struct('start', __at[i], 'end', __at[i] + length(h), 'hit', h{around}))"))
    return df.drop("__hits", "__gaps", "__lens", "__sums", "__offs", "__at")


def _luhn(d: str) -> str:
    """Whether the string of digits passes."""
    return f"aggregate(sequence(1, length({d})), 0, (s, i) -> s + CASE WHEN (length({d}) - i) % 2 = 1 THEN ascii(substr({d}, i, 1)) * 2 - 96 - CASE WHEN ascii(substr({d}, i, 1)) > 52 THEN 9 ELSE 0 END ELSE ascii(substr({d}, i, 1)) - 48 END) % 10 = 0"


def _only(h: str) -> str:
    return f"regexp_replace({h}, '[^0-9]', '')"


KEEP = {
    "email": "true",
    "ip": f"x.hit rlike {_sql('^' + PART + '(?:' + chr(92) + '.' + PART + '){3}$')}",
    "card": f"CASE WHEN length({_only('x.hit')}) BETWEEN 12 AND 19 THEN {_luhn(_only('x.hit'))} ELSE false END",
    "phone": f"length({_only('x.hit')}) BETWEEN 9 AND 15",
}


def _iban_ok(h: str) -> str:
    """Remainder 1 modulo 97 with the first four characters at the end and letters as two digits."""
    flat = f"replace(replace({h}, ' ', ''), '-', '')"
    turned = f"concat(substr({flat}, 5), left({flat}, 4))"
    code = f"ascii(substr({turned}, i, 1))"
    return f"CASE WHEN aggregate(sequence(1, length({turned})), 0, (s, i) -> CASE WHEN {code} < 58 THEN (s * 10 + {code} - 48) % 97 ELSE (s * 100 + {code} - 55) % 97 END) = 1 THEN 1 ELSE 0 END"


def _features(generator: str) -> str:
    """Struct of the features of a candidate x; all are whole numbers."""
    test = {
        "iban": f"{_iban_ok('x.hit')} = 1",
        "national_id": f"x.hit rlike {_sql('^(?:(?!000|666|9..)[0-9]{3}[- ]?(?!00)[0-9]{2}[- ]?(?!0000)[0-9]{4}|[A-Z].*)$')}",
        "written_email": f"lower(x.hit) rlike {_sql('[^a-z](?:' + TLDS + ')$')}",
        "local_phone": f"length({_only('x.hit')}) BETWEEN 7 AND 12",
    }[generator]
    rest = f"length(regexp_replace(x.before, {_sql('^.*(?:' + WORDS[generator] + ')')}, ''))"
    flag = lambda e: f"CASE WHEN {e} THEN 1 ELSE 0 END"
    return (
        f"named_struct('generator', {list(GENERATORS).index(generator)}, 'length', length(x.hit), 'digits', length({_only('x.hit')}), 'marks', length(regexp_replace(x.hit, '[A-Za-z0-9 ]', '')),"
        f" 'helps', {flag(f'x.before rlike {_sql(WORDS[generator])}')}, 'harms', {flag(f'x.before rlike {_sql(AGAINST)}')}, 'checked', {flag(test)},"
        f" 'distance', CASE WHEN {rest} = length(x.before) THEN 99 ELSE {rest} END, 'spaces', length(regexp_replace(x.hit, '[^ ]', '')),"
        f" 'groups', size(split(x.hit, '[^0-9]+')), 'zero', {flag("x.hit rlike '^[(0]'")}, 'spelt', {flag(f'x.hit rlike {_sql(chr(92) + "bat" + chr(92) + "b.*" + chr(92) + "bdot" + chr(92) + "b")}')})"
    )


def examples(n: int = 800, seed: int = 7) -> list[tuple[str, str, int, int]]:
    """(generator, text, label, held): ``n`` made sentences for every generator, half of them personal data.

    A third is held out to calibrate, and made from other forms and contexts than the rest.
    Of both labels some stand behind words that help or harm, some in neutral context.
    """
    rng = random.Random(seed)
    pick = rng.choice
    num = lambda k: "".join(pick("0123456789") for _ in range(k))
    word = lambda: "".join(pick("abcdefghijklmnoprstuvw") for _ in range(rng.randint(3, 8)))
    filler = lambda: " ".join(word() for _ in range(rng.randint(0, 5)))
    fill = lambda form: re.sub("#+", lambda m: num(len(m[0])), form)

    def iban(good: bool, held: int) -> str:
        body = pick(("NL", "BE", "AT")) if held else pick(("DE", "FR", "ES", "GB"))
        rest = num(pick((12, 14, 22)) if held else pick((16, 18, 20)))
        value = int(rest + "".join(str(ord(c) - 55) for c in body) + "00") % 97
        flat = f"{body}{98 - value if good else (98 - value + rng.randint(1, 90)) % 97:02d}{rest}"
        return pick((flat, " ".join(flat[i : i + 4] for i in range(0, len(flat), 4))))

    def ssn(good: bool) -> str:
        area = f"{pick([x for x in range(1, 900) if x != 666]):03d}" if good or rng.random() < 0.5 else pick(("000", "666", "9" + num(2)))
        gap = pick("- ") if rng.random() < 0.8 else ""
        return f"{area}{gap}{rng.randint(1, 99):02d}{gap}{rng.randint(1, 9999):04d}"

    at = (("[at]", " [at] ", "(at)", " (at) ", " at "), (" {at} ", "<at>", " at ", "[at]"))
    dot = (("[dot]", " [dot] ", "(dot)", "."), (" {dot} ", " dot ", ".", "[dot]"))
    tld = (("com", "org", "net", "de"), ("edu", "fr", "io", "uk"))
    phones = (("(###) ###-####", "###-###-####", "0## #######", "0### ########", "### ### ####", "0##/#######"), ("(0##) ### ####", "###.###.####", "0## #### ####", "0#### ######", "0#########"))
    not_phones = (("####-####", "## ##", "##.##.####", "#### ####", "###-###-####", "###-###-####", "##/##/####", "### ####"), ("####/####", "## ### ###", "###.###.####", "#### ## ##", "##-##-####", "0##.###"))
    help_ = {
        "written_email": (("mail me:", "contact", "write to", "my address is"), ("you can reach me under", "kontakt", "my new email is")),
        "local_phone": (("call", "phone:", "tel.", "mobile", "fax", "cell"), ("please ring", "sms to", "dial", "whatsapp")),
        "national_id": (("ssn", "social security number", "taxpayer id"), ("national insurance", "her social security no. is")),
        "iban": (("iban", "account", "bank transfer to"), ("konto", "compte", "my bank details")),
    }
    harm = (("order", "isbn", "version", "invoice", "ticket", "page", "serial", "part no", "item"), ("model", "figure", "score", "sku", "flight", "room"))
    out = []
    for k in range(n // 2):
        held = int(k % 3 == 0)
        plain = lambda: pick(("", word(), filler()))
        near = lambda g: pick(help_[g][held]) if rng.random() < 0.8 else plain()
        far = lambda: pick(harm[held]) if rng.random() < 0.5 else plain()
        sep = pick(at[held])
        spelt = sep == " at "
        mail = f"{word()}{sep}{word()}{' dot ' if spelt else pick(dot[held])}{pick(tld[held])}"
        # behind words that help also "name at host.tld"
        bare = rng.random() < 0.2
        out.append(("written_email", f"{filler()} {pick(help_['written_email'][held])} {word()} at {word()}.{pick(tld[held])}" if bare else f"{filler()} {near('written_email')} {mail}", 1, held))
        out.append(("written_email", f"{filler()} {pick((word(), word(), *help_['written_email'][held]))} {word()} at {word()}{pick((f'. {pick(tld[held]).title()}', '. ' + word(), '.' + word(), ' dot ' + word()))}", 0, held))
        out.append(("local_phone", f"{filler()} {near('local_phone')} {fill(pick(phones[held]))}", 1, held))
        out.append(("local_phone", f"{filler()} {far()} {fill(pick(not_phones[held]))}", 0, held))
        out.append(("national_id", f"{filler()} {near('national_id')} {ssn(True)}", 1, held))
        out.append(("national_id", f"{filler()} {far()} {ssn(False)}", 0, held))
        out.append(("iban", f"{filler()} {near('iban')} {iban(True, held)}", 1, held))
        out.append(("iban", f"{filler()} {far()} {iban(False, held)}", 0, held))
    return out


def _fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, rate: float = 0.4) -> tuple[float, list]:
    """Boosted trees of depth three on the logistic loss: (bias, [(feature, cut, below, above)]), a leaf being a number."""
    bias = 0.0
    score = np.zeros(len(y))
    trees = []

    def best(rows: np.ndarray, g: np.ndarray, h: np.ndarray):
        top = None
        for f in range(x.shape[1]):
            for cut in np.unique(x[rows, f])[:-1]:
                low = x[rows, f] <= cut
                gain = sum(g[rows[s]].sum() ** 2 / (h[rows[s]].sum() + 1.0) for s in (low, ~low))
                if top is None or gain > top[0] + 1e-9:
                    top = (gain, f, int(cut), rows[low], rows[~low])
        return top

    def leaf(rows, g, h) -> float:
        return float(rate * g[rows].sum() / (h[rows].sum() + 1.0))

    def grow(rows, g, h, deep: int):
        top = best(rows, g, h) if deep and len(rows) >= 20 else None
        if not top:
            return leaf(rows, g, h)
        return (top[1], top[2], grow(top[3], g, h, deep - 1), grow(top[4], g, h, deep - 1))

    def value(tree, rows: np.ndarray) -> np.ndarray:
        if isinstance(tree, float):
            return np.full(len(rows), tree)
        low = rows[:, tree[0]] <= tree[1]
        return np.where(low, value(tree[2], rows), value(tree[3], rows))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = grow(np.arange(len(y)), y - p, p * (1 - p), 3)
        if isinstance(tree, float):
            break
        trees.append(tree)
        score = score + value(tree, x)
    return bias, [trees, value]


def _compiled(tree) -> str:
    if isinstance(tree, float):
        return f"{tree:.6f}D"
    return f"CASE WHEN x.f.{FEATURES[tree[0]]} <= {tree[1]} THEN {_compiled(tree[2])} ELSE {_compiled(tree[3])} END"


def _model(spark: SparkSession, per_generator: int) -> tuple[str, dict[str, float]]:
    """The score as SQL over a candidate x, and the least score per generator.

    The held-out examples calibrate: the threshold is the least score from which on their
    precision is 0.99 or more, and at least that of even odds.
    """
    if per_generator in _models:
        return _models[per_generator]
    rows = spark.createDataFrame(examples(per_generator), "g string, text string, label int, held int")
    parts = []
    for g, pattern in GENERATORS.items():
        c = _found(rows.filter(F.col("g") == g), "text", g, pattern, "true").withColumn("f", F.expr(f"get(transform({g}, x -> {_features(g)}), 0)"))
        parts.append(c.filter("f is not null").select("g", "label", "text", "held", *[F.col(f"f.{k}").alias(k) for k in FEATURES]))
    table = sorted((r for p in parts for r in p.collect()), key=lambda r: (r["g"], r["text"]))
    x = np.array([[r[k] for k in FEATURES] for r in table])
    y = np.array([r["label"] for r in table], float)
    held = np.array([r["held"] for r in table]) == 1
    bias, (trees, value) = _fit(x[~held], y[~held])
    score = bias + sum(value(t, x[held]) for t in trees)
    least = {}
    for i, g in enumerate(GENERATORS):
        own = x[held][:, 0] == i
        s, label = score[own], y[held][own]
        ok = [c for c in np.unique(s) if label[s >= c].mean() >= 0.99]
        least[g] = round(max(0.0, min(ok) - 1e-6) if ok else 1e9, 6)
    _models[per_generator] = f"{bias:.6f}D + " + " + ".join(f"({_compiled(t)})" for t in trees), least
    return _models[per_generator]


def _maxima(df: DataFrame, spans: str, end: str) -> DataFrame:
    """Adds __top: for every block of 64 of ``spans`` the largest ``end`` (an expression over y) in the blocks before."""
    df = df.withColumn("__most", F.expr(f"transform(sequence(0, greatest(size({spans}) - 1, 0) div 64), b -> coalesce(array_max(transform(slice({spans}, cast(b * 64 + 1 as int), 64), y -> {end})), -1L))"))
    return df.withColumn("__top", F.expr("transform(__most, (x, b) -> CASE WHEN b = 0 THEN -1L ELSE array_max(slice(__most, 1, b)) END)"))


def _before(spans: str, end: str, i: str) -> str:
    """The largest ``end`` of the spans before the one at ``i``."""
    return f"greatest(__top[cast({i} div 64 as int)], coalesce(array_max(transform(slice({spans}, cast(({i} div 64) * 64 + 1 as int), cast({i} % 64 as int)), y -> {end})), -1L))"


def _chosen(df: DataFrame) -> DataFrame:
    """``df`` with pii: of __all (base spans and candidates with their margins, sorted by start and kind) the base spans and the candidates that stay.

    First candidates fall to base spans: one that begins before the candidate and ends within or behind it
    is seen in the running maximum of their ends, others begin within the candidate. What is
    left falls apart into groups without overlap between them; within each the one with the
    largest margin is taken, what overlaps it goes, and so on.
    """
    end = "CASE WHEN y.base THEN y.end ELSE -1L END"
    none = "cast(array() as array<struct<start:bigint,kind:int,end:bigint,base:boolean,margin:double>>)"
    df = _maxima(df, "__all", end)
    # Of a start there is at most one span of each kind: the first of those with the start of the candidate.
    df = df.withColumn("__from", F.expr(f"transform(__all, (x, i) -> CASE WHEN x.base THEN 0 ELSE i - size(filter(slice(__all, greatest(i - {len(KINDS) - 1}, 1), least(i, {len(KINDS)})), y -> y.start = x.start)) END)"))
    inside = f"exists(slice(__all, __from[i] + 1, cast(x.end - x.start as int) * {len(KINDS)}), y -> y.base AND y.start < x.end AND (y.end > x.end OR (y.start = x.start AND y.end = x.end)))"
    df = df.withColumn("__left", F.expr(f"CASE WHEN exists(__all, x -> NOT x.base) THEN filter(__all, (x, i) -> NOT x.base AND {_before('__all', end, '__from[i]')} <= x.start AND NOT {inside}) ELSE {none} END"))
    df = _maxima(df, "__left", "y.end")
    df = df.withColumn("__cuts", F.expr(f"filter(transform(__left, (x, i) -> CASE WHEN {_before('__left', 'y.end', 'i')} <= x.start THEN i END), i -> i IS NOT NULL)"))
    df = df.withColumn("__groups", F.expr("transform(__cuts, (c, k) -> slice(__left, c + 1, coalesce(get(__cuts, k + 1), size(__left)) - c))"))
    ranked = "array_sort(transform(g, x -> named_struct('m', -x.margin, 'start', x.start, 'kind', x.kind, 'x', x))).x"
    greedy = f"aggregate({ranked}, {none}, (acc, x) -> CASE WHEN exists(acc, y -> y.start < x.end AND x.start < y.end) THEN acc ELSE concat(acc, array(x)) END)"
    stay = f"flatten(transform(__groups, g -> CASE WHEN size(g) = 1 THEN g ELSE {greedy} END))"
    return df.withColumn("pii", F.expr(f"CASE WHEN size(__left) = 0 THEN filter(__all, x -> x.base) ELSE array_sort(concat(filter(__all, x -> x.base), {stay})) END"))


def detect(docs: DataFrame, text: str = "text", per_generator: int = 800) -> DataFrame:
    """The columns of ``docs`` and pii: array of (start, kind, end, base), by start and then kind.

    ``kind`` is a position in KINDS, ends are exclusive, positions count code points. A null
    or empty text has no spans; matching is linear in the text, however long it is. Of two
    candidates with equal margins the one that starts first, then the first kind, stays.
    Repeated rows get equal spans; a column called pii is replaced, others pass through. An
    empty table gives an empty table.
    """
    kept = [c for c in docs.columns if c != "pii"]
    score, least = _model(docs.sparkSession, per_generator)
    df = docs.select(F.struct(*kept).alias("__row"), F.coalesce(F.col(text), F.lit("")).alias("__t"))
    df = df.withColumn("__d", F.expr("__t rlike '[0-9]'"))
    spans = []
    for k, (name, pattern) in enumerate(BASE.items()):
        df = _found(df, "__t", name, pattern, "__d")
        spans.append(f"transform(filter({name}, x -> {KEEP[name]}), x -> named_struct('start', x.start, 'kind', {k}, 'end', x.end, 'base', true))")
    df = df.withColumn("__base", F.expr(f"concat({', '.join(spans)})")).drop(*BASE)
    every = ["transform(__base, x -> named_struct('start', x.start, 'kind', x.kind, 'end', x.end, 'base', true, 'margin', 0D))"]
    for k, (name, pattern) in enumerate(GENERATORS.items()):
        df = _found(df, "__t", name, pattern, "__d")
        scored = f"transform({name}, x -> named_struct('start', x.start, 'end', x.end, 'f', {_features(name)}))"
        rated = f"transform({scored}, x -> named_struct('start', x.start, 'kind', {len(BASE) + k}, 'end', x.end, 'base', false, 'margin', {score} - {least[name]}D))"
        df = df.withColumn(name, F.expr(f"CASE WHEN size({name}) > 0 THEN filter({rated}, x -> x.margin >= 0) ELSE cast(array() as array<struct<start:bigint,kind:int,end:bigint,base:boolean,margin:double>>) END"))
        every.append(name)
    df = df.withColumn("__all", F.expr(f"array_sort(concat({', '.join(every)}))"))
    df = _chosen(df)
    df = df.withColumn("pii", F.expr("transform(pii, x -> named_struct('start', x.start, 'kind', x.kind, 'end', x.end, 'base', x.base))"))
    return df.select("__row.*", "pii")


def joined(spans: str, base: bool = False) -> Column:
    """kind:start:end, comma-joined; with ``base`` only of the base detectors."""
    chosen = f"filter({spans}, x -> x.base)" if base else spans
    kinds = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({chosen}, x -> concat({kinds}[x.kind], ':', x.start, ':', x.end)), ',')")


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """``found`` (of ``detect``) with every span in ``text`` replaced by its kind in brackets; overlapping spans are one.

    A null text stays null; rows are redacted one by one, so repeated ones alike and none of
    an empty table; other columns pass through.
    """
    labels = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + ")"
    fold = (
        f"aggregate(pii, named_struct('at', 0L, 'out', ''), (acc, x) -> CASE WHEN x.start >= acc.at"
        f" THEN named_struct('at', x.end, 'out', concat(acc.out, substr({text}, cast(acc.at + 1 as int), cast(x.start - acc.at as int)), {labels}[x.kind]))"
        f" ELSE named_struct('at', greatest(acc.at, x.end), 'out', acc.out) END, acc -> concat(acc.out, substr({text}, cast(acc.at + 1 as int))))"
    )
    return found.withColumn(text, F.expr(f"CASE WHEN size(pii) > 0 THEN {fold} ELSE {text} END"))
