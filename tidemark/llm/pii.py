"""Personal data: generated candidates, boosted trees and calibrated thresholds, in
DataFrame functions only.

1. Generators of high recall propose spans that may overlap: the matches of the
   four base patterns, whether or not they pass their rule, and looser forms
   (phone numbers without a plus, number groups like 3-2-4, spelled-out mail
   signs). Spans come with code point positions, from regular expressions alone.
2. Each candidate gets small integer features of its format and context.
   Gradient boosting of small trees runs on counts by combination of features,
   and the trees become one CASE expression. It learns from made examples
   (`examples`): loose forms that keep to their format's rules, alone in a
   sentence, against corrupted ones (broken rules, joined to other characters).
   Labels so do not depend on base spans, nor on how many a corpus has.
3. For each family a threshold is calibrated on examples that were not learnt
   from: the lowest score above which at least `precision` of them are real.
   Base spans and what they cover are neither learnt from nor counted. Spans
   above it that no base span covers are added, of overlapping ones the best;
   base spans always stay. That precision is one of the examples: a corpus has no
   labels to measure it by.

Defined results: a null text is empty and has no spans; texts of any length are
read whole; repeated rows give repeated results; a null doc_id is kept; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written

KINDS = ("email", "ip", "card", "phone")
#: Base patterns. Loops that nothing follows, or only what they cannot match, are
#: possessive, which matches the same and never recurses. A pattern that opens with
#: such a loop starts at the loop's first character, or where the match before it
#: ended: from any later one it would reach the same end, and a long run without a
#: match would be read from each of its characters.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Looser generators: (family, pattern, what a text must contain).
LOOSE = (
    (3, r"(?:\([0-9]{3}\)[\x20.-]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}", None),
    (2, r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "-"),
    (0, r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:(?:\x20?(?:\(dot\)|\[dot\])\x20?|\.)[A-Za-z0-9-]++)++", "at"),
)
HINTS = r"(?i)(mail|phone|tel|call|fax|card|visa|account|ssn|host|addr|contact|\bip\b)"
FEATURES = ("family", "digits", "parts", "hint", "joined_left", "joined_right", "uniform", "brackets", "form", "valid")
CHUNK = 64
PIECE = 1024
_CAND = "array<struct<family:int,base:boolean,s:int,e:int,t:string,form:int>>"


def _sql_text(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(text: str, pattern: str, family: int, must: str | None, form: int = 0) -> str:
    """SQL: array of (family, base, s, e, t, form) for the leftmost non-overlapping matches of pattern.

    The text between matches is captured too; running lengths give positions."""
    hits = f"regexp_extract_all({text}, {_sql_text(pattern)}, 0)"
    gaps = rf"regexp_extract_all({text}, {_sql_text('(?s)' + chr(92) + 'G(.*?)(?:' + pattern + ')')}, 1)"
    # positions are running sums: within chunks of CHUNK matches, then over the chunks, so that no array grows one by one
    local = "named_struct('p', 0, 'o', cast(array() as array<struct<s:int,e:int,t:string>>))"
    walk = "(a, i) -> transform(array(a.p + length(g[i])), s -> named_struct('p', s + length(h[i]), 'o', concat(a.o, array(named_struct('s', s, 'e', s + length(h[i]), 't', h[i])))))[0]"
    chunk = f"aggregate(sequence(k * {CHUNK}, least(size(h), (k + 1) * {CHUNK}) - 1), {local}, {walk})"
    chunks = f"transform(sequence(0, (size(h) - 1) div {CHUNK}), k -> {chunk})"
    bases = "aggregate(c, array(0), (b, x) -> concat(b, array(element_at(b, -1) + x.p)), b -> b)"
    item = f"named_struct('family', {family}, 'base', false, 's', b[k] + x.s, 'e', b[k] + x.e, 't', x.t, 'form', {form})"
    walk = f"transform(array({chunks}), c -> transform(array({bases}), b -> flatten(transform(c, (y, k) -> transform(y.o, x -> {item}))))[0])[0]"
    found = f"transform(array({hits}), h -> if(size(h) = 0, cast(array() as {_CAND}), transform(array({gaps}), g -> {walk})[0]))[0]"
    return found if must is None else f"if(instr({text}, {_sql_text(must)}) > 0, {found}, cast(array() as {_CAND}))"


def _running_max(of: str, value: str) -> str:
    """SQL: for each place of the array `of` (not empty) the largest `value` (of element x, at least 0) up to it.

    Within chunks first and then over the chunks, so that no array grows one by one."""
    start = "named_struct('m', 0, 'o', cast(array() as array<int>))"
    step = f"(a, i) -> transform(array({of}[i]), x -> transform(array(greatest(a.m, {value})), v -> named_struct('m', v, 'o', concat(a.o, array(v))))[0])[0]"
    chunk = f"aggregate(sequence(k * {CHUNK}, least(size({of}), (k + 1) * {CHUNK}) - 1), {start}, {step})"
    tops = "aggregate(q, array(0), (b, y) -> concat(b, array(greatest(element_at(b, -1), y.m))))"
    return f"transform(array(transform(sequence(0, (size({of}) - 1) div {CHUNK}), k -> {chunk})), q -> transform(array({tops}), b -> flatten(transform(q, (y, k) -> transform(y.o, v -> greatest(v, b[k])))))[0])[0]"


_DIGITS = "regexp_replace(c.t, '[^0-9]', '')"
_LUHN = (
    f"transform(array({_DIGITS}), d -> length(d) between 13 and 19 and pmod(aggregate(sequence(1, least(length(d), 19)), 0, (a, i) -> a +"
    " transform(array(cast(substring(d, length(d) - i + 1, 1) as int)), x -> if(i % 2 = 1, x, if(x > 4, 2 * x - 9, 2 * x)))[0]), 10) = 0)[0]"
)
_OCTETS = "forall(split(c.t, '[.]'), x -> length(ltrim('0', x)) <= 3 and cast(concat('0', substring(ltrim('0', x), 1, 3)) as int) <= 255)"
#: The rule that a base match must pass, by kind.
RULES = ("true", _OCTETS, _LUHN, f"length({_DIGITS}) between 9 and 15")


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, cands): each document's candidates with their features; one row per document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    musts = ("@", ".", None, "+")
    for k, (kind, pattern) in enumerate(zip(KINDS, (EMAIL, IP, CARD, PHONE))):
        base = f"transform({_matches('text', pattern, k, musts[k])}, c -> named_struct('family', c.family, 'base', {RULES[k]}, 's', c.s, 'e', c.e, 't', c.t, 'form', c.form))"
        rows = rows.withColumn(kind, F.expr(base))
    # most numbers have a few digits only: those that no rule could pass are no candidates
    rows = rows.withColumn("card", F.expr(f"filter(card, c -> length({_DIGITS}) >= 8)"))
    for n, (family, pattern, must) in enumerate(LOOSE):
        rows = rows.withColumn(f"loose{n}", F.expr(_matches("text", pattern, family, must, n + 1)))
    rows = rows.withColumn("cands", F.concat(*KINDS, *[f"loose{n}" for n in range(len(LOOSE))])).select("doc_id", "text", "cands")
    # in order of start, base spans first: a candidate is covered if a base span so far reaches its end
    covered = "c.base or reach[n] >= c.e"
    digits = f"length({_DIGITS})"
    # substring() counts characters from the start of its text, so the text is read from pieces of PIECE characters
    at = lambda p, n: f"substring(concat(coalesce(get(pieces, cast(({p}) div {PIECE} as int)), ''), coalesce(get(pieces, cast(({p}) div {PIECE} as int) + 1), '')), ({p}) % {PIECE} + 1, {n})"
    parts = "size(split(c.t, '[^A-Za-z0-9]+'))"
    values = {
        "family": "c.family",
        "digits": f"case when {digits} = 0 then 0 when {digits} < 9 then 1 when {digits} < 11 then 2 when {digits} < 13 then 3 when {digits} < 17 then 4 else 5 end",
        "parts": f"least({parts}, 6)",
        # the context of base spans, which stay anyway, is not looked up
        "hint": f"if(c.base, 0, cast({at('greatest(c.s - 24, 0)', 'least(24, c.s)')} rlike {_sql_text(HINTS)} as int))",
        "joined_left": f"if(c.s > 0 and not c.base, cast({at('c.s - 1', 1)} rlike '[A-Za-z0-9]' as int), 0)",
        "joined_right": f"if(c.base, 0, cast({at('c.e', 1)} rlike '[A-Za-z0-9]' as int))",
        "uniform": f"cast({_DIGITS} rlike '^([0-9])\\\\1+$' as int)",
        "brackets": "cast(c.t rlike '[()]' as int)",
        "form": "c.form",
        "valid": f"case c.form when 1 then cast({_DIGITS} rlike '^[2-9][0-9]{{2}}[2-9]' as int) when 2 then cast(c.t rlike '^(?!000|666|9)[0-9]{{3}}-(?!00)[0-9]{{2}}-(?!0000)' as int) when 3 then cast(c.t rlike '[A-Za-z]{{2,}}$' as int) else 0 end",
    }
    made = ", ".join(f"'{k}', {v}" for k, v in values.items())
    item = f"named_struct('base', c.base, 'covered', {covered}, 's', c.s, 'e', c.e, {made})"
    ordered = "transform(array_sort(transform(cands, c -> named_struct('s', c.s, 'loose', not c.base, 'c', c))), z -> z.c)"
    pieces = f"regexp_extract_all(text, '(?s).{{1,{PIECE}}}', 0)"
    made = f"transform(array({pieces}), pieces -> transform(array({ordered}), o -> transform(array({_running_max('o', 'if(x.base, x.e, 0)')}), reach -> transform(o, (c, n) -> {item}))[0])[0])[0]"
    return rows.select("doc_id", F.expr(f"if(size(cands) = 0, array(), {made})").alias("cands"))


def examples(seed: int = 5, n: int = 600) -> list[tuple[str, str, bool]]:
    """(text, the part of it that is the candidate, is it real) of made loose forms."""
    rng, out = random.Random(seed), []
    d = lambda low, high, w: f"{rng.randint(low, high):0{w}d}"
    before = ("", "call ", "phone: ", "ssn ", "mail to ", "contact ", "we met and ", "she wrote ", "see ", "account ")
    after = ("", " please", ", thanks", ". Then", " or later", "\n")

    def local(ok):
        shape = rng.choice(("({}) {}-{}", "({}){}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}"))
        return shape.format(d(200, 999, 3) if ok else d(0, 199, 3), d(200, 999, 3) if ok else d(0, 199, 3), d(0, 9999, 4))

    def social(ok):
        if ok:
            return f"{d(1, 665, 3)}-{d(1, 99, 2)}-{d(1, 9999, 4)}"
        return rng.choice((f"{rng.choice(('000', '666', d(900, 999, 3)))}-{d(1, 99, 2)}-{d(1, 9999, 4)}", f"{d(1, 665, 3)}-00-{d(1, 9999, 4)}", f"{d(1, 665, 3)}-{d(1, 99, 2)}-0000"))

    def mail(ok):
        sign = rng.choice(("(at)", "[at]", " (at) ", " [at] "))
        end = rng.choice(("org", "com", "net", "de", "co.uk")) if ok else rng.choice(("5", "10", "4b", "x"))
        return f"{rng.choice(('joe', 'anna.k', 'm_w', 'info'))}{sign}{rng.choice(('site', 'my-host', 'lab'))}{rng.choice(('.', ' (dot) ', '(dot)', '[dot]'))}{end}"

    for k in range(n):
        make, kind = (local, social, mail)[k % 3], rng.randrange(4)
        part = make(kind != 2)
        left, right = ("", "")
        if kind == 3 and make is not mail:  # a piece of a longer number or name
            left, right = rng.choice((("X7", ""), ("", "Q"), ("84", "91"), ("ref", "x")))
        out.append((rng.choice(before) + left + part + right + rng.choice(after), part, kind < 2 or kind == 3 and make is mail))
    # the base patterns' own matches that fail their rule are never real
    for k in range(n // 3):
        part = rng.choice((f"{d(256, 999, 3)}.{d(0, 255, 1)}.{d(0, 255, 1)}.{d(0, 255, 1)}", f"+{d(1, 9, 1)} {d(100, 99999, 3)}", d(10**8, 10**9 - 1, 9), f"{d(0, 999, 3)} {d(0, 999, 3)} {d(0, 999, 3)}"))
        out.append((rng.choice(before) + part + rng.choice(after), part, False))
    return out


def example_counts(spark, seed: int) -> list[tuple[tuple[int, ...], int, int]]:
    """(features, candidates, real candidates) of every combination among the examples, without base spans and what they cover."""
    made = examples(seed)
    found: dict[tuple[int, ...], list[int]] = {}
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(made)], "doc_id long, text string").coalesce(1)
    for r in candidates(docs).select("doc_id", F.explode("cands").alias("c")).select("doc_id", "c.*").collect():
        if not r.covered:
            text, part, real = made[r.doc_id]
            cell = found.setdefault(tuple(int(r[f]) for f in FEATURES), [0, 0])
            cell[0] += 1
            cell[1] += real and r.form > 0 and text[r.s : r.e] == part
    return sorted((x, n, y) for x, (n, y) in found.items())


def boost(cells, rounds: int = 24, rate: float = 0.3, depth: int = 3, least: float = 1.0):
    """(start, trees): boosted trees of the log-odds on counted cells; a tree is a value or (feature, cut, low, high)."""
    total, yes = sum(n for _, n, _ in cells), sum(y for _, _, y in cells)
    start = math.log((yes + 0.5) / (total - yes + 0.5))
    score = [start] * len(cells)

    def fit(rows, level):
        g = sum(rows_g[i] for i in rows)
        h = sum(rows_h[i] for i in rows)
        best = None
        if level:
            for f in range(len(cells[0][0])):
                by: dict[int, list[float]] = {}
                for i in rows:
                    s = by.setdefault(cells[i][0][f], [0.0, 0.0])
                    s[0] += rows_g[i]
                    s[1] += rows_h[i]
                lg = lh = 0.0
                for v in sorted(by)[:-1]:
                    lg, lh = lg + by[v][0], lh + by[v][1]
                    gain = lg * lg / (lh + least) + (g - lg) ** 2 / (h - lh + least) - g * g / (h + least)
                    if gain > 1e-9 and (best is None or gain > best[0]):
                        best = (gain, f, v)
        if best is None:
            return rate * g / (h + least)
        _, f, v = best
        return (f, v, fit([i for i in rows if cells[i][0][f] <= v], level - 1), fit([i for i in rows if cells[i][0][f] > v], level - 1))

    trees = []
    for _ in range(rounds if cells else 0):
        p = [1 / (1 + math.exp(-s)) for s in score]
        rows_g = [y - n * q for (_, n, y), q in zip(cells, p)]
        rows_h = [n * q * (1 - q) for (_, n, _), q in zip(cells, p)]
        tree = fit(range(len(cells)), depth)
        trees.append(tree)
        score = [s + value(tree, x) for s, (x, _, _) in zip(score, cells)]
    return start, trees


def value(tree, x) -> float:
    while isinstance(tree, tuple):
        f, v, low, high = tree
        tree = low if x[f] <= v else high
    return tree


def thresholds(cells, start: float, trees, precision: float) -> list[float]:
    """For each family the lowest score above which that share of its candidates is real."""
    out = []
    for family in range(len(KINDS)):
        ranked = sorted(((start + sum(value(t, x) for t in trees), n, y) for x, n, y in cells if x[0] == family), reverse=True)
        best, n, y = math.inf, 0, 0
        for k, (s, cn, cy) in enumerate(ranked):
            n, y = n + cn, y + cy
            if (k + 1 == len(ranked) or ranked[k + 1][0] < s) and y >= precision * n and y:
                best = s
        out.append(best)
    return out


def _tree_sql(tree) -> str:
    if not isinstance(tree, tuple):
        return f"{tree!r}D"
    f, v, low, high = tree
    return f"if(c.{FEATURES[f]} <= {v}, {_tree_sql(low)}, {_tree_sql(high)})"


def find_pii(docs: DataFrame, precision: float = 0.8) -> DataFrame:
    """One row per document: doc_id, spans array<struct<kind, start, end, base, score>>, base spans and added ones."""
    cands = written(candidates(docs), "candidates")
    start, trees = boost(example_counts(docs.sparkSession, 5))
    cut = thresholds(example_counts(docs.sparkSession, 6), start, trees, precision)
    score = " + ".join([f"{start!r}D", *map(_tree_sql, trees)])
    above = " or ".join(f"(c.family = {k} and x >= {t - 1e-9!r}D)" for k, t in enumerate(cut) if t < math.inf) or "false"
    kinds = "array(" + ", ".join(_sql_text(k) for k in KINDS) + ")"
    scored = f"transform(cands, c -> transform(array({score}), x -> named_struct('c', c, 'x', x, 'take', c.base or (not c.covered and ({above}))))[0])"
    # of added spans that overlap, the one of the highest score stays, then the first, then the longest
    better = "b.x > z.x or (b.x = z.x and (b.c.s < z.c.s or (b.c.s = z.c.s and (b.c.e > z.c.e or (b.c.e = z.c.e and (b.c.family < z.c.family or (b.c.family = z.c.family and b.c.form < z.c.form)))))))"
    beaten = f"exists(g, b -> b.c.s < z.c.e and z.c.s < b.c.e and ({better}))"
    # added spans come in order of start; a group ends where no span so far reaches over the next one's start
    first = f"transform(array({_running_max('added', 'x.c.e')}), r -> filter(sequence(0, size(added) - 1), i -> i = 0 or r[i - 1] <= added[i].c.s))[0]"
    groups = f"transform(array({first}), f -> transform(f, (i, k) -> slice(added, i + 1, coalesce(get(f, k + 1), size(added)) - i)))[0]"
    best = f"if(size(added) < 2, added, flatten(transform({groups}, g -> if(size(g) = 1, g, filter(g, z -> not {beaten})))))"
    kept = f"transform(array(filter({scored}, z -> z.take)), held -> transform(array(filter(held, z -> not z.c.base)), added -> concat(filter(held, z -> z.c.base), {best}))[0])[0]"
    spans = f"transform({kept}, z -> named_struct('family', z.c.family, 'start', z.c.s, 'end', z.c.e, 'added', not z.c.base, 'kind', {kinds}[z.c.family], 'score', 1 / (1 + exp(-z.x))))"
    return cands.select("doc_id", F.expr(f"if(size(cands) = 0, cast(null as array<struct<family:int,start:int,end:int,added:boolean,kind:string,score:double>>), array_sort({spans}))").alias("spans")).withColumn(
        "spans", F.coalesce("spans", F.expr("cast(array() as array<struct<family:int,start:int,end:int,added:boolean,kind:string,score:double>>)"))
    )


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.when(s.added, F.concat(s.kind, F.lit("~model"))).otherwise(s.kind), s.start, s.end)), ",")


def op6_query(spark, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: ~s.added)
    count = lambda k: F.size(F.filter(base, lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
