"""Personal data by candidate gradient boosting, in DataFrame functions only.

Four base patterns with checks always report.  Besides, high-recall generators propose further, overlapping spans;
boosted depth-two trees score them by format and context features, a threshold calibrated for each generator selects,
and of overlapping selected spans the best one stays.  Spans that touch a base span are never added.

The trees learn from what the base patterns miss.  Every base span is planted again, in its own context, in forms that are
still personal data (spelt-out addresses, IPv6, other separators, national numbers) and in forms that are not (numbers that
fail their check, octets beyond 255, the context of an order number).  Candidates in planted forms have that label.  Other
candidates of the corpus that touch no base span have none: they count as wrong where their features, or their score, are
commoner among them than among planted personal data, and are left out elsewhere.
Features are small integers, so the training data is one aggregate of feature combinations with their label counts (at
most FEATURE_SPACE rows), from a sample of documents whose bound is a parameter.  The fitted trees are compiled to CASE
expressions; the thresholds come from their scores of all candidates and all planted forms of all documents.
"""

from __future__ import annotations

import math
from functools import partial, reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

KINDS = ("email", "ip", "card", "phone")
# fixed values: the base patterns, written so that no start is tried twice within one run of characters
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?=[0-9][ -]?[0-9])[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Candidate generators.
_AT, _DOT = r"(?: ?@ ?| ?[(\[]at[)\]] ?| at )", r"(?:\.| ?[(\[]dot[)\]] ?| dot )"
WIDE = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,4}}",
    "ip": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|[0-9]{1,3}(?:\.[0-9]{1,3}){3})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])(?:[0-9]{4}[ ./-]{1,2}[0-9]{4}[ ./-]{1,2}[0-9]{4}[ ./-]{1,2}[0-9]{1,7}|[0-9]{4}[ ./-]{1,2}[0-9]{6}[ ./-]{1,2}[0-9]{5}|[0-9]{13,19})(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])",
}
#: Features and their numbers of values; their product bounds the training table.
FEATURES = {"gen": 4, "digits": 21, "len": 11, "luhn": 2, "octets": 2, "sep": 16, "plus": 2, "prev": 6, "next": 6, "ctx": 5}
FEATURE_SPACE = math.prod(FEATURES.values())
SAMPLE_DOCS = 4000
ROUNDS, RATE, PRECISION = 24, 0.4, 0.95
_SPAN = "array<struct<s:int,e:int,m:string>>"


# ----------------------------------------------------------------------------------- spans natively
def _fold(a: Column, op, kind: str) -> Column:
    empty = F.array().cast(f"array<{kind}>")
    zero = F.struct(F.lit(0).cast(kind).alias("v"), empty.alias("out"))
    step = lambda s, x: F.struct(op(s["v"], x).cast(kind).alias("v"), F.concat(s["out"], F.array(s["v"])).alias("out"))
    return F.aggregate(a, zero, step, lambda s: s["out"])


def running(a: Column, op, block: int = 256) -> Column:
    """Exclusive running sums or maxima of an int array, in blocks so that a long array isn't copied for each entry."""
    n = F.size(a)
    begins = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(block))).otherwise(F.array().cast("array<int>"))
    blocks = F.transform(begins, lambda b: F.slice(a, b, block))
    sums = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda p, q: op(p, q)))
    return F.flatten(F.zip_with(blocks, _fold(sums, op, "int"), lambda x, o: F.transform(_fold(x, op, "int"), lambda v: op(v, o))))


def _add(p, q):
    return p + q


def _spans(text: Column, found: Column, pattern: str) -> Column:
    """Spans of the matches of a pattern: match lengths and the lengths of what lies between add up to offsets."""
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    each = F.zip_with(between, F.transform(found, lambda x: F.length(x)), lambda p, q: F.struct(p.alias("gap"), F.coalesce(q, F.lit(0)).alias("n")))
    before = running(F.transform(each, lambda x: x["gap"] + x["n"]), _add)
    at = F.zip_with(each, before, lambda x, b: F.struct((b + x["gap"]).alias("s"), (b + x["gap"] + x["n"]).alias("e")))
    spans = F.zip_with(F.slice(at, 1, F.greatest(F.size(found), F.lit(0))), found, lambda p, m: F.struct(p["s"].alias("s"), p["e"].alias("e"), m.alias("m")))
    return F.when(F.size(found) > 0, spans).otherwise(F.array().cast(_SPAN))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$")
    n = F.length(_digits(m))
    if kind == "card":
        return n.between(13, 19) & F.call_function("luhn_check", _digits(m))
    return n.between(9, 15)


def _valid_span(kind: str, x: Column) -> Column:
    return _valid(kind, x["m"])


def _guards(text: Column) -> dict[str, Column]:
    digit = text.rlike("[0-9]")
    return {"email": F.contains(text, F.lit("@")), "ip": digit & text.rlike(r"[0-9]\.[0-9]"), "card": digit, "phone": digit & F.contains(text, F.lit("+"))}


def _wide_guards(text: Column) -> dict[str, Column]:
    digit = text.rlike("[0-9]")
    return {"email": F.contains(text, F.lit("@")) | text.rlike(r"[(\[]at[)\]]| at [A-Za-z0-9-]+(?:\.| ?[(\[]dot| dot )"), "ip": text.rlike(r"[0-9]\.[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f:]"), "card": digit, "phone": digit}


def _matched(df: DataFrame, prefix: str, patterns: dict[str, str], guards: dict[str, Column]) -> DataFrame:
    """Adds span columns prefix_kind; matches are found first, and offsets only where there are any."""
    none = F.array().cast("array<string>")
    t = F.col("__t")
    df = df.withColumns({f"__g_{k}": guards[k] for k in KINDS})
    df = df.withColumns({f"__m_{k}": F.when(F.col(f"__g_{k}"), F.regexp_extract_all(t, F.lit(patterns[k]), 0)).otherwise(none) for k in KINDS})
    df = df.withColumns({f"{prefix}_{k}": F.when(F.size(f"__m_{k}") > 0, _spans(t, F.col(f"__m_{k}"), patterns[k])).otherwise(F.array().cast(_SPAN)) for k in KINDS})
    return df.drop(*(f"__{x}_{k}" for k in KINDS for x in "gm"))


def _with_base(df: DataFrame) -> DataFrame:
    df = _matched(df, "__b", BASE, _guards(F.col("__t")))
    return df.withColumns({f"__b_{k}": F.filter(f"__b_{k}", partial(_valid_span, k)) for k in KINDS})


# ---------------------------------------------------------------------------------------- features
def _side(c: Column, again: Column) -> Column:
    """What stands beside a span: nothing, space, letter, digit, other, or a separator with a digit behind it."""
    return F.when(c == "", 0).when(c.rlike(r"^[ ./-]$") & again.rlike("^[0-9]$"), 5).when(c.rlike(r"^\s"), 1).when(c.rlike(r"^\p{L}"), 2).when(c.rlike("^[0-9]"), 3).otherwise(4)


_CONTEXT = ((1, r"(?i)mail|phone|tel|call|fax|mobile|contact|write|reach"), (2, r"(?i)card|visa|payment|account|bank"), (3, r"(?i)token|key|pass|secret|hash|sha"), (4, r"(?i)order|invoice|isbn|version|serial|part no|ref|date"))


def _features(x: Column) -> Column:
    text = F.col("__t")
    m, d = x["m"], _digits(x["m"])
    before = F.substring(text, F.greatest(x["s"] - 23, F.lit(1)), F.least(x["s"], F.lit(24)))
    ctx = reduce(lambda c, p: c.when(before.rlike(p[1]), p[0]), _CONTEXT[1:], F.when(before.rlike(_CONTEXT[0][1]), _CONTEXT[0][0])).otherwise(0)
    has = lambda p: F.when(m.rlike(p), 1).otherwise(0)
    luhn = F.when(F.length(d).between(13, 19), F.call_function("luhn_check", d)).otherwise(F.lit(False))
    at = lambda k: F.when(k >= 1, F.substring(text, k, F.lit(1))).otherwise("")
    return F.struct(
        x["s"].alias("s"), x["e"].alias("e"),
        x["gen"].alias("gen"), F.least(F.length(d), F.lit(20)).alias("digits"), F.least((F.length(m) / 4).cast("int"), F.lit(10)).alias("len"),
        luhn.cast("int").alias("luhn"), _valid("ip", m).cast("int").alias("octets"),
        (has(" ") + 2 * has("-") + 4 * has("[().\\[]") + 8 * has("[:@]")).alias("sep"), has(r"^\+").alias("plus"),
        _side(at(x["s"]), at(x["s"] - 1)).alias("prev"), _side(at(x["e"] + 1), at(x["e"] + 2)).alias("next"), ctx.alias("ctx"),
    )


def _of_kind(kind: str, x: Column) -> Column:
    return F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), F.lit(KINDS.index(kind)).alias("gen"))


def _overlaps(x: Column, y: Column) -> Column:
    return (x["s"] < y["e"]) & (x["e"] > y["s"])


def _free(x: Column) -> Column:
    return ~F.exists("__b", lambda y: _overlaps(x, y))


def _with_candidates(df: DataFrame) -> DataFrame:
    """Adds __b, all base spans, and __c, the candidates of all generators that touch none of them, with their features."""
    df = _matched(df, "__w", WIDE, _wide_guards(F.col("__t")))
    for x in "bw":
        df = df.withColumn(f"__{x}", F.concat(*(F.transform(f"__{x}_{k}", partial(_of_kind, k)) for k in KINDS)))
    return df.withColumn("__w", F.filter("__w", _free)).withColumn("__c", F.transform("__w", _features)).drop("__w", *(f"__w_{k}" for k in KINDS))


# ------------------------------------------------------------------------------------ planted forms
def _groups(d: Column, sizes: tuple[int, ...], sep: str) -> Column:
    """Digits in groups, counted from the left; what is left over joins the last one."""
    at, parts = 1, []
    for i, n in enumerate(sizes):
        parts.append(F.substring(d, F.lit(at), F.lit(n) if i < len(sizes) - 1 else F.length(d)))
        at += n
    return F.concat_ws(sep, *parts)


def _forms() -> dict[str, list[tuple[Column, bool, Column]]]:
    """For each kind: new text, whether it is still personal data, and what stands before it."""
    m, before = F.col("b.m"), F.col("b.before")
    d = F.regexp_replace(m, "[^0-9]", "")
    name, host = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    wrong = F.concat(F.substring(d, F.lit(1), F.length(d) - 1), F.pmod(F.substring(d, -1, 1).cast("int") + 1, F.lit(10)).cast("string"))
    h, ten = F.md5(m.cast("binary")), F.lpad(d, 10, "0")
    ten = F.substring(ten, -10, 10)
    six = F.concat_ws(":", *(F.substring(h, 4 * i + 1, 4) for i in range(8)))
    some = F.concat(F.lit("fe80::"), F.substring(h, 1, 4), F.lit(":"), F.substring(h, 5, 3))
    order = F.lit(" see order no ")
    say = lambda at, dot: F.concat(name, F.lit(at), F.regexp_replace(host, r"\.", dot))
    return {
        "email": [(say(" (at) ", " (dot) "), True, before), (say(" [at] ", "."), True, before), (say(" @ ", "."), True, before), (say(" at ", " dot "), True, before)],
        "ip": [(six, True, before), (some, True, before), (F.regexp_replace(m, "^[0-9]+", "399"), False, before), (F.regexp_replace(m, "[0-9]+$", "777"), False, order)],
        "card": [(_groups(d, (4, 4, 4, 4), "."), True, before), (_groups(d, (4, 4, 4, 4), "  "), True, before), (_groups(d, (4, 4, 4, 4), "/"), True, before), (_groups(wrong, (4, 4, 4, 4), "."), False, before), (_groups(wrong, (4, 4, 4, 4), " "), False, before), (_groups(wrong, (4, 4, 4, 4), "-"), False, order), (wrong, False, before)],
        "phone": [(F.concat(F.lit("("), F.substring(ten, 1, 3), F.lit(") "), F.substring(ten, 4, 3), F.lit("-"), F.substring(ten, 7, 4)), True, before), (_groups(ten, (3, 3, 4), "."), True, before), (_groups(F.concat(F.lit("0"), ten), (4, 3, 4), " "), True, before), (_groups(ten, (3, 3, 4), "-"), True, before), (_groups(ten, (3, 3, 4), "-"), False, order), (_groups(ten, (4, 3, 3), " "), False, order)],
    }


def planted(spans: DataFrame) -> DataFrame:
    """Rows (h, features, right, wrong, plain) of the candidates in every form of the given base spans (h, b)."""
    forms = [F.when(F.col("b.gen") == KINDS.index(k), F.array(*(F.struct(t.alias("m"), F.lit(y).alias("right"), c.alias("before")) for t, y, c in fs))) for k, fs in _forms().items()]
    rows = spans.select("h", F.col("b.gen").alias("kind"), F.col("b.after").alias("after"), F.explode(F.coalesce(*forms)).alias("f"))
    rows = rows.select("h", "kind", F.col("f.right").alias("right"), F.length("f.before").alias("s"), (F.length("f.before") + F.length("f.m")).alias("e"), F.concat("f.before", "f.m", "after").alias("__t"))
    rows = _with_candidates(_with_base(rows)).select("h", "kind", "right", "s", "e", F.explode("__c").alias("c")).where(_overlaps(F.struct("s", "e"), F.col("c")))
    right = F.col("right") & (F.col("c.gen") == F.col("kind"))
    return rows.select("h", "c", right.cast("int").alias("right"), (~right).cast("int").alias("wrong"), F.lit(0).alias("plain"))


# ------------------------------------------------------------------------------------------ boosting
class Trees:
    """Boosted depth-two trees over integer features: (feature, threshold, left, right), leaves are numbers."""

    def __init__(self, trees: list, bias: float, thresholds: dict[int, float]):
        self.trees, self.bias, self.thresholds = trees, bias, thresholds

    def margin(self, x: np.ndarray) -> np.ndarray:
        names = list(FEATURES)
        def walk(t, rows):
            if not isinstance(t, tuple):
                return np.full(len(rows), t)
            go = rows[:, names.index(t[0])] <= t[1]
            return np.where(go, walk(t[2], rows), walk(t[3], rows))
        return self.bias + sum((walk(t, x) for t in self.trees), np.zeros(len(x)))

    def column(self, c: Column) -> Column:
        """The margin of a candidate struct as an expression."""
        def walk(t):
            return F.lit(float(t)) if not isinstance(t, tuple) else F.when(c[t[0]] <= t[1], walk(t[2])).otherwise(walk(t[3]))
        return reduce(lambda p, q: p + q, (walk(t) for t in self.trees), F.lit(float(self.bias)))

    def chosen(self, c: Column) -> Column:
        if not self.trees or not self.thresholds:
            return F.lit(False)
        limit = reduce(lambda w, p: w.when(c["gen"] == p[0], F.lit(p[1])), self.thresholds.items(), F.when(F.lit(False), F.lit(0.0)))
        return F.coalesce(F.round(self.column(c), 9) >= limit, F.lit(False))


def _best_split(x, g, h, rows):
    """The feature and threshold with the largest gain among the given rows."""
    best = (1e-9, None, None)
    total = g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
    for f, (name, size) in enumerate(FEATURES.items()):
        gs, hs = (np.cumsum(np.bincount(x[rows, f], v[rows], minlength=size)) for v in (g, h))
        gain = gs[:-1] ** 2 / (hs[:-1] + 1.0) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1.0) - total
        if len(gain) and gain.max() > best[0]:
            best = (gain.max(), name, int(gain.argmax()))
    return best


def fit_trees(x: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> Trees:
    """Boosting on feature combinations with label counts; thresholds are still missing."""
    if not pos.sum() or not neg.sum():
        return Trees([], 0.0, {})
    names, trees = list(FEATURES), []
    bias = float(np.log(pos.sum() / neg.sum()))
    margin = np.full(len(x), bias)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-margin))
        g, h = pos - (pos + neg) * p, (pos + neg) * p * (1 - p)
        leaf = lambda rows: float(RATE * g[rows].sum() / (h[rows].sum() + 1.0))
        def grow(rows, depth):
            gain, name, at = _best_split(x, g, h, rows) if depth else (0, None, None)
            if name is None:
                return leaf(rows)
            left = rows & (x[:, names.index(name)] <= at)
            return (name, at, grow(left, depth - 1), grow(rows & ~left, depth - 1))
        tree = grow(np.ones(len(x), bool), 2)
        trees.append(tree)
        margin = Trees(trees, bias, {}).margin(x)
    return Trees(trees, bias, {})


def counted(right, wrong, plain) -> tuple[np.ndarray, np.ndarray]:
    """Label counts of alike candidates: those without a label are wrong where they outnumber the planted right ones."""
    return np.asarray(right, float), np.asarray(wrong + np.where(plain > right, plain, 0), float)


def calibrate(rows: list[tuple[int, float, int, int]]) -> dict[int, float]:
    """Thresholds from (generator, margin, right, wrong) counts.

    A generator's threshold is the lowest whose selection is right for PRECISION of its candidates, but no margin below 0,
    where candidates are more likely wrong than right; a generator without such a threshold selects nothing.
    """
    thresholds = {}
    for gen in range(len(KINDS)):
        own = sorted(((m, p, n) for g, m, p, n in rows if g == gen and m >= 0), reverse=True)
        tp, fp = (np.cumsum([r[i] for r in own]) for i in (1, 2))
        good = np.flatnonzero((tp > 0) & (tp >= PRECISION * (tp + fp)))
        if len(good):
            thresholds[gen] = own[good[-1]][0] - 1e-9
    return thresholds


def scanned(docs: DataFrame, text_col: str, *keep: Column) -> DataFrame:
    """Stored rows: ``keep``, base spans by kind and candidates.  Texts are read once, and not stored."""
    text = F.col("__t")
    df = _with_candidates(_with_base(docs.withColumn("__t", F.coalesce(F.col(text_col), F.lit("")))))
    around = lambda x: x.withField("before", F.substring(text, F.greatest(x["s"] - 39, F.lit(1)), F.least(x["s"], F.lit(40)))).withField("after", F.substring(text, x["e"] + 1, F.lit(24)))
    return C.stored(df.select(*keep, *(F.col(f"__b_{k}") for k in KINDS), F.transform("__b", around).alias("__b"), "__c"), "pii")


def _hash(id_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> Trees:
    """Fits on about ``sample_docs`` documents, chosen by a hash of the id; all documents calibrate."""
    return _learn(scanned(docs, text_col, _hash(id_col).alias("h")), sample_docs)


def _learn(found: DataFrame, sample_docs: int) -> Trees:
    share = max(1, found.count() // max(1, sample_docs))
    plain = found.select("h", F.explode("__c").alias("c")).select("h", "c", F.lit(0).alias("right"), F.lit(0).alias("wrong"), F.lit(1).alias("plain"))
    rows = C.stored(plain.union(planted(found.select("h", F.explode("__b").alias("b")))), "pii-labels")
    counts = [F.sum(x).alias(x) for x in ("right", "wrong", "plain")]
    table = rows.where(F.pmod("h", F.lit(share)) == 0).groupBy(*(F.col(f"c.{n}").alias(n) for n in FEATURES)).agg(*counts)
    got = sorted(tuple(r) for r in table.collect())
    if not got:
        return Trees([], 0.0, {})
    a = np.array(got)
    k = len(FEATURES)
    right, wrong = counted(*a[:, k:].T)
    trees = fit_trees(a[:, :k].astype(int), right, wrong)
    if not trees.trees:
        return trees
    margins = rows.groupBy(F.col("c.gen").alias("gen"), F.round(trees.column(F.col("c")), 9).alias("margin")).agg(*counts)
    got = margins.collect()
    labels = counted(*(np.array([r[x] for r in got]) for x in ("right", "wrong", "plain")))
    trees.thresholds = calibrate([(r.gen, r.margin, p, n) for r, p, n in zip(got, *labels)])
    return trees


# ---------------------------------------------------------------------------------------- operator
def _written(kind: str, x: Column) -> Column:
    return F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string"))


def _tagged(kind: str, x: Column) -> Column:
    return F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(f"[{kind.upper()}]").alias("k"))


def _better(x: Column, y: Column) -> Column:
    """Whether an overlapping selected candidate y is better than x; ties go to the longer, then to the kind listed first."""
    rank = lambda z: F.struct(z["margin"], z["e"] - z["s"], -z["gen"], -z["s"])
    return _overlaps(x, y) & (rank(y) > rank(x))


def _selected(trees: Trees) -> Column:
    """The candidates in __c that the trees select and no better overlapping one beats."""
    scored = F.transform(F.filter("__c", trees.chosen), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["gen"].alias("gen"), F.round(trees.column(x), 9).alias("margin")))
    return F.filter(scored, lambda x: ~F.exists(scored, lambda y: _better(x, y)))


def _is_kind(gen: int, x: Column) -> Column:
    return x["gen"] == gen


def _text_of(spans: dict[str, Column]) -> Column:
    return F.array_join(F.concat(*(F.transform(spans[k], partial(_written, k)) for k in KINDS)), ",")


def _pairs(a: Column) -> Column:
    return F.transform(a, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))


def _with_all(df: DataFrame, trees: Trees) -> DataFrame:
    """Adds all spans of each kind (__a_kind), sorted."""
    df = df.withColumn("__x", _selected(trees) if trees.trees and trees.thresholds else F.array().cast("array<struct<s:int,e:int,gen:int,margin:double>>"))
    added = {k: F.filter("__x", partial(_is_kind, KINDS.index(k))) for k in KINDS}
    return df.withColumns({f"__a_{k}": F.array_sort(F.concat(_pairs(F.col(f"__b_{k}")), _pairs(added[k]))) for k in KINDS})


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """One row for each row of docs: id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Counts and base_sha256 are of the base spans, ``spans`` lists these and those that the trees add.  Offsets are
    code points, ends exclusive.  Null text counts as empty.  Without base spans to learn from nothing is added.
    Rows are independent, ids may be null or repeat, and other columns of docs are ignored.
    """
    found = scanned(docs, text_col, F.col(id_col).alias("__id"), _hash(id_col).alias("h"))
    df = _with_all(found, _learn(found, sample_docs))
    return df.select(
        F.col("__id").alias(id_col), *(F.size(f"__b_{k}").cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(_text_of({k: F.col(f"__b_{k}") for k in KINDS}).cast("binary"), 256).alias("base_sha256"),
        _text_of({k: F.col(f"__a_{k}") for k in KINDS}).alias("spans"),
    )


def redact(docs: DataFrame, trees: Trees, text_col: str = "text") -> DataFrame:
    """docs with every span of personal data in text_col replaced by its kind in brackets; null stays null."""
    columns = docs.columns
    df = docs.withColumn("__t", F.coalesce(F.col(text_col), F.lit("")))
    df = _with_all(_with_candidates(_with_base(df)), trees)
    tagged = F.array_sort(F.concat(*(F.transform(f"__a_{k}", partial(_tagged, k)) for k in KINDS)))
    df = df.withColumn("__s", tagged)
    df = df.withColumn("__d", running(F.transform("__s", lambda x: x["e"]), F.greatest))  # how far earlier spans reach
    df = df.withColumn("__s", F.filter(F.zip_with("__s", "__d", lambda x, d: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"), d.alias("d"))), lambda x: x["e"] > x["d"]))
    t = F.col("__t")
    pieces = F.transform("__s", lambda x: F.concat(F.substring(t, x["d"] + 1, F.greatest(x["s"] - x["d"], F.lit(0))), x["k"]))
    last = F.array_max(F.transform("__s", lambda x: x["e"]))
    new = F.when(F.size("__s") > 0, F.concat(F.array_join(pieces, ""), F.substring(t, last + 1, F.length(t)))).otherwise(F.col(f"`{text_col}`"))
    return df.withColumn(text_col, new).select(*(F.col(f"`{c}`") for c in columns))
