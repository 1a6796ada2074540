"""Personal data: strict patterns plus gradient-boosted candidates, in DataFrame functions only.

Matches carry no positions in SQL, so a pattern is applied twice, once to split a text and once to
extract: positions are the running lengths of both. High-recall generators propose further spans,
which may overlap each other; each is described by a few small integers of format and of context.
Two views teach each other, so that neither learns the strict patterns by heart. Boosted trees on the
context (words before, sign before and after) are fitted to whether a candidate is a strict match;
what they say of a context is then the label that boosted trees on the format (digits, groups,
separators, length) are fitted to. A candidate's score is the sum of both. The fits use counts of
(features, label) over all candidates of all documents, half of the texts for the trees and half for
the thresholds, one a generator; the count table's size is bounded by the features' ranges, not by
the corpus.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

KINDS = ("email", "ip", "card", "phone")

# The contract's patterns. Possessive quantifiers and the look-behind keep the search linear: a run
# is tried at its start, or where the last match ended, and never given back.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PATTERNS = {"email": _EMAIL, "ip": _IP, "card": _CARD, "phone": _PHONE}

# High-recall generators: addresses with a spelled or spaced @ and dot, dotted or spaced digit
# groups with anything a number is written with, and bare digit runs.
_LOOSE_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|\(at\)|\[at\]|\{at\})\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]{1,63}+){1,8}+"
_LOOSE_NUMBER = r"(?<![A-Za-z0-9])[+(]?[0-9][0-9\x20()./:_-]*[0-9](?![A-Za-z0-9])"
_LOOSE_RUN = r"(?<![A-Za-z0-9])[0-9]{9,}+(?![A-Za-z0-9])"
GENERATORS = {"address": _LOOSE_EMAIL, "number": _LOOSE_NUMBER, "run": _LOOSE_RUN}

#: What every text with a match or candidate has: an at sign, spelled or not, or a digit.
WORTH = r"[0-9]|@|at[)\]}]"

_BLOCK = 256


def _running(lengths: Column) -> Column:
    """Sums of all elements before each one; blocks keep copying linear in the array's length."""
    n = F.size(lengths)

    def within(part):
        return F.aggregate(part, F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<long>").alias("a")),
                           lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["a"], F.array(acc["s"])).alias("a")))["a"]

    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int")), lambda b: F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK)))
    starts = within(F.transform(blocks, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + x)))
    filled = F.flatten(F.zip_with(blocks, starts, lambda p, s: F.transform(within(p), lambda x: x + s)))
    return F.when(n > 0, filled).otherwise(F.array().cast("array<long>"))


def matches(text: Column, pattern: str, possible: Column) -> Column:
    """array<struct<start, end, hit>> of the leftmost non-overlapping matches, in code points."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: (F.length(g) + F.length(h)).cast("long"))

    def place(before):
        return F.transform(
            F.arrays_zip(before.alias("b"), F.slice(gaps, 1, F.size(hits)).alias("g"), hits.alias("h")),
            lambda z: F.struct((z["b"] + F.length(z["g"])).alias("start"), (z["b"] + F.length(z["g"]) + F.length(z["h"])).alias("end"), z["h"].alias("hit")),
        )

    none = F.array().cast("array<struct<start:long,end:long,hit:string>>")
    return F.when(possible & (F.size(hits) > 0), place(_running(steps))).otherwise(none)


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum."""
    n = F.length(d)

    def term(i):
        v = F.substring(d, (n - i).cast("int"), F.lit(1)).cast("int")
        return F.when(i % 2 == 1, F.when(v > 4, v * 2 - 9).otherwise(v * 2)).otherwise(v)

    return (n > 0) & (F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(0), lambda a, i: a + term(i)) % 10 == 0)


def _valid(kind: str, hit: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        trimmed = F.transform(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(trimmed, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))
    n = F.length(digits(hit))
    return n.between(9, 15) if kind == "phone" else n.between(12, 19) & luhn(digits(hit))


def _possible(kind: str, text: Column) -> Column:
    return {"email": text.contains("@"), "phone": text.contains("+"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9]")}[kind]


def base_spans(text: Column) -> Column:
    """array<struct<start, ord, end>> of the strict matches of all kinds, sorted; ord is the kind's place."""

    def of(i: int, kind: str) -> Column:
        found = F.filter(matches(text, PATTERNS[kind], _possible(kind, text)), lambda m: _valid(kind, m["hit"]))
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(i).alias("ord"), m["end"].alias("end")))

    return F.array_sort(F.concat(*[of(i, kind) for i, kind in enumerate(KINDS)]))


# ---- candidates

#: Feature names and ranges: the count table has at most the product of the ranges as rows, twice.
RANGES = {"shape": 3, "n_digits": 7, "n_groups": 3, "seps": 4, "length": 4, "cue": 5, "opened": 2, "bounded": 2}
FEATURES = tuple(RANGES)
CONTEXT, FORMAT = ("cue", "opened", "bounded"), ("shape", "n_digits", "n_groups", "seps", "length")
CUES = {1: r"e-?mail|mail|contact|write", 2: r"\bip\b|host|server|addr", 3: r"card|visa|iban|account|payment", 4: r"phone|tel\b|call|fax|mobile|cell"}


def _binned(x: Column, edges) -> Column:
    return reduce(lambda acc, e: acc + (x >= e).cast("int"), edges, F.lit(0))


def _features(c: Column, text: Column) -> Column:
    """The feature struct of a candidate (start, end, hit, shape)."""
    hit, d = c["hit"], F.length(digits(c["hit"]))
    groups = F.size(F.split(F.trim(F.regexp_replace(hit, "[^0-9]+", " ")), " "))
    cue_text = F.lower(F.substring(text, F.greatest(c["start"] - 23, F.lit(1)).cast("int"), F.least(c["start"], F.lit(24)).cast("int")))
    cue = reduce(lambda acc, k: F.when(cue_text.rlike(CUES[k]), F.lit(k)).otherwise(acc), sorted(CUES, reverse=True), F.lit(0))
    after = F.substring(text, (c["end"] + 1).cast("int"), F.lit(1))
    before = F.substring(text, c["start"].cast("int"), F.when(c["start"] > 0, 1).otherwise(0))
    seps = F.when(hit.rlike(r"[()]"), 3).when(hit.rlike(r"[0-9]\.[0-9]"), 1).when(hit.rlike(r"[0-9][\x20-][0-9]"), 2).otherwise(0)
    return F.struct(
        c["shape"].alias("shape"),
        _binned(d, (4, 7, 9, 10, 12, 16)).alias("n_digits"),
        _binned(groups, (2, 3)).alias("n_groups"),
        seps.alias("seps"),
        _binned(F.length(hit), (8, 12, 18)).alias("length"),
        cue.alias("cue"),
        ((before == "") | before.rlike(r"[\s(\"':=]")).cast("int").alias("opened"),
        ((after == "") | after.rlike(r"[\s,.;:!?)\"']")).cast("int").alias("bounded"),
    )


def candidates(text: Column, base: Column) -> Column:
    """array<struct<start, end, kind, features, label>>: every generator's proposals.

    kind is the place of the strict kind that overlaps a candidate most simply: the first base span
    that shares a character with it, or -1; the label is 1 if there is one.
    """

    def proposed(i: int, name: str) -> Column:
        possible = text.rlike(r"[0-9]{2}") if name != "address" else text.rlike(r"@|at[)\]}]")
        found = matches(text, GENERATORS[name], possible)
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["hit"].alias("hit"), F.lit(i).alias("shape")))

    def described(c):
        near = F.filter(base, lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"]))
        kind = F.when(F.size(near) > 0, near[0]["ord"]).otherwise(F.lit(-1))
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), kind.alias("kind"), _features(c, text).alias("f"))

    return F.transform(F.concat(*[proposed(i, name) for i, name in enumerate(GENERATORS)]), described)


# ---- boosted trees on the count table


@dataclass(frozen=True)
class Tree:
    """Depth 2: a split, a split on either side, four leaves. A split is (feature, value): x <= value."""

    root: tuple[str, int]
    left: tuple[str, int]
    right: tuple[str, int]
    leaves: tuple[float, float, float, float]

    def column(self, f) -> Column:
        def go(split, yes, no):
            return F.when(f(split[0]) <= split[1], yes).otherwise(no)

        a, b, c, d = (F.lit(float(x)) for x in self.leaves)
        return go(self.root, go(self.left, a, b), go(self.right, c, d))

    def value(self, row: dict) -> float:
        a, b, c, d = self.leaves
        if row[self.root[0]] <= self.root[1]:
            return a if row[self.left[0]] <= self.left[1] else b
        return c if row[self.right[0]] <= self.right[1] else d


LEAST_ROWS = 10  # candidates on either side of a split


def _best_split(rows, grads, hess, names):
    """The split of least loss by second-order gain; None if nothing separates the rows.

    A side has LEAST_ROWS candidates or more: what is rare and looks like a strict match is judged
    with its like, not by its own missing label.
    """
    g, h = sum(grads), sum(hess)
    best = (1e-9, None)
    for name in names:
        width = RANGES[name]
        gs, hs, ns = [0.0] * width, [0.0] * width, [0.0] * width
        for r, a, b in zip(rows, grads, hess, strict=True):
            gs[r[name]] += a
            hs[r[name]] += b
            ns[r[name]] += r["n0"] + r["n1"]
        gl = hl = nl = 0.0
        for v in range(width - 1):
            gl, hl, nl = gl + gs[v], hl + hs[v], nl + ns[v]
            if min(nl, sum(ns) - nl) < LEAST_ROWS:
                continue
            gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
            if gain > best[0]:
                best = (gain, (name, v))
    return best[1]


def fit(counts: list[dict], names: tuple[str, ...] = FEATURES, rounds: int = 30, rate: float = 0.4) -> tuple[float, list[Tree]]:
    """Boosted trees on the named features for the log odds of label 1, from rows with n0 and n1."""
    n1, n0 = sum(r["n1"] for r in counts), sum(r["n0"] for r in counts)
    bias = math.log((n1 + 1) / (n0 + 1))
    score = [bias] * len(counts)
    trees = []
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-s)) for s in score]
        grads = [r["n1"] - (r["n1"] + r["n0"]) * q for r, q in zip(counts, p, strict=True)]
        hess = [(r["n1"] + r["n0"]) * q * (1 - q) for r, q in zip(counts, p, strict=True)]
        root = _best_split(counts, grads, hess, names)
        if root is None:
            break
        splits, leaves = [], []
        for side in (True, False):
            idx = [i for i, r in enumerate(counts) if (r[root[0]] <= root[1]) == side]
            split = _best_split([counts[i] for i in idx], [grads[i] for i in idx], [hess[i] for i in idx], names) or root
            splits.append(split)
            for low in (True, False):
                part = [i for i in idx if (counts[i][split[0]] <= split[1]) == low]
                leaves.append(rate * sum(grads[i] for i in part) / (sum(hess[i] for i in part) + 1))
        tree = Tree(root, splits[0], splits[1], tuple(max(-4.0, min(4.0, x)) for x in leaves))
        trees.append(tree)
        score = [s + tree.value(r) for s, r in zip(score, counts, strict=True)]
    return bias, trees


def calibrate(counts: list[dict], score, precision: float = 0.9) -> float:
    """The threshold on a score: halfway between the least score down to which the labelled candidates
    have this precision and the next score below; infinite if there is none."""
    groups: dict[float, list[float]] = {}
    for r in counts:
        pair = groups.setdefault(score(r), [0, 0])
        pair[0] += r["n0"]
        pair[1] += r["n1"]
    scores = sorted(groups, reverse=True)
    good = bad = 0.0
    best = math.inf
    for i, s in enumerate(scores):
        bad, good = bad + groups[s][0], good + groups[s][1]
        if good and good >= precision * (good + bad):
            best = (s + scores[i + 1]) / 2 if i + 1 < len(scores) else s
    return best


@dataclass(frozen=True)
class Model:
    """Bias, the trees of both views, and a threshold for each generator."""

    bias: float
    trees: tuple[Tree, ...]
    thresholds: tuple[float, ...]

    def log_odds(self, features: Column) -> Column:
        total = F.lit(float(self.bias))
        for t in self.trees:
            total = total + t.column(lambda name: features[name])
        return total

    def value(self, row: dict) -> float:
        total = self.bias  # summed in the order of log_odds, so that equal candidates score alike in both
        for t in self.trees:
            total += t.value(row)
        return total

    def chosen(self, features: Column) -> Column:
        """Whether a candidate reaches its generator's threshold."""
        open_ = [(i, t) for i, t in enumerate(self.thresholds) if not math.isinf(t)]
        if not open_:
            return F.lit(False)
        score = self.log_odds(features)
        return reduce(lambda acc, it: acc | ((features["shape"] == it[0]) & (score >= it[1])), open_, F.lit(False))


SURE = 8.0  # log odds that a view's labels are cut to


def learned(rows: list[dict], precision: float = 0.9) -> Model:
    """The model of count rows: features, fold (0 for trees, 1 for thresholds), n0 and n1.

    Thresholds are for a precision among a generator's candidates of the held-out fold, in which a
    strict match counts as one and another candidate as what its context alone says.
    """
    fitted, held = [r for r in rows if not r["fold"]], [r for r in rows if r["fold"]]
    if not any(r["n1"] for r in fitted) or not any(r["n1"] for r in held):
        return Model(0.0, (), (math.inf,) * len(GENERATORS))
    bias, context = fit(fitted, CONTEXT)

    def told(r: dict) -> float:
        z = bias + sum(t.value(r) for t in context)
        return 1 / (1 + math.exp(-max(-SURE, min(SURE, z))))

    soft = [r | {"n1": (r["n0"] + r["n1"]) * told(r), "n0": (r["n0"] + r["n1"]) * (1 - told(r))} for r in fitted]
    prior, shape = fit(soft, FORMAT)
    trees = (*context, *shape)
    plain = Model(prior, trees, ())
    judged = [r | {"n1": r["n1"] + r["n0"] * told(r), "n0": r["n0"] * (1 - told(r))} for r in held]
    return Model(prior, trees, tuple(calibrate([r for r in judged if r["shape"] == i], plain.value, precision) for i in range(len(GENERATORS))))


def train(docs: DataFrame, text_col: str = "text", precision: float = 0.9) -> Model:
    """Fit on the candidates of every document; only their (features, label) counts reach the driver."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(text.alias("text")).where(F.col("text").rlike(WORTH))
    found = slim.select("text", base_spans(F.col("text")).alias("base"), (F.crc32(F.col("text").cast("binary")) % 2).cast("int").alias("fold"))
    found = found.select("fold", F.explode(candidates(F.col("text"), F.col("base"))).alias("c"))
    label = (F.col("c.kind") >= 0).cast("int")
    counts = found.groupBy(*[F.col("c.f")[n].alias(n) for n in FEATURES], "fold").agg(F.sum(label).alias("n1"), F.sum(1 - label).alias("n0")).orderBy(*FEATURES, "fold")
    return learned([r.asDict() for r in counts.collect()], precision)


def find(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with base_spans and all_spans: sorted arrays of struct<start, ord, end>.

    Added spans are the selected candidates that share no character with a base span, ord 4 for
    addresses and 5 for numbers; base spans always stay. A null text is empty and has no spans.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    worth = text.rlike(WORTH)
    none = F.array().cast("array<struct<start:long,ord:int,end:long>>")
    marked = docs.withColumn("base_spans", F.when(worth, base_spans(text)).otherwise(none))
    if all(math.isinf(t) for t in model.thresholds):
        return marked.withColumn("all_spans", F.col("base_spans"))
    chosen = F.filter(candidates(text, F.col("base_spans")), lambda c: (c["kind"] < 0) & model.chosen(c["f"]))
    added = F.transform(chosen, lambda c: F.struct(c["start"].alias("start"), F.when(c["f"]["shape"] == 0, 4).otherwise(5).alias("ord"), c["end"].alias("end")))
    return marked.withColumn("all_spans", F.when(worth, F.array_sort(F.array_distinct(F.concat(F.col("base_spans"), added)))).otherwise(none))


SPAN_NAMES = (*KINDS, "address", "number")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, by start and then kind."""
    names = F.array(*[F.lit(k) for k in SPAN_NAMES])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["ord"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Null texts count as empty, repeated rows stay, an empty table gives no rows; other columns are
    ignored.
    """
    model = train(docs, text_col)
    slim = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("__text"))
    found = find(slim, model, "__text")
    def count(i: int) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["ord"] == i)).cast("long").alias(f"n_{KINDS[i]}")

    counts = [count(i) for i in range(len(KINDS))]
    return found.select(id_col, *counts, F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"), joined(F.col("all_spans")).alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by its first kind's tag, as [EMAIL]."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in SPAN_NAMES])
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        new = F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(gap, F.get(names, s["ord"]))).alias("out"))
        longer = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        return F.when((s["start"] < acc["at"]), longer).otherwise(new)

    done = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def redacted(docs: DataFrame, text_col: str = "text", n_chars_col: str = "n_chars") -> DataFrame:
    """docs with every found span replaced by its tag; a column of text lengths follows the new text.

    Other columns stay as they are, and null texts stay null.
    """
    model = train(docs, text_col)
    found = find(docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(text_col).alias("__text")), model, "__text")
    new = F.when(F.col("__text").isNotNull(), redact(F.col("__text"), F.col("all_spans")))
    length = F.when(F.size("all_spans") > 0, F.length(new).cast(docs.schema[n_chars_col].dataType)).otherwise(F.col("row")[n_chars_col]) if n_chars_col in docs.columns else None
    return found.select(*[(new if c == text_col else length if c == n_chars_col else F.col("row")[c]).alias(c) for c in docs.columns])
