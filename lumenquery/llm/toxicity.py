"""Toxicity scores of deobfuscated text.

1. A character trigram model is counted over every document.
2. Words that could hide another one (look-alike digits and symbols, letters said over and over,
   letters set apart by spaces or dots) become lattices of what each sign may stand for; Viterbi
   decoding under the character model restores the likeliest spelling. A word without such signs
   has a lattice of one path and stays as it is.
3. The restored words and their beginnings are features of a logistic regression that is fitted to
   at most `SAMPLE` labelled rows, the first in the order of a hash of their ids.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lumenquery.llm.frames import map_batches, texts
from lumenquery.session import cut

SAMPLE = 20_000  # labelled rows that the regression sees at most
MIN_ROWS = 4  # toxic rows that a feature must occur in
MIN_SHARE = 0.35  # share of toxic rows among a feature's rows
SURE = 0.9  # a feature whose smoothed share is at least this speaks for itself

# ---- alphabet of the character model: boundary, a-z, the Latin-1 small letters, any other sign
_LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
OTHER = len(_LETTERS) + 1
SIGNS = OTHER + 1
_CODE = np.zeros(0x110000, dtype=np.uint8)
_CODE[0x100:] = OTHER
for _n, _ch in enumerate(_LETTERS):
    _CODE[ord(_ch)] = _n + 1
_CODE[ord("0") : ord("9") + 1] = OTHER

# ---- the channel: what a sign may stand for (fixed values), and the costs in nats
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¥": "y", "¢": "c", "§": "s",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ο": "o", "α": "a", "ε": "e", "ι": "i",
}
WILD = "*#%&?"  # may hide any letter, or nothing
APART = ".-_~'`^:;,/\\=\"[]{})>"  # may be set between letters
SUBSTITUTE, DROP, DROP_EDGE, HIDE, KEEP_SIGN, SQUEEZE, JOIN, SPLIT = 1.0, 9.0, 1.0, 2.0, 0.7, 0.6, 0.2, 4.0
_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_PLAIN_EDGES = " \t\r\n.,;:\"'[]{}«»„“”‚‘’…"
_EDGES = " \t\r\n.,;:!?\"'()[]{}<>«»„“”‚‘’…¿¡"
_SUSPECT = re.compile("[" + re.escape("".join(LOOKALIKES) + WILD + APART) + r"]|(.)\1\1")
_SPACED = re.compile(r"(?<!\S)(?:[^\W_]|[" + re.escape("".join(c for c in LOOKALIKES if c not in "0123456789") + "*") + r"])(?:[ \t._*-]{1,2}(?:[^\W_]|[@$!|+]))" + r"{2,}(?!\S)")


def _counts(lines: list[str]) -> np.ndarray:
    """Trigram codes of lower-case lines; every non-letter is a boundary, digits are `other`."""
    joined = "\n".join(lines).lower().encode("utf-32-le", "replace")
    code = _CODE[np.minimum(np.frombuffer(joined, dtype="<u4"), 0x10FFFF)].astype(np.int32)
    code = np.concatenate(([0, 0], code, [0]))
    return (code[:-2] * SIGNS + code[1:-1]) * SIGNS + code[2:]


def char_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Costs -log P(c | a, b) as an array [a, b, c], from trigram counts over all texts.

    Each task adds up its own counts; at most SIGNS**3 rows a task are shuffled and reach the driver.
    """

    def run(batches):
        total = np.zeros(SIGNS**3, dtype=np.int64)
        for b in batches:
            found = texts(b.column(0))
            for at in range(0, len(found), 200):
                total += np.bincount(_counts(found[at : at + 200]), minlength=SIGNS**3)
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["gram", "n"])

    rows = map_batches(docs.select(text_col), run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    count = np.zeros((SIGNS, SIGNS, SIGNS))
    for r in rows:
        count.reshape(-1)[r.gram] = r.n
    one = (count.sum(axis=(0, 1)) + 0.5) / (count.sum() + 0.5 * SIGNS)
    two = (count.sum(axis=0) + 4 * one) / (count.sum(axis=(0, 2))[:, None] + 4)
    three = (count + 8 * two[None]) / (count.sum(axis=2)[:, :, None] + 8)
    return -np.log(three).astype(np.float32)


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """Slots of (spelling, cost), one for each run of a sign."""
    slots = []
    at = 0
    while at < len(word):
        ch = word[at]
        end = at
        while end < len(word) and word[end] == ch:
            end += 1
        edge = at == 0 or end == len(word)
        drop = DROP_EDGE if edge else DROP
        n, at = end - at, end
        if ch in LOOKALIKES:
            options = [(x * k, SUBSTITUTE + SQUEEZE * (n - k)) for x in LOOKALIKES[ch] for k in {1, min(n, 2)}]
            options.append((ch * min(n, 2), KEEP_SIGN) if ch.isalnum() else ("", drop))
        elif ch in WILD:
            options = [("", drop)] + [(x, HIDE + 1.0 * (n - 1)) for x in "abcdefghijklmnopqrstuvwxyz"]
        elif ch in APART:
            options = [("", JOIN), (" ", SPLIT)]
        elif ch in " \t":
            options = [("", JOIN * n), (" ", SPLIT / n)]
        else:
            options = [(ch, SQUEEZE * (n - 1) if n > 2 else 0.4 * (n - 1))]
            if n > 1:
                options.append((ch * 2, 0.0 if n == 2 else SQUEEZE * (n - 2)))
        slots.append(options)
    return slots


def decode(word: str, cost: list[list[list[float]]]) -> str:
    """The likeliest spelling of a lower-case word: Viterbi with the last two signs as state.

    Paths share their beginnings, so time and memory grow with the word's length alone.
    """
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for options in lattice(word):
        nxt: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (total, path) in states.items():
            for spelling, price in options:
                x, y, c = a, b, total + price
                for ch in spelling:
                    z = int(_CODE[ord(ch)])
                    c += cost[x][y][z]
                    x, y = y, z
                if (x, y) not in nxt or c < nxt[x, y][0]:
                    nxt[x, y] = (c, (spelling, path) if spelling else path)
        states = nxt
    _, path = min(((total + cost[a][b][0], path) for (a, b), (total, path) in states.items()), key=lambda x: x[0])
    out = []
    while path:
        out.append(path[0])
        path = path[1]
    return "".join(reversed(out))


def beginnings(word: str) -> list[str]:
    """The features of a restored word: itself and its first letters."""
    return [word] + [word[:n] + "~" for n in (4, 5, 6, 7, 8) if len(word) >= n]


class Restorer:
    """Words of texts as restored, with a bounded memory of words seen."""

    KEPT = 150_000

    def __init__(self, cost: np.ndarray):
        self.cost = cost.tolist()
        self.kept: dict[str, tuple[str, ...]] = {}

    def word(self, token: str) -> tuple[str, ...]:
        """The restored words of one token."""
        bare = token.strip(_PLAIN_EDGES)
        core = bare.strip(_EDGES)
        # "!diot" and "(lown" hide letters at their edges, "really!" and "(now)" do not: the lattice
        # decides, which may drop edge signs or read them, and only where letters follow them directly
        bare = bare.rstrip(_EDGES) if core and core[0].isalpha() and bare[0] in "!(<" and bare[-1] not in ")>" else core
        bare = unicodedata.normalize("NFKC", _INVISIBLE.sub("", bare)).lower() if not bare.isascii() else bare
        if len(bare) < 2 or not _SUSPECT.search(bare):
            return (bare,) if bare else ()
        if not any(c.isalpha() or c in "@$!|*" for c in bare):
            return (bare,)
        return tuple(decode(bare, self.cost).split())

    def spaced(self, lower: str) -> list[str]:
        """Words that stand spelled out with spaces."""
        out = []
        for m in _SPACED.finditer(lower):
            signs = m.group()
            if len(set(signs)) > 3:
                out += decode(signs, self.cost).split()
        return out

    def words(self, text: str) -> set[str]:
        """All restored words of a text, spaced-out spellings included."""
        lower = text.lower()
        return {w for token in set(lower.split()) for w in self.word(token)}.union(self.spaced(lower))

    def features(self, text: str) -> set[str]:
        return {f for w in self.words(text) for f in beginnings(w)}

    def known(self, text: str, lexicon) -> set[str]:
        """The features of a text that a lexicon has; what each token has of it is remembered.

        One restorer serves one lexicon.
        """
        lower = text.lower()
        found: set[str] = set()
        kept = self.kept
        for token in set(lower.split()):
            got = kept.get(token)
            if got is None:
                got = tuple(f for w in self.word(token) for f in beginnings(w) if f in lexicon)
                if len(token) <= 40:
                    kept[token] = got
            if got:
                found.update(got)
        found.update(f for w in self.spaced(lower) for f in beginnings(w) if f in lexicon)
        if len(kept) > self.KEPT:
            self.kept = {}
        return found


_FLUSH = 150_000  # features counted in a task before they are handed on


def _feature_counts(cost):
    """(feature, n) of texts, added up as far as a bounded memory allows."""

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["feature", "n"])

    def run(batches):
        tool, counts = Restorer(cost.value), Counter()
        for b in batches:
            for text in texts(b.column(0)):
                counts.update(tool.features(text))
                if len(counts) > _FLUSH:
                    yield rows(counts)
                    counts = Counter()
        yield rows(counts)

    return run


def _known(cost, lexicon):
    def run(batches):
        tool, known = Restorer(cost.value), lexicon.value
        for b in batches:
            rows = [sorted(known[f] for f in tool.known(t, known)) for t in texts(b.column(0))]
            yield pa.record_batch([pa.array(rows, pa.list_(pa.int32())), b.column(1)], names=["found", "y"])

    return run


def regress(rows: list[list[int]], labels: np.ndarray, width: int, steps: int = 1000, rate: float = 0.5, penalty: float = 0.2) -> tuple[float, np.ndarray]:
    """Bias and non-negative weights of a logistic regression on sets of features, by proximal AdaGrad."""
    who = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    what = np.fromiter((f for r in rows for f in r), dtype=np.int64, count=len(who))
    w, seen = np.zeros(width), np.full(width, 1e-6)
    base = float(np.clip(labels.mean(), 1e-3, 0.999)) if len(labels) else 0.01
    bias, bias_seen = math.log(base / (1 - base)), 1e-6
    for _ in range(steps if len(rows) else 0):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(who, w[what], minlength=len(rows)), -30, 30)))
        slope = p - labels
        g = np.bincount(what, slope[who], minlength=width) + penalty
        seen += g * g
        w = np.maximum(0, w - rate * g / np.sqrt(seen))
        gb = float(slope.sum())
        bias_seen += gb * gb
        bias = min(-2.0, bias - rate * gb / math.sqrt(bias_seen))
    return bias, w


def alone(kept, bias: float) -> dict[str, float]:
    """Weights of features that speak for themselves.

    Words that always come together share a weight in the regression, so each gets at least what its
    own smoothed share of toxic rows says. A beginning counts only if several words have it;
    otherwise it would say of a whole family of words what is known of one.
    """
    share = {r.feature: r.n1 / (r.n + 4) for r in kept}
    rows = {r.feature: r.n1 for r in kept}
    most: dict[str, int] = {}
    for word, n in rows.items():
        if not word.endswith("~"):
            for f in beginnings(word)[1:]:
                most[f] = max(most.get(f, 0), n)
    return {f: math.log(q / (1 - q)) - bias for f, q in share.items() if q >= SURE and (f not in most or rows[f] >= 1.3 * most[f])}


class Evidence(NamedTuple):
    """A feature, its toxic rows and all its rows in the sample."""

    feature: str
    n1: int
    n: int


class Model:
    """What scoring needs: character costs, bias, and weights by feature."""

    def __init__(self, cost: np.ndarray, bias: float, weights: dict[str, float]):
        self.cost, self.bias, self.weights = cost, bias, weights


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Fit on the labelled rows; labels is (id, label), one row an id or more (the largest label counts)."""
    spark = docs.sparkSession
    cost = char_model(docs, text_col)
    shared = spark.sparkContext.broadcast(cost)
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).alias("__y"))
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id").limit(sample)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(chosen), "__id")
    # an id that many documents have gives one text, so the rows are as bounded as the labels
    rows = rows.groupBy("__id", "__y").agg(F.min(F.struct(F.xxhash64("__text").alias("h"), "__text")).alias("t"))
    rows = cut(rows.select(F.col("t.__text").alias("text"), F.col("__y").cast("int").alias("y")))
    seen_bad = map_batches(rows.where("y > 0").select("text"), _feature_counts(shared), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n1")).where(F.col("n1") >= MIN_ROWS)
    # as many as the bounded sample has: each needs MIN_ROWS of its rows
    likely = {r.feature: r.n1 for r in seen_bad.collect()}
    places = {f: i for i, f in enumerate(sorted(likely))}
    lexicon = spark.sparkContext.broadcast(places)
    among = map_batches(rows, _known(shared, lexicon), "found array<int>, y int")
    counts = {r.f: r.n for r in among.select(F.explode("found").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n")).collect()}
    kept = [Evidence(f, likely[f], counts[i]) for f, i in places.items() if likely[f] >= MIN_SHARE * counts.get(i, math.inf)]
    names = sorted(r.feature for r in kept)
    lexicon = spark.sparkContext.broadcast({f: i for i, f in enumerate(names)})
    seen = map_batches(rows, _known(shared, lexicon), "found array<int>, y int").groupBy("found", "y").count().collect()
    sets = [r.found for r in seen for _ in range(r["count"])]
    bias, w = regress(sets, np.array([r.y for r in seen for _ in range(r["count"])], dtype=float), len(names))
    weights = {f: float(x) for f, x in zip(names, w, strict=True)}
    for f, x in alone(kept, bias).items():
        weights[f] = max(weights[f], x)
    return Model(cost, bias, {f: x for f, x in weights.items() if x > 1e-3})


def _scores(model: tuple, lines: list[str], tool: Restorer) -> list[float]:
    _, bias, weights = model
    out = []
    for t in lines:
        z = bias + sum(weights[f] for f in sorted(tool.known(t, weights)))
        out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
    return out


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1). Null and empty texts have the score of no evidence."""
    shared = docs.sparkSession.sparkContext.broadcast((model.cost, model.bias, model.weights))

    def run(batches):
        tool = Restorer(shared.value[0])
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(_scores(shared.value, texts(b.column(1)), tool), pa.float64())], names=["id", "score"])

    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {docs.schema[id_col].dataType.simpleString()}, score double")


def clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns as they are, whose score is under the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast((model.cost, model.bias, model.weights))
    at = docs.columns.index(text_col)

    def run(batches):
        tool = Restorer(shared.value[0])
        for b in batches:
            yield b.filter(pa.array([x < threshold for x in _scores(shared.value, texts(b.column(at)), tool)], pa.bool_()))

    return map_batches(docs, run, docs.schema)


def held_out(id_col: str, modulus: int, remainder: int):
    """Whether the CRC-32 of an id as text has this remainder; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def scored(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per document: id, held_out, score, predicted.

    Labels of held-out ids are never read. Repeated rows stay and score alike, an empty table gives no
    rows, other columns are ignored; null and empty texts and, without labels, all texts have the score
    of no evidence; a score of the threshold counts as 1.
    """
    model = train(docs, labels.where(~held_out(id_col, 4, 2)), label_col, id_col, text_col)
    out = score(docs, model, id_col, text_col)
    return out.select(F.col("id").alias(id_col), held_out("id", 4, 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
