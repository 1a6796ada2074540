"""Secret scans: strict patterns, plus formats inferred as probabilistic automata.

Strings that the strict patterns found are the labelled credentials, one kind of format each. Their
prefix tree is built level by level; states of a level whose next-character frequencies (of signs
and of their classes) pass a Hoeffding test are merged as the level is made, so the tree never grows
beyond a few states a level. States of different levels are then merged where they and all that follows them are compatible,
which turns formats of free length into loops and leaves formats of fixed length as chains. Ordinary
tokens give an automaton of their own. Every token of a text that is long enough for a credential is
scored by the likelihood of each format against the ordinary one; tokens that a format explains as
well as nearly all of its own credentials, and far better than ordinary text does, are added.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from lumenquery.llm.frames import map_batches, texts

KINDS = ("assign", "access", "hex")
# the contract's patterns (fixed values)
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")

_TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
_SHORTEST = 6
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
SAMPLE = 800  # labelled credentials of a label that an automaton is fitted to at most
ORDINARY = 5_000  # other tokens that the ordinary automaton is fitted to at most
LEAST = 8  # credentials of a label that get an automaton of their own; labels with fewer share one
SPREAD = 4.0  # deviations below the median of a label's credentials down to which a token is as likely as they are
RARE = 0.02  # share of the ordinary tokens up to which what a format accepts is taken for its credentials
AHEAD = math.log(1e4)  # how much likelier than ordinary a whole token has to be: of 10 000 ordinary ones one is
ALPHA = 0.05  # risk of the Hoeffding test


def base_matches(text: str) -> list[tuple[int, int, int, str, str]]:
    """(start, kind's place, end, label, credential) of the strict matches, by start and kind.

    The label of an assignment is its keyword, otherwise the kind: one label, one format.
    """
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end(), m.group(1).lower(), m.group(2)) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), "access", m.group()) for m in _ACCESS.finditer(text) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end(), "hex", m.group()) for m in _HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans of all runs of 6 or more credential signs, without dots at their ends."""
    out = []
    for m in _TOKEN.finditer(text):
        word = m.group()
        if word[0] == "." or word[-1] == ".":
            a = m.start() + len(word) - len(word.lstrip("."))
            b = m.end() - (len(word) - len(word.rstrip(".")))
            if b - a >= _SHORTEST:
                out.append((a, b))
        else:
            out.append(m.span())
    return out


class Automaton:
    """States with next-sign counts; state 0 is the start."""

    def __init__(self):
        self.next: list[dict[str, int]] = []
        self.count: list[Counter] = []
        self.stop: list[int] = []
        self.dense: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def add(self) -> int:
        self.next.append({})
        self.count.append(Counter())
        self.stop.append(0)
        return len(self.next) - 1

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(next state, log likelihood) of each state and sign, and the log likelihood of each state's end.

        A state's counts are backed by those of their classes (digits, small and capital letters, other
        signs), the more the more kinds of signs it has seen, and any sign has a small share; an unseen
        one goes the way of its class, or of most.
        """
        if self.dense is None:
            states = len(self.next)
            to = np.zeros((states, len(ALPHABET)), dtype=np.int32)
            score = np.zeros((states, len(ALPHABET)))
            stop = np.zeros(states)
            for state in range(states):
                classes, ways = Counter(), {}
                for ch, n in self.count[state].items():
                    classes[_class(ch)] += n
                    for kind in (_class(ch), ""):
                        ways.setdefault(kind, Counter())[self.next[state][ch]] += n
                usual = {k: c.most_common(1)[0][0] for k, c in ways.items()}
                seen, kinds = sum(classes.values()) + self.stop[state], len(self.count[state]) + 1
                for i, ch in enumerate(ALPHABET):
                    kind = _class(ch)
                    backed = kinds * (classes[kind] + 0.02) / (seen + 0.1) / _CLASS_SIZE[kind]
                    score[state, i] = math.log((self.count[state][ch] + backed) / (seen + kinds))
                    to[state, i] = self.next[state].get(ch, usual.get(kind, usual.get("", state)))
                stop[state] = math.log((self.stop[state] + 0.005) / (seen + 0.5))
            self.dense = (to, score, stop)
        return self.dense

    def likelihoods(self, signs: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihood of each word, its end included, and whether a learned word ended in its last state.

        signs are the places in the alphabet of all words in a row.
        """
        to, score, stop = self.tables()
        order = np.argsort(-lengths, kind="stable")
        starts = (np.cumsum(lengths) - lengths)[order]
        sorted_lengths = lengths[order]
        state = np.zeros(len(lengths), dtype=np.int32)
        total = np.zeros(len(lengths))
        # all words take a step together, the longest ones last
        going = len(lengths)
        for at in range(int(sorted_lengths[0]) if going else 0):
            while sorted_lengths[going - 1] <= at:
                going -= 1
            sign = signs[starts[:going] + at]
            total[:going] += score[state[:going], sign]
            state[:going] = to[state[:going], sign]
        total += stop[state]
        out, ends = np.empty(len(lengths)), np.empty(len(lengths), dtype=bool)
        out[order], ends[order] = total, np.array(self.stop)[state] > 0
        return out, ends

    def likelihood(self, word: str) -> float:
        """Log likelihood a sign, the end included, over that of uniform signs."""
        return float(_a_sign(self.likelihoods(*encoded([word]))[0], np.array([len(word)]))[0])


def _a_sign(total: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return total / (lengths + 1) + math.log(len(ALPHABET))


_PLACE = np.zeros(256, dtype=np.uint8)
_PLACE[np.frombuffer(ALPHABET.encode(), dtype=np.uint8)] = np.arange(len(ALPHABET))


def encoded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places in the alphabet of all words' signs, and the words' lengths."""
    return _PLACE[np.frombuffer("".join(words).encode(), dtype=np.uint8)], np.array([len(w) for w in words], dtype=np.int64)


def _class(ch: str) -> str:
    return "9" if "0" <= ch <= "9" else "a" if "a" <= ch <= "z" else "A" if "A" <= ch <= "Z" else "+"


_CLASS_SIZE = {"9": 10, "a": 26, "A": 26, "+": 6}


def _differ(c1: int, n1: int, c2: int, n2: int, alpha: float) -> bool:
    if not n1 or not n2:
        return False
    return abs(c1 / n1 - c2 / n2) > math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))


def _alike(a: Counter, stop_a: int, b: Counter, stop_b: int, alpha: float) -> bool:
    """Whether ends, classes of signs and single signs are about as frequent after two states."""
    n, m = sum(a.values()) + stop_a, sum(b.values()) + stop_b
    if _differ(stop_a, n, stop_b, m, alpha) or any(_differ(a[ch], n, b[ch], m, alpha) for ch in {*a, *b}):
        return False
    kinds = [Counter(), Counter()]
    for kind, counts in zip(kinds, (a, b), strict=True):
        for ch, k in counts.items():
            kind[_class(ch)] += k
    return not any(_differ(kinds[0][c], n, kinds[1][c], m, alpha) for c in _CLASS_SIZE)


def infer(words: list[str], alpha: float = ALPHA) -> Automaton:
    """The automaton of labelled words, whole ones of any length."""
    made = Automaton()
    level = {made.add(): list(range(len(words)))}
    depth = 0
    while level:
        blue: dict[tuple[int, str], list[int]] = {}
        for state, members in level.items():
            for i in members:
                if len(words[i]) > depth:
                    blue.setdefault((state, words[i][depth]), []).append(i)
                else:
                    made.stop[state] += 1
        for (state, ch), members in blue.items():
            made.count[state][ch] += len(members)
        depth += 1
        level = {}
        heads: list[tuple[int, Counter, int]] = []
        for (state, ch), members in sorted(blue.items(), key=lambda x: (-len(x[1]), x[0])):
            ahead = Counter(words[i][depth] for i in members if len(words[i]) > depth)
            stop = len(members) - sum(ahead.values())
            for k, (other, seen, ends) in enumerate(heads):
                if _alike(ahead, stop, seen, ends, alpha):
                    heads[k] = (other, seen + ahead, ends + stop)
                    break
            else:
                other = made.add()
                heads.append((other, ahead, stop))
            made.next[state][ch] = other
            level.setdefault(other, []).extend(members)
    return _looped(made, alpha)


def _looped(made: Automaton, alpha: float) -> Automaton:
    """Merge states of different levels whose futures are compatible, earlier states first."""
    root = list(range(len(made.next)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def compatible(a: int, b: int) -> bool:
        todo, tried = [(a, b)], set()
        while todo:
            a, b = (find(x) for x in todo.pop())
            if a == b or (a, b) in tried:
                continue
            tried.add((a, b))
            if not _alike(made.count[a], made.stop[a], made.count[b], made.stop[b], alpha):
                return False
            todo += [(made.next[a][ch], made.next[b][ch]) for ch in {*made.next[a]} & {*made.next[b]}]
        return True

    def fold(a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            a, b = (find(x) for x in todo.pop())
            if a == b:
                continue
            root[b] = a
            made.count[a] += made.count[b]
            made.stop[a] += made.stop[b]
            for ch, to in made.next[b].items():
                if ch in made.next[a]:
                    todo.append((made.next[a][ch], to))
                else:
                    made.next[a][ch] = to

    kept = [0]
    for b in range(1, len(made.next)):
        if find(b) != b:
            continue
        for a in kept:
            if find(a) == a and compatible(a, b):
                fold(a, b)
                break
        else:
            kept.append(b)
    made.next = [{ch: find(to) for ch, to in nxt.items()} for nxt in made.next]
    return made


class Model:
    """Automata with the least likelihood a sign of their credentials, and the ordinary tokens' automaton."""

    def __init__(self, automata: list[tuple[Automaton, float]], ordinary: Automaton | None):
        self.automata, self.ordinary = automata, ordinary

    def scores(self, words: list[str]) -> np.ndarray:
        """How much likelier, in logs of the whole token, the best format is than ordinary text; -inf for no credential."""
        best = np.full(len(words), -np.inf)
        if not words or not self.automata:
            return best
        signs, lengths = encoded(words)
        plain = self.ordinary.likelihoods(signs, lengths)[0] if self.ordinary else -lengths * math.log(len(ALPHABET))
        for a, least in self.automata:
            own, ends = a.likelihoods(signs, lengths)
            good = ends & (_a_sign(own, lengths) >= least) & (own - plain >= AHEAD)
            best = np.where(good, np.maximum(best, own - plain), best)
        return best

    def credential(self, token: str) -> bool:
        return bool(np.isfinite(self.scores([token]))[0])


def fit(labelled: dict[str, list[str]], ordinary: list[str]) -> Model:
    """An automaton a label from half of its credentials; the other half sets its threshold.

    The ordinary automaton is fitted to the tokens that no format accepts; a format that accepts more
    than a few of them is no sign of a credential and removes none.

    Labels with fewer than LEAST credentials share one automaton; if they have fewer together, too,
    it is fitted to all of them and takes little beside them.
    """
    groups = {k: w for k, w in labelled.items() if len(w) >= LEAST}
    rest = sorted({w for k, words in labelled.items() if k not in groups for w in words})
    if rest:
        groups["rest"] = rest
    out = []
    for _, words in sorted(groups.items()):
        few = len(words) < LEAST
        a = infer(words if few else words[::2])
        held = np.array([a.likelihood(w) for w in (words if few else words[1::2])])
        middle = float(np.median(held))
        # by median deviations, so that a few odd credentials of a label don't open its format
        out.append((a, middle - SPREAD * max(0.02, 1.48 * float(np.median(np.abs(held - middle))))))
    if ordinary:
        signs, lengths = encoded(ordinary)
        named = np.zeros(len(ordinary), dtype=bool)
        for a, least in out:
            own, ends = a.likelihoods(signs, lengths)
            accepted = ends & (_a_sign(own, lengths) >= least)
            if accepted.mean() <= RARE:
                named |= accepted
        ordinary = [w for w, x in zip(ordinary, named.tolist(), strict=True) if not x]
    return Model(out, infer(ordinary) if ordinary else None)


def _mark(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode(), 3) >> 1


def _learn(sample: int, ordinary: int):
    """The words of least hash of every label that a task reads: a random sample of distinct words."""

    def run(batches):
        least: dict[str, list[tuple[int, str]]] = {}  # heaps of the largest mark first
        held: dict[str, set[str]] = {}

        def offer(label: str, word: str) -> None:
            heap, known = least.setdefault(label, []), held.setdefault(label, set())
            if word in known:
                return
            mark, most = _mark(word), ordinary if not label else sample
            if len(heap) < most:
                heapq.heappush(heap, (-mark, word))
            elif mark < -heap[0][0]:
                known.discard(heapq.heapreplace(heap, (-mark, word))[1])
            else:
                return
            known.add(word)

        for b in batches:
            fresh: set[str] = set()
            for text in texts(b.column(0)):
                base = base_matches(text)
                for *_, label, word in base:
                    offer(label, word)
                fresh.update(text[s:e] for s, e in _free(text, base))
            for word in fresh:
                offer("", word)
        rows = sorted((label, word, -mark) for label, heap in least.items() for mark, word in heap)
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["label", "word", "mark"])

    return run


def _free(text: str, base: list[tuple]) -> list[tuple[int, int]]:
    """Candidates that share no character with a strict match; both come in order."""
    found, at, ends = [], 0, sorted((x, y) for x, _, y, *_ in base)
    reach = 0
    for s, e in candidates(text):
        while at < len(ends) and ends[at][0] < e:
            reach = max(reach, ends[at][1])
            at += 1
        if reach <= s:
            found.append((s, e))
    return found


def train(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE, ordinary: int = ORDINARY) -> Model:
    """Fit on credentials and tokens of all documents: of each label the distinct words of least hash."""
    words = map_batches(docs.select(text_col), _learn(sample, ordinary), "label string, word string, mark long").distinct()
    place = F.row_number().over(Window.partitionBy("label").orderBy("mark", "word"))
    first = words.withColumn("nth", place).where(F.col("nth") <= max(sample, ordinary)).where((F.col("label") == "") & (F.col("nth") <= ordinary) | (F.col("label") != "") & (F.col("nth") <= sample))
    labelled: dict[str, list[str]] = {}
    for r in first.orderBy("label", "nth").collect():
        labelled.setdefault(r.label, []).append(r.word)
    other = labelled.pop("", [])
    return fit(labelled, other)


def spans_of(pages: list[str], model: Model) -> list[tuple[list, list, list[float]]]:
    """(base spans, added spans, their scores) of each text; spans are (start, kind's place, end), added ones of place 3."""
    found, words = [], {}
    for text in pages:
        base = base_matches(text)
        free = [(s, e, text[s:e]) for s, e in _free(text, base)]
        found.append((base, free))
        for *_, w in free:
            words[w] = 0.0
    for w, score in zip(words, model.scores(list(words)).tolist(), strict=True):
        words[w] = score
    return [([m[:3] for m in base], [(s, 3, e) for s, e, w in free if words[w] > -math.inf], [words[w] for *_, w in free if words[w] > -math.inf]) for base, free in found]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{(*KINDS, 'format')[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, base_sha256, spans, likelihoods.

    likelihoods has, for every added span in order, the log of how much likelier its format is than
    ordinary text. Null texts count as empty, repeated rows stay, equal tokens score alike, an empty
    table gives no rows; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            found = spans_of(texts(b.column(1)), m)
            counts = np.array([np.bincount([k for _, k, _ in base], minlength=3) for base, _, _ in found], dtype=np.int64).reshape(-1, 3)
            yield pa.record_batch(
                [
                    b.column(0), *[pa.array(counts[:, i]) for i in range(3)], pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _, _ in found], pa.string()),
                    pa.array([joined(sorted(base + added)) for base, added, _ in found], pa.string()), pa.array([",".join(f"{x:.2f}" for x in scores) for *_, scores in found], pa.string()),
                ],
                names=[id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "likelihoods"],
            )

    return map_batches(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, likelihoods string")
