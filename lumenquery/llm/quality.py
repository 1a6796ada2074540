"""Quality scores by a byte-level convolutional network in numpy.

A text's UTF-8 bytes are covered by chunks of `CHUNK` bytes that overlap by half. Learned filters of
`WIDTH` bytes slide over every byte; a chunk's features are the filters' largest responses. A
document's features are the largest and the mean of its chunks' features, combined by one logistic
unit. Filters and unit are trained together by back-propagation on a bounded, class-balanced sample
of labelled rows: tasks train on their shares of it, and after each round their networks are
averaged.
"""

from __future__ import annotations

import copy
import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lumenquery.llm.frames import map_batches, texts
from lumenquery.session import Scratch

WIDTH = 6  # bytes a filter sees
FILTERS = 16
CHUNK = 512  # bytes of a chunk; chunks start every half chunk
SAMPLE_ROWS = 2_000  # labelled rows of each class that training sees at most
SAMPLE_BYTES = 8_000_000  # and their bytes, of each class; whole texts only
_HALF = CHUNK // 2
_BLOCK = 1 << 15


def _padded(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in one buffer, each document on a whole number of half chunks, and its first half chunk."""
    sizes = np.array([max(1, -(-(len(d) + WIDTH) // _HALF)) for d in docs], dtype=np.int64)
    first = np.concatenate(([0], np.cumsum(sizes)))
    buf = np.zeros(first[-1] * _HALF + 64, dtype=np.uint8)
    for d, at in zip(docs, first[:-1].tolist(), strict=True):
        buf[at * _HALF : at * _HALF + len(d)] = np.frombuffer(d, dtype=np.uint8)
    return buf, first


class Network:
    """Filter tables [WIDTH, 256, FILTERS], and the unit's weights for maxima and means."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.tables = rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.top = rng.normal(0, 0.3, FILTERS)
        self.mean = rng.normal(0, 0.3, FILTERS)
        self.bias = 0.0

    def halves(self, buf: np.ndarray, count: int, where: bool = False):
        """Largest response of every filter in every half chunk, and where it is if asked."""
        best = np.empty((count, FILTERS), dtype=np.float32)
        spot = np.empty((count, FILTERS), dtype=np.int64) if where else None
        step = max(1, _BLOCK // _HALF)
        for at in range(0, count, step):
            m = min(step, count - at)
            lo = at * _HALF
            y = self.tables[0][buf[lo : lo + m * _HALF]]
            for o in range(1, WIDTH):
                y += self.tables[o][buf[lo + o : lo + o + m * _HALF]]
            y = y.reshape(m, _HALF, FILTERS)
            if where:
                a = y.argmax(axis=1)
                spot[at : at + m] = a + (np.arange(at, at + m) * _HALF)[:, None]
                best[at : at + m] = np.take_along_axis(y, a[:, None, :], axis=1)[:, 0]
            else:
                best[at : at + m] = y.max(axis=1)
        return best, spot

    def forward(self, docs: list[bytes], where: bool = False):
        buf, first = _padded(docs)
        count = int(first[-1])
        sizes = np.diff(first)
        best, spot = self.halves(buf, count, where)
        half = np.maximum(best, 0).astype(np.float64)
        # a chunk is a half and the next one of the same document
        last = np.zeros(count, dtype=bool)
        last[first[1:] - 1] = True
        nxt = np.where(last, np.arange(count), np.minimum(np.arange(count) + 1, count - 1))
        chunk = np.maximum(half, half[nxt])
        start = first[:-1]
        top = np.maximum.reduceat(chunk, start, axis=0)
        mean = np.add.reduceat(chunk, start, axis=0) / sizes[:, None]
        z = top @ self.top + mean @ self.mean + self.bias
        return z, (buf, first, sizes, half, nxt, chunk, top, mean, spot)


def gradients(net: Network, docs: list[bytes], labels: np.ndarray) -> list[np.ndarray]:
    """Of the mean log loss, for tables, top, mean and bias; they flow to the bytes where each filter's maximum was."""
    z, (buf, first, sizes, half, nxt, chunk, top, mean, spot) = net.forward(docs, where=True)
    slope = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / len(docs)
    owner = np.repeat(np.arange(len(docs)), sizes)
    # into chunks: the mean to all of them, the maximum to those that have it alike
    is_top = chunk == top[owner]
    share = np.maximum(1, np.add.reduceat(is_top, first[:-1], axis=0))
    to_chunk = (slope / sizes)[owner][:, None] * net.mean[None] + is_top * (slope[:, None] * net.top[None] / share)[owner]
    # into halves: to the larger of the two
    mine = half >= half[nxt]
    to_half = np.where(mine, to_chunk, 0)
    np.add.at(to_half, nxt, np.where(mine, 0, to_chunk))
    row, col = np.nonzero(np.where(half > 0, to_half, 0))
    size = 256 * FILTERS
    tables = [np.bincount(buf[spot[row, col] + o].astype(np.int64) * FILTERS + col, to_half[row, col], size).reshape(256, FILTERS) for o in range(WIDTH)]
    return [np.stack(tables), slope @ top, slope @ mean, np.array([slope.sum()])]


def train_network(docs: list[bytes], labels: np.ndarray, epochs: int = 16, batch: int = 64, rate: float = 0.01, seed: int = 7, start: Network | None = None) -> Network:
    """Adam on the log loss, from a network or a random one."""
    net, rng = copy.deepcopy(start) if start else Network(seed), np.random.default_rng(seed)
    params = [net.tables, net.top, net.mean, np.array([net.bias])]
    m1, m2 = [np.zeros(p.shape) for p in params], [np.zeros(p.shape) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            grads = gradients(net, [docs[i] for i in pick], labels[pick])
            step += 1
            for p, g, a, b, speed in zip(params, grads, m1, m2, (1, 4, 4, 4), strict=True):
                a *= 0.9
                a += 0.1 * g
                b *= 0.999
                b += 0.001 * g * g
                p -= (speed * rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(p.dtype)
            net.bias = float(params[3][0])
    return net


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


SHARES, ROUNDS, EPOCHS = 4, 8, 2  # tasks that train at once, rounds of averaging, and epochs of a task in a round


def averaged(networks: list[Network]) -> Network:
    out = Network()
    out.tables = np.mean([n.tables for n in networks], axis=0).astype(np.float32)
    out.top, out.mean = (np.mean([getattr(n, k) for n in networks], axis=0) for k in ("top", "mean"))
    out.bias = float(np.mean([n.bias for n in networks]))
    return out


def _epochs(net: Network, seed: int):
    """A task's share of a round: the network after a few epochs over the share's rows."""

    def run(t: pa.Table) -> pa.Table:
        rows = sorted(zip(t["__y"].to_pylist(), t["__id"].to_pylist(), t["__text"].to_pylist(), strict=True), key=lambda r: r[:2])
        got = train_network([_bytes(r[2]) for r in rows], np.array([float(r[0]) for r in rows]), EPOCHS, batch=32, seed=seed, start=net)
        return pa.table([pa.array([pickle.dumps(got)], pa.binary())], names=["net"])

    return run


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> tuple[Network, float]:
    """A network fitted to both classes alike, and the log odds of the labels' own class balance.

    Rows are taken in the order of a hash of their ids, whole texts, one text an id, up to the bounds
    on rows and bytes. With fewer than two classes the network is untrained and only the balance
    speaks.
    """
    one = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__y"))
    balance = {r["__y"]: r["count"] for r in one.groupBy("__y").count().collect()}
    n1, n0 = balance.get(1, 0), balance.get(0, 0)
    prior = math.log((n1 + 1) / (n0 + 1))
    kept = None
    for y in (0, 1):
        part = one.where(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(rows)
        kept = part if kept is None else kept.unionByName(part)
    found = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(kept), "__id")
    # an id that many documents have gives one text, so both windows hold the bounded rows only
    found = found.groupBy("__id", "__y").agg(F.min(F.struct(F.xxhash64("__text").alias("h"), "__text")).alias("t")).select("__id", "__y", "t.__text")
    order = Window.partitionBy("__y").orderBy(F.xxhash64("__id"), "__id")
    so_far = F.sum(F.coalesce(F.octet_length("__text"), F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    sample = found.withColumn("__sum", so_far).withColumn("__nth", F.row_number().over(order)).where((F.col("__sum") <= size) | (F.col("__nth") == 1))
    scratch = Scratch(docs.sparkSession)
    sample = scratch.store(sample.select("__id", "__text", "__y", F.pmod("__nth", F.lit(SHARES)).cast("int").alias("share")))
    if sample.select("__y").distinct().count() < 2:
        scratch.close()
        return Network(), prior
    net = Network()
    for n in range(ROUNDS):
        found = sample.groupBy("share").applyInArrow(_epochs(net, 7 + n), "net binary").collect()
        net = averaged([pickle.loads(r.net) for r in sorted(found)])
    scratch.close()
    return net, prior


_SLICE_BYTES = 4_000_000


def score(docs: DataFrame, model: tuple[Network, float] | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and score (0 to 1, higher: label 1 likelier). Null counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    slim = docs.select(*[F.col(c) for c in keep], F.col(text_col).alias("__text"))

    def run(batches):
        net, prior = shared.value
        for b in batches:
            out: list[float] = []
            group: list[bytes] = []
            total = 0
            for t in [*texts(b.column(len(keep))), None]:
                if t is None or total > _SLICE_BYTES:
                    if group:
                        z = np.clip(net.forward(group)[0] + prior, -30, 30)
                        out += (1 / (1 + np.exp(-z))).tolist()
                    group, total = [], 0
                if t is not None:
                    group.append(_bytes(t))
                    total += len(group[-1])
            yield pa.record_batch([b.column(i) for i in range(len(keep))] + [pa.array(out, pa.float64())], names=[*keep, "score"])

    return map_batches(slim, run, f"{kinds}, score double")


def scored(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per document: id, held_out, score, predicted.

    Labels of held-out ids are never read. Repeated rows stay and score alike, an empty table gives no
    rows, other columns are ignored; an empty or null text is one empty chunk; a score of the
    threshold counts as 1.
    """
    apart = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0
    out = score(docs, train(docs, labels.where(~apart), label_col, id_col, text_col), text_col, (id_col,))
    return out.select(id_col, apart.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
