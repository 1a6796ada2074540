"""INSERT, UPDATE and DELETE as new snapshots, snapshot tables on storage, and schedules of transactions."""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lumenquery.session import Scratch, ship


class KeyConflict(ValueError):
    """A primary key would repeat."""


class WriteConflict(RuntimeError):
    """Another writer committed a version that this one doesn't know."""


def insert(df: DataFrame, rows: list[tuple], key: str) -> DataFrame:
    """df with rows in column order; a key that is there already, or twice among them, is an error."""
    new = df.sparkSession.createDataFrame(rows, df.schema)
    place = df.columns.index(key)
    keys = [r[place] for r in rows]
    if len(set(keys)) < len(keys) or df.where(F.col(key).isin(keys)).limit(1).count():
        raise KeyConflict(f"{key} repeats")
    return df.unionByName(new)


def update(df: DataFrame, values: dict[str, object], where: Column | None, key: str) -> DataFrame:
    """df with literal values where a predicate holds; the key can't be assigned."""
    if key in values:
        raise ValueError("the primary key can't be assigned")
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    return df.select(*[F.when(hit, F.lit(values[c]).cast(t)).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c, t in df.dtypes])


def delete(df: DataFrame, where: Column | None) -> DataFrame:
    return df.where(F.lit(False)) if where is None else df.where(~F.coalesce(where, F.lit(False)))


class SnapshotTable:
    """A table whose versions are Parquet folders under one path; the last committed one is current.

    A version is written in full before its pointer file appears, so readers see all of a version or
    none of it, and rolling back is not committing. Pointer files are written through Spark, so any
    file system works.
    """

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.pending: str | None = None
        self.based: str | None = None

    def _pointers(self):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_log")
        fs = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(hadoop):
            return []
        # a folder without its mark is still being written
        done = lambda s: fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
        return sorted(s.getPath().toString() for s in fs.listStatus(hadoop) if done(s))

    def version(self) -> str | None:
        found = self._pointers()
        return json.loads(self.spark.read.text(found[-1]).first()[0])["folder"] if found else None

    def read(self) -> DataFrame:
        folder = self.pending or self.version()
        if folder is None:
            raise ValueError("the table has no version")
        return self.spark.read.parquet(f"{self.path}/{folder}")

    def stage(self, df: DataFrame, sort: bool = False) -> None:
        """Write a version that nobody sees yet; sorted by key if asked, so that key filters skip files."""
        folder = f"v-{uuid.uuid4().hex}"
        out = df.repartitionByRange(self.key).sortWithinPartitions(self.key) if sort else df
        self.based = self.based if self.pending else self.version()
        out.write.parquet(f"{self.path}/{folder}")
        self.pending = folder

    def commit(self) -> None:
        """Make the staged version current; a version that another writer committed meanwhile is an error."""
        if self.pending:
            if self.version() != self.based:
                self.pending = None
                raise WriteConflict("another writer committed a version meanwhile")
            name = f"{self.path}/_log/{time.time_ns():020d}"
            self.spark.createDataFrame([(json.dumps({"folder": self.pending}),)], "value string").coalesce(1).write.text(name)
            self.pending = None

    def rollback(self) -> None:
        self.pending = None

    def reorganise(self) -> None:
        """Rewrite the current version in key order."""
        self.stage(self.read(), sort=True)
        self.commit()


# ---- schedules


CELL_ROWS = 1 << 20  # accesses of one side of a cell
TILE = 8192  # transactions whose bits are held at once, on either side of a cell


def _accesses(history: DataFrame) -> DataFrame:
    """history without the rows that no pair can hold, and whether each writes: any mode but S conflicts with X."""
    return history.where("xact IS NOT NULL AND resource IS NOT NULL AND ts IS NOT NULL").select("xact", "resource", "ts", F.coalesce(F.col("mode") != "S", F.lit(False)).alias("writes"))


def _codes(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """Columns of one type as integers in their common order, nulls as -1."""
    known = [c.is_valid().to_numpy() for c in columns]
    found = np.unique(np.concatenate([c.drop_null().to_numpy() for c in columns]), return_inverse=True)[1].astype(np.int64)
    out = []
    for k in known:
        code = np.full(len(k), -1, dtype=np.int64)
        code[k], found = found[: k.sum()], found[k.sum() :]
        out.append(code)
    return out


def _mark(bits: np.ndarray, rows: np.ndarray, first: np.ndarray, columns: np.ndarray, last: np.ndarray) -> None:
    """Set bits (row, column) wherever first < last; a resource's accesses, -1 for none.

    Columns by falling time and the union of the bits of each number of them: a row takes one union,
    so the work is accesses times the width of a tile, not pairs of accesses.
    """
    rows, first, columns, last = rows[first >= 0], first[first >= 0], columns[last >= 0], last[last >= 0]
    if not len(rows) or not len(columns):
        return
    order = np.argsort(-last, kind="stable")
    columns, last = columns[order], last[order]
    unions = np.zeros((len(columns) + 1, bits.shape[1]), dtype=np.uint64)
    unions[np.arange(1, len(columns) + 1), columns // 64] = np.uint64(1) << (columns % 64).astype(np.uint64)
    np.bitwise_or.accumulate(unions, axis=0, out=unions)
    bits[rows] |= unions[len(last) - np.searchsorted(last[::-1], first, side="right")]


def _cell_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(before, after) of the accesses of one cell, each pair once."""
    t = pa.Table.from_batches(list(batches))
    names = t.column("xact").combine_chunks().dictionary_encode()
    who, kinds = names.indices.to_numpy().astype(np.int64), names.dictionary
    what = t.column("resource").combine_chunks().dictionary_encode().indices.to_numpy()
    written, touched = _codes(t.column("written"), t.column("touched"))
    later = t.column("later").to_numpy()
    del t
    sides = []
    for side in (False, True):
        own = np.flatnonzero(later == side)
        xacts, at = np.unique(who[own], return_inverse=True)
        own = own[np.lexsort((what[own], at // TILE))]
        at = np.searchsorted(xacts, who[own])
        sides.append((xacts, at, what[own], written[own], touched[own], np.searchsorted(at // TILE, np.arange(len(xacts) // TILE + 2))))
    (ax, a_at, a_what, a_written, a_touched, a_cuts), (bx, b_at, b_what, b_written, b_touched, b_cuts) = sides
    for i in range(len(a_cuts) - 1):
        for j in range(len(b_cuts) - 1):
            a, b = slice(a_cuts[i], a_cuts[i + 1]), slice(b_cuts[j], b_cuts[j + 1])
            bits = np.zeros((len(ax[i * TILE : (i + 1) * TILE]), -(-len(bx[j * TILE : (j + 1) * TILE]) // 64)), dtype=np.uint64)
            if not bits.size:
                continue
            both = np.intersect1d(a_what[a], b_what[b])
            edges = [np.searchsorted(w[s], both, side=x) + s.start for w, s in ((a_what, a), (b_what, b)) for x in ("left", "right")]
            for a0, a1, b0, b1 in zip(*[e.tolist() for e in edges], strict=True):
                rows, columns = a_at[a0:a1] - i * TILE, b_at[b0:b1] - j * TILE
                _mark(bits, rows, a_written[a0:a1], columns, b_touched[b0:b1])
                _mark(bits, rows, a_touched[a0:a1], columns, b_written[b0:b1])
            for r in range(0, len(bits), 64):
                flat = np.unpackbits(bits[r : r + 64].view(np.uint8), axis=1, bitorder="little")
                x, y = np.nonzero(flat)
                x, y = ax[x + r + i * TILE], bx[y + j * TILE]
                x, y = x[x != y], y[x != y]
                for k in range(0, len(x), 1 << 16):
                    yield pa.record_batch([kinds.take(pa.array(v[k : k + (1 << 16)])) for v in (x, y)], names=["before", "after"])


def precedence(history: DataFrame) -> DataFrame:
    """(before, after): transactions whose accesses to a resource conflict, in order of time.

    history is (xact, resource, mode, ts) with modes S and X; two S never conflict. Only the first
    and last access and the first and last write of each transaction and resource matter. They are
    dealt to cells, one for each block of earlier and block of later transactions, and a cell marks
    its pairs as bits: a pair is made once, however many resources tell it, and none is shuffled.
    """
    ship(history.sparkSession)
    scratch = Scratch(history.sparkSession)
    wrote = F.when(F.col("writes"), F.col("ts"))
    ends = _accesses(history).groupBy("xact", "resource").agg(F.min(wrote).alias("w0"), F.min("ts").alias("t0"), F.max(wrote).alias("w1"), F.max("ts").alias("t1"))
    ends = scratch.store(ends)
    blocks = max(math.ceil(math.sqrt(history.sparkSession.sparkContext.defaultParallelism)), -(-ends.count() // CELL_ROWS))
    own = F.pmod(F.xxhash64("xact"), F.lit(blocks)).cast("int")
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    first = ends.select(F.explode(F.transform(every, lambda x: own * blocks + x)).alias("cell"), F.lit(False).alias("later"), "xact", "resource", F.col("w0").alias("written"), F.col("t0").alias("touched"))
    last = ends.select(F.explode(F.transform(every, lambda x: x * blocks + own)).alias("cell"), F.lit(True).alias("later"), "xact", "resource", F.col("w1").alias("written"), F.col("t1").alias("touched"))
    kind = ends.schema["xact"].dataType.simpleString()
    return first.unionByName(last).groupBy("cell").applyInArrow(_cell_pairs, f"before {kind}, after {kind}")


def _direct(history: DataFrame, scratch: Scratch) -> DataFrame:
    """(before, after): precedences that reach what all of `precedence` reach, about two an access.

    Every access follows the writes that came last before it, and every write also the reads since
    then; what lies further back is reached through those writes. Accesses of one time do not precede
    each other.
    """
    times = _accesses(history).groupBy("resource", "ts").agg(F.collect_set(F.when(F.col("writes"), F.col("xact"))).alias("writers"), F.collect_set(F.when(~F.col("writes"), F.col("xact"))).alias("readers"))
    order = Window.partitionBy("resource").orderBy("ts")
    wrote = F.when(F.size("writers") > 0, F.col("ts"))
    times = times.withColumn("since", F.max(wrote).over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("now", F.max(wrote).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    times = scratch.store(times)
    side = lambda who, when, name: times.select("resource", F.col(when).alias("at"), F.explode(who).alias(name))
    everyone = F.array_union("writers", "readers")
    written = side(F.col("writers"), "ts", "before").join(side(everyone, "since", "after"), ["resource", "at"])
    r, w = side(F.col("readers"), "now", "before"), side(F.col("writers"), "since", "after")
    read = r.join(w, (r["resource"] == w["resource"]) & r["at"].eqNullSafe(w["at"]))
    return written.select("before", "after").unionByName(read.select("before", "after")).where("before <> after").distinct()


LOCAL_EDGES = 1 << 21  # precedences that the driver sorts itself, as numbers


def _cyclic(edges: pa.Table) -> bool:
    """Whether a graph of (before, after) rows has a cycle."""
    a, b = (edges.column(c).combine_chunks() for c in ("before", "after"))
    ids = pa.concat_arrays([a, b]).dictionary_encode().indices.to_numpy()
    a, b, n = ids[: len(a)], ids[len(a) :], int(ids.max(initial=-1)) + 1
    order = np.argsort(a, kind="stable")
    ahead, cuts, waiting = b[order], np.searchsorted(a[order], np.arange(n + 1)), np.bincount(b, minlength=n)
    ready, done = np.flatnonzero(waiting == 0).tolist(), 0
    while ready:
        x = ready.pop()
        done += 1
        for y in ahead[cuts[x] : cuts[x + 1]].tolist():
            waiting[y] -= 1
            if not waiting[y]:
                ready.append(y)
    return done < n


def serializable(history: DataFrame) -> bool:
    """Whether the precedences of a history have no cycle.

    Works on about two precedences an access, not on all. Two transactions before each other are a
    cycle at once. Else transactions that nothing precedes, or that precede nothing, are taken off
    until none is left, or none can be; the driver sees no more than LOCAL_EDGES of what remains.
    """
    scratch = Scratch(history.sparkSession)
    try:
        edges = scratch.store(_direct(history, scratch))
        pair = edges.groupBy(F.least("before", "after").alias("a"), F.greatest("before", "after").alias("b")).agg(F.count(F.lit(1)).alias("n"))
        if pair.where("n > 1").limit(1).count():
            return False
        n = edges.count()
        while n > LOCAL_EDGES:
            led = edges.join(edges.select(F.col("after").alias("before")).distinct(), "before", "left_semi")
            kept = scratch.store(led.join(led.select(F.col("before").alias("after")).distinct(), "after", "left_semi").select("before", "after"))
            scratch.free(edges)
            edges, before, n = kept, n, kept.count()
            if n == before:
                return False
        return not _cyclic(edges.toArrow())
    finally:
        scratch.close()


def serial_order(edges: DataFrame) -> list | None:
    """A serial order of the transactions, or None if the graph has a cycle.

    The order and the edges are held on the driver; `serializable` only tells whether there is one.
    """
    rows = [(r.before, r.after) for r in edges.collect()]
    nodes = sorted({x for e in rows for x in e}, key=str)
    ahead: dict = {n: set() for n in nodes}
    waiting = dict.fromkeys(nodes, 0)
    for a, b in rows:
        if b not in ahead[a]:
            ahead[a].add(b)
            waiting[b] += 1
    ready, order = [n for n in nodes if not waiting[n]], []
    while ready:
        n = ready.pop(0)
        order.append(n)
        for m in sorted(ahead[n], key=str):
            waiting[m] -= 1
            if not waiting[m]:
                ready.append(m)
    return order if len(order) == len(nodes) else None


class LockTable:
    """Shared and exclusive table locks of the driver's sessions, with upgrade and deadlock detection."""

    def __init__(self):
        self.held: dict[str, dict[object, str]] = {}
        self.waits: dict[object, set] = {}

    def acquire(self, xact, resource: str, mode: str) -> bool:
        """True if granted. False means wait; a wait that would close a cycle raises."""
        holders = self.held.setdefault(resource, {})
        others = {x for x, m in holders.items() if x != xact and (mode == "X" or m == "X")}
        if not others:
            holders[xact] = "X" if mode == "X" or holders.get(xact) == "X" else "S"
            self.waits.pop(xact, None)
            return True
        self.waits[xact] = others
        if self._reaches(others, xact):
            self.waits.pop(xact)
            raise RuntimeError("deadlock")
        return False

    def _reaches(self, start: set, goal) -> bool:
        seen, todo = set(), list(start)
        while todo:
            x = todo.pop()
            if x == goal:
                return True
            if x not in seen:
                seen.add(x)
                todo += self.waits.get(x, ())
        return False

    def release(self, xact) -> None:
        for holders in self.held.values():
            holders.pop(xact, None)
        self.waits.pop(xact, None)
