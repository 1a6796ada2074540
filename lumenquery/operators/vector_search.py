"""Exact and partition-pruned nearest neighbours, and measures of them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lumenquery.functions import vectors as V
from lumenquery.operators.features import assign, kmeans


def nearest(df: DataFrame, vec_col: str, vector, k: int, key: str, metric: str = "cosine", where: Column | None = None) -> DataFrame:
    """The k rows nearest to one vector after a filter, with distance and score, ties by key."""
    rows = df if where is None else df.where(where)
    out = rows.withColumn("distance", V.DISTANCES[metric](F.col(vec_col), V.literal(vector)))
    return out.orderBy("distance", key).limit(k).withColumn("score", V.score(metric, F.col("distance")))


def _distances(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    if metric == "dot":
        return -(q @ x.T)
    if metric == "euclidean":
        return np.sqrt(np.maximum(0.0, (q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * (q @ x.T)))
    size = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((x * x).sum(1))[None]
    cos = np.divide(q @ x.T, size, out=np.zeros(size.shape), where=size > 0)
    return np.where(size > 0, np.clip(1 - cos, 0, 2), 1.0)


QUERY_BLOCK = 2048  # queries sent to every task at once


def batch_nearest(df: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vec_col: str = "embedding", metric: str = "cosine", exclude_self: bool = False) -> DataFrame:
    """(query_id, key, distance, place) of the k nearest rows of every query.

    Queries travel to the rows in blocks of bounded size; each Arrow batch keeps k rows a query, and
    a window takes the best of those. Rows are never paired one by one.
    """
    found = None
    places = queries.select(F.col(key).alias("q"), F.col(vec_col).alias("v")).orderBy("q")
    blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    spread = places.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)))
    for n in range(blocks):
        rows = spread.where(F.col("block") == n).orderBy("q").collect()
        if not rows:
            continue
        ids, mat = np.array([r.q for r in rows]), np.array([r.v for r in rows], dtype=float)
        shared = df.sparkSession.sparkContext.broadcast((ids, mat))

        def run(batches, shared=shared):
            qid, q = shared.value
            for b in batches:
                if not b.num_rows:
                    continue
                own = np.asarray(b.column(0))
                x = np.array(b.column(1).to_pylist(), dtype=float)
                d = _distances(metric, q, x)
                if exclude_self:
                    d = np.where(qid[:, None] == own[None], np.inf, d)
                order = np.lexsort((np.broadcast_to(own, d.shape), d), axis=1)[:, : min(k, len(own))]
                best = np.take_along_axis(d, order, axis=1)
                keep = np.isfinite(best)
                yield pa.record_batch([pa.array(np.repeat(qid, order.shape[1])[keep.ravel()]), pa.array(own[order][keep]), pa.array(best[keep])], names=["query_id", key, "distance"])

        part = df.select(key, vec_col).mapInArrow(run, f"query_id long, `{key}` long, distance double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return df.sparkSession.createDataFrame([], f"query_id long, `{key}` long, distance double, place int")
    order = Window.partitionBy("query_id").orderBy("distance", key)
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


class Ivf:
    """An inverted-file index: rows carry the cell of their nearest centroid, searches read a few cells."""

    def __init__(self, df: DataFrame, key: str = "vec_id", vec_col: str = "embedding", cells: int | None = None, iterations: int = 8, centroids: np.ndarray | None = None):
        self.key, self.vec_col = key, vec_col
        self.cells = cells or (len(centroids) if centroids is not None else max(1, math.isqrt(df.count())))
        self.centroids = kmeans(df, key, vec_col, self.cells, iterations=iterations) if centroids is None else centroids
        self.rows = df if "cell" in df.columns else assign(df, vec_col, self.centroids, "cell")

    # ---- maintenance: a changed index is a new one over the same centroids

    def _of(self, rows: DataFrame) -> Ivf:
        return Ivf(rows, self.key, self.vec_col, centroids=self.centroids)

    def insert(self, rows: DataFrame) -> Ivf:
        """With more rows, each in the cell nearest to it; a key that is there already is an error."""
        if self.rows.join(rows.select(self.key), self.key, "left_semi").limit(1).count():
            raise ValueError(f"{self.key} repeats")
        return self._of(self.rows.unionByName(assign(rows.select(*[c for c in self.rows.columns if c != "cell"]), self.vec_col, self.centroids, "cell")))

    def delete(self, keys: DataFrame) -> Ivf:
        """Without the rows of some keys."""
        return self._of(self.rows.join(keys.select(self.key).distinct(), self.key, "left_anti"))

    def synchronised(self, source: DataFrame) -> Ivf:
        """As the source is now: rows that it lost go, new ones and those whose vector changed are assigned."""
        mark = F.xxhash64(F.col(self.vec_col).cast("array<double>"))
        now, held = source.select(self.key, mark.alias("__now")), self.rows.select(self.key, mark.alias("__held"))
        same = now.join(held, self.key).where("__now = __held").select(self.key)
        kept = self.rows.join(same, self.key, "left_semi")
        fresh = source.join(same, self.key, "left_anti").select(*[c for c in self.rows.columns if c != "cell"])
        return self._of(kept.unionByName(assign(fresh, self.vec_col, self.centroids, "cell")))

    def search(self, vector, k: int, probes: int = 8, metric: str = "cosine") -> DataFrame:
        """The k nearest rows of the cells whose centroids are nearest; the cell filter prunes partitions of a stored index."""
        return nearest(self.cells_near(vector, probes), self.vec_col, vector, k, self.key, metric)

    def cells_near(self, vector, probes: int) -> DataFrame:
        """The rows of the cells whose centroids are nearest."""
        d = np.sqrt(((self.centroids - np.asarray(vector, dtype=float)) ** 2).sum(axis=1))
        return self.rows.where(F.col("cell").isin(np.lexsort((np.arange(len(d)), d))[:probes].tolist()))

    def write(self, path: str) -> None:
        """Rows by cell, and the centroids beside them."""
        self.rows.write.partitionBy("cell").parquet(f"{path}/rows")
        table = [(i, [float(x) for x in c], self.key, self.vec_col) for i, c in enumerate(self.centroids)]
        self.rows.sparkSession.createDataFrame(table, "cell int, centroid array<double>, key string, vec_col string").coalesce(1).write.parquet(f"{path}/centroids")

    @classmethod
    def read(cls, spark, path: str) -> Ivf:
        """A written index; searches read the folders of a few cells."""
        table = sorted(spark.read.parquet(f"{path}/centroids").collect(), key=lambda r: r.cell)
        return cls(spark.read.parquet(f"{path}/rows"), table[0].key, table[0].vec_col, centroids=np.array([r.centroid for r in table]))


_KEPT: dict[tuple, Ivf] = {}


def index_of(df: DataFrame, key: str, vec_col: str, cells: int | None = None) -> Ivf:
    """One index for a table's plan, built once in an application; all metrics search the same cells."""
    mark = (df.sparkSession.sparkContext.applicationId, df.semanticHash(), tuple(sorted(df.inputFiles())), key, vec_col, cells)
    if mark not in _KEPT:
        _KEPT[mark] = Ivf(df, key, vec_col, cells)
    return _KEPT[mark]


def recall(found: DataFrame, exact: DataFrame, key: str = "vec_id") -> DataFrame:
    """Mean share of each query's exact neighbours that were found."""
    hits = exact.join(found.select("query_id", key), ["query_id", key], "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    sizes = exact.groupBy("query_id").agg(F.count(F.lit(1)).alias("size"))
    return sizes.join(hits, "query_id", "left").agg(F.avg(F.coalesce("hits", F.lit(0)) / F.col("size")).alias("recall"))


def probe_sweep(index: Ivf, queries: dict[int, list], exact: DataFrame, k: int, probes: list[int], target: float, metric: str = "cosine") -> tuple[int | None, list[tuple[int, float]]]:
    """The recall of each number of probes, and the least that reaches a target."""
    seen = []
    for n in probes:
        parts = [index.search(v, k, n, metric).select(F.lit(q).cast("long").alias("query_id"), index.key) for q, v in queries.items()]
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        seen.append((n, float(recall(found, exact, index.key).first()[0])))
    return next((n for n, r in seen if r >= target), None), seen


def label_agreement(neighbours: DataFrame, labels: DataFrame, key: str = "vec_id", label: str = "label") -> DataFrame:
    """(query_id, label, precision): share of a row's neighbours that have its label."""
    own = labels.select(F.col(key).alias("query_id"), F.col(label).alias("own"))
    other = labels.select(key, F.col(label).alias("other"))
    found = neighbours.join(own, "query_id").join(other, key)
    return found.groupBy("query_id", F.col("own").alias("label")).agg(F.avg((F.col("own") == F.col("other")).cast("double")).alias("precision"))
