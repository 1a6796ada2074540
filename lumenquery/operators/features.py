"""Bag-of-features: sampling, scaling, codebooks, histograms, weights, and change detection."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F


def stratified_sample(df: DataFrame, group: str, key: str, per_group: int, seed: int = 42) -> DataFrame:
    """At most per_group rows of every group, the first in the order of a seeded hash."""
    order = Window.partitionBy(group).orderBy(F.xxhash64(F.lit(seed), key), key)
    return df.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= per_group).drop("__place")


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows at random but reproducibly: the least hashes, one TakeOrdered."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def component_stats(df: DataFrame, vec_col: str) -> DataFrame:
    """(pos, mean, deviation) of every vector component; deviations under 1e-8 count as 1."""
    parts = df.select(F.posexplode(vec_col).alias("pos", "x"))
    dev = F.stddev_pop(F.col("x").cast("double"))
    return parts.groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.when(dev < 1e-8, 1.0).otherwise(dev).alias("deviation"))


def standardise(df: DataFrame, vec_col: str, stats: DataFrame) -> DataFrame:
    """Vectors with zero mean and unit deviation in each component."""
    rows = stats.orderBy("pos").collect()  # one row a component
    mean, dev = F.array(*[F.lit(r["mean"]) for r in rows]), F.array(*[F.lit(r["deviation"]) for r in rows])
    scaled = F.zip_with(F.zip_with(F.col(vec_col).cast("array<double>"), mean, lambda x, m: x - m), dev, lambda x, d: x / d)
    return df.withColumn(vec_col, scaled)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = ((x * x).sum(1)[:, None] + (centroids * centroids).sum(1)[None] - 2 * (x @ centroids.T)).clip(min=0)
    at = d.argmin(axis=1)
    return at, d[np.arange(len(x)), at]


def assign(df: DataFrame, vec_col: str, centroids: np.ndarray, label: str) -> DataFrame:
    """df with the number of the nearest centroid, ties to the smaller number."""
    shared = df.sparkSession.sparkContext.broadcast(np.asarray(centroids, dtype=float))

    @F.pandas_udf("int")
    def cell(v):
        if not len(v):
            return v.astype("int32")
        return v.__class__(_nearest(np.array(v.tolist(), dtype=float), shared.value)[0], index=v.index)

    return df.withColumn(label, cell(F.col(vec_col)))


def kmeans(df: DataFrame, key: str, vec_col: str, k: int, iterations: int = 20, tolerance: float = 1e-4, seed: int = 42, sample: int = 20_000) -> np.ndarray:
    """k centroids by Lloyd's steps over all rows.

    Starting points come from a k-means++ pass over a bounded hash sample; each step sums vectors
    per centroid inside the tasks, and only k sums a task leave them. Empty centroids move to the
    rows farthest from theirs; steps end when inertia falls by less than the tolerance.
    """
    rows = hash_sample(df.where(F.col(vec_col).isNotNull()), key, sample, seed).select(vec_col).collect()
    x = np.array([r[0] for r in rows], dtype=float)
    if not len(x):
        raise ValueError("no vectors to cluster")
    k = min(k, len(x))
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(x)))]
    best = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k:
        total = best.sum()
        nxt = int(rng.choice(len(x), p=best / total)) if total > 0 else int(rng.integers(len(x)))
        chosen.append(nxt)
        best = np.minimum(best, ((x - x[nxt]) ** 2).sum(axis=1))
    centroids = x[chosen]
    before = None
    for _ in range(iterations):
        shared = df.sparkSession.sparkContext.broadcast(centroids)

        def sums(batches, shared=shared):
            c = shared.value
            total, count, inertia = np.zeros(c.shape), np.zeros(len(c), dtype=np.int64), np.zeros(len(c))
            far: tuple[float, list] = (-1.0, [0.0] * c.shape[1])
            for b in batches:
                if not b.num_rows:
                    continue
                v = np.array(b.column(0).to_pylist(), dtype=float)
                at, d = _nearest(v, c)
                np.add.at(total, at, v)
                count += np.bincount(at, minlength=len(c))
                inertia += np.bincount(at, weights=d, minlength=len(c))
                i = int(d.argmax())
                far = max(far, (float(d[i]), v[i].tolist()))
            yield pa.record_batch(
                [pa.array(np.arange(len(c))), pa.array(total.tolist(), pa.list_(pa.float64())), pa.array(count), pa.array(inertia), pa.array([far[0]] * len(c)), pa.array([far[1]] * len(c), pa.list_(pa.float64()))],
                names=["c", "total", "n", "inertia", "far", "farthest"],
            )

        got = df.where(F.col(vec_col).isNotNull()).select(vec_col).mapInArrow(sums, "c long, total array<double>, n long, inertia double, far double, farthest array<double>")
        width = centroids.shape[1]
        added = got.groupBy("c").agg(*[F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(width)], F.sum("n").alias("n"), F.sum("inertia").alias("inertia"), F.max(F.struct("far", "farthest")).alias("far")).collect()
        inertia = sum(r["inertia"] for r in added)
        for r in added:
            if r["n"]:
                centroids[r["c"]] = [r[f"s{i}"] / r["n"] for i in range(width)]
        for j, r in enumerate(sorted((r for r in added if not r["n"]), key=lambda r: r["c"])):
            if j == 0 and r["far"]["far"] > 0:
                centroids[r["c"]] = r["far"]["farthest"]
        if before is not None and before - inertia <= tolerance * before:
            break
        before = inertia
    return centroids


def histogram(words: DataFrame, obj: str, word: str) -> DataFrame:
    """(obj, word, n) counts of assigned words."""
    return words.groupBy(obj, word).agg(F.count(F.lit(1)).alias("n"))


def word_weights(counts: DataFrame, obj: str, word: str) -> DataFrame:
    """(obj, word, weight): relative frequency times log10(objects / objects with the word)."""
    n = counts.select(obj).distinct().count()
    df = counts.groupBy(word).agg(F.count(F.lit(1)).alias("df"))
    total = counts.groupBy(obj).agg(F.sum("n").alias("total"))
    weight = F.col("n") / F.col("total") * F.log10(F.lit(float(n)) / F.col("df"))
    return counts.join(df, word).join(total, obj).select(obj, word, weight.alias("weight"))


def chance(labels: DataFrame, label: str) -> float:
    """Probability that two rows agree by chance: the sum of squared label shares."""
    counts = labels.groupBy(label).count()
    total = F.sum("count").over(Window.partitionBy())
    return float(counts.select((F.col("count") / total).alias("p")).agg(F.sum(F.col("p") * F.col("p"))).first()[0])


def choose_size(precisions: dict[int, float], by_chance: float, slack: float = 0.05) -> int:
    """The smallest size whose gain over chance is within a slack of the best gain."""
    best = max(precisions.values()) - by_chance
    return min(k for k, p in precisions.items() if p - by_chance >= (1 - slack) * best)


def changes(source: DataFrame, manifest: DataFrame, key: str, digest: str = "digest", state: str = "state") -> DataFrame:
    """(key, change) between a source (key, digest) and a manifest (key, digest, state 'ok' or 'error').

    unchanged, new, changed, error (the same content failed before) or deleted. Keys repeated in the
    source are an error.
    """
    if source.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError("the source repeats a key")
    s = source.select(F.col(key), F.col(digest).alias("__new"))
    m = manifest.select(F.col(key), F.col(digest).alias("__old"), F.col(state).alias("__state"))
    change = (
        F.when(F.col("__new").isNull(), "deleted").when(F.col("__old").isNull(), "new").when(F.col("__new") != F.col("__old"), "changed").when(F.col("__state") == "error", "error").otherwise("unchanged")
    )
    return s.join(m, key, "full").select(key, change.alias("change"))
