"""Vector search and bag-of-features queries over embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenquery.operators import features as B, vector_search as S
from lumenquery.plans.registry import query
from lumenquery.session import table

_E = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_SQL_DISTANCE = {"cosine": "greatest(0, least(2, 1 - list_cosine_similarity(e.v, q.v)))", "euclidean": "list_distance(e.v, q.v)", "dot": "-list_inner_product(e.v, q.v)"}
_SQL_SCORE = {"cosine": "1 - d", "euclidean": "1 / (1 + d)", "dot": "-d"}


def _one(metric: str, where: str = "true") -> str:
    return f"""WITH {_E}, q AS (SELECT v FROM e WHERE vec_id = 7), d AS (SELECT e.vec_id, {_SQL_DISTANCE[metric]} AS d FROM e, q WHERE {where})
        SELECT vec_id, round(d, 9) AS distance, round({_SQL_SCORE[metric]}, 9) AS score FROM d ORDER BY d, vec_id LIMIT 10"""


def _vector(spark: SparkSession, sf_dir: str, vec_id: int = 7) -> list[float]:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0]


def _nearest(spark: SparkSession, sf_dir: str, metric: str, where=None) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    found = S.nearest(e, "embedding", _vector(spark, sf_dir), 10, "vec_id", metric, where)
    return found.select("vec_id", F.round("distance", 9).alias("distance"), F.round("score", 9).alias("score"))


@query("knn_cosine", _one("cosine"))
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, "cosine")


@query("knn_euclidean", _one("euclidean"))
def knn_euclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, "euclidean")


@query("knn_dot", _one("dot"))
def knn_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, "dot")


@query("knn_filtered", _one("cosine", "label IN (1, 3) AND vec_id > 20"))
def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, "cosine", F.col("label").isin(1, 3) & (F.col("vec_id") > 20))


_BATCH = f"""{_E}, d AS (SELECT q.vec_id AS query_id, e.vec_id, {_SQL_DISTANCE['euclidean']} AS d FROM e, e q WHERE q.vec_id % 10 = 0 AND q.vec_id <> e.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), vec_id) AS place FROM d)"""


@query("knn_batch", f"WITH {_BATCH} SELECT query_id, vec_id, round(d, 9) AS distance, CAST(place AS INT) AS place FROM r WHERE place <= 5")
def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return S.batch_nearest(e, e.where("vec_id % 10 = 0"), 5, metric="euclidean", exclude_self=True).withColumn("distance", F.round("distance", 9))


@query("knn_label_agreement", f"""WITH {_BATCH} SELECT own.label, round(avg(CASE WHEN own.label = other.label THEN 1.0 ELSE 0.0 END), 9) AS precision FROM r JOIN e own ON own.vec_id = query_id JOIN e other ON other.vec_id = r.vec_id
    WHERE place <= 10 GROUP BY own.label""")  # fmt: skip
def knn_label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    near = S.batch_nearest(e, e.where("vec_id % 10 = 0"), 10, metric="euclidean", exclude_self=True)
    return S.label_agreement(near, e).groupBy("label").agg(F.round(F.avg("precision"), 9).alias("precision"))


@query("knn_ivf")
def knn_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells come from k-means, which SQL has no form for; tests measure recall."""
    index = S.Ivf(table(spark, sf_dir, "embeddings"), iterations=4)
    return index.search(_vector(spark, sf_dir), 10, probes=12).select("vec_id", "distance", "score")


@query("kmeans_sizes")
def kmeans_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return B.assign(e, "embedding", B.kmeans(e, "vec_id", "embedding", 8, iterations=6), "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


_WORDS = f"""{_E}, c AS (SELECT vec_id AS word, v FROM e WHERE vec_id < 16), w AS (SELECT e.vec_id, e.label, arg_min(c.word, (round(list_distance(e.v, c.v), 9), c.word)) AS word FROM e, c GROUP BY ALL),
    h AS (SELECT label, word, count(*) AS n FROM w GROUP BY ALL)"""


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    import numpy as np

    e = table(spark, sf_dir, "embeddings")
    centroids = np.array([r[0] for r in e.where("vec_id < 16").orderBy("vec_id").select("embedding").collect()], dtype=float)
    return B.histogram(B.assign(e, "embedding", centroids, "word"), "label", "word")


@query("bag_histogram", f"WITH {_WORDS} SELECT label, CAST(word AS INT) AS word, n FROM h")
def bag_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir)


@query("bag_weights", f"""WITH {_WORDS}, df AS (SELECT word, count(*) AS df FROM h GROUP BY word), t AS (SELECT label, sum(n) AS total FROM h GROUP BY label)
    SELECT label, CAST(word AS INT) AS word, round(n / total * log10((SELECT count(DISTINCT label) FROM h) / df::DOUBLE), 9) AS weight FROM h JOIN df USING (word) JOIN t USING (label)""")  # fmt: skip
def bag_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.word_weights(_words(spark, sf_dir), "label", "word").withColumn("weight", F.round("weight", 9))


@query("component_scaling", f"""WITH {_E}, p AS (SELECT unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos FROM e) SELECT CAST(pos AS INT) AS pos, round(avg(x), 9) AS mean, round(CASE WHEN stddev_pop(x) < 1e-8 THEN 1 ELSE stddev_pop(x) END, 9) AS deviation FROM p GROUP BY pos""")
def component_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.component_stats(table(spark, sf_dir, "embeddings"), "embedding").select("pos", F.round("mean", 9).alias("mean"), F.round("deviation", 9).alias("deviation"))


@query("label_chance", "SELECT sum(p * p) AS chance FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM embeddings GROUP BY label)")
def label_chance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1).select(F.lit(B.chance(table(spark, sf_dir, "embeddings"), "label")).alias("chance"))


@query("stratified_sample_sizes", "SELECT label, least(count(*), 12) AS n FROM embeddings GROUP BY label")
def stratified_sample_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.stratified_sample(table(spark, sf_dir, "embeddings"), "label", "vec_id", 12).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("feature_changes", """WITH s AS (SELECT doc_id, md5(text) AS d FROM documents WHERE doc_id % 7 <> 3), m AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE md5(text) END AS d, CASE WHEN doc_id % 11 = 0 THEN 'error' ELSE 'ok' END AS st FROM documents WHERE doc_id % 9 <> 4)
    SELECT coalesce(s.doc_id, m.doc_id) AS doc_id, CASE WHEN s.d IS NULL THEN 'deleted' WHEN m.d IS NULL THEN 'new' WHEN s.d <> m.d THEN 'changed' WHEN st = 'error' THEN 'error' ELSE 'unchanged' END AS change FROM s FULL JOIN m ON s.doc_id = m.doc_id""")  # fmt: skip
def feature_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    source = docs.where("doc_id % 7 <> 3").select("doc_id", F.md5("text").alias("digest"))
    manifest = docs.where("doc_id % 9 <> 4").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "x").otherwise(F.md5("text")).alias("digest"), F.when(F.col("doc_id") % 11 == 0, "error").otherwise("ok").alias("state"))
    return B.changes(source, manifest, "doc_id")
