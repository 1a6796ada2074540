import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenquery.functions import vectors as V
from lumenquery.operators import features as B, vector_search as S


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.3, (80, 6)) for c in (-2, 0, 2)])
    return x, spark.createDataFrame([(i, v.tolist(), i // 80) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")


def test_distances_and_scores(spark):
    a, b, zero = V.literal([3, 4]), V.literal([4, 3]), V.literal([0, 0])
    row = spark.range(1).select(V.euclidean(a, b), V.cosine_distance(a, b), V.negative_dot(a, b), V.cosine_distance(a, zero), V.score("euclidean", F.lit(1.0))).first()
    assert np.allclose(row, [2**0.5, 0.04, -24, 1, 0.5])


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "dot"])
def test_batch_equals_brute_force(data, metric):
    x, df = data
    got = {}
    for r in S.batch_nearest(df, df.where("vec_id % 30 = 0"), 5, metric=metric, exclude_self=True).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    d = S._distances(metric, x, x)
    np.fill_diagonal(d, np.inf)
    for q, ids in got.items():
        assert np.allclose(d[q, ids], np.sort(d[q])[:5])


def test_filter_goes_before_the_limit(data):
    _, df = data
    near = S.nearest(df, "embedding", [2.0] * 6, 4, "vec_id", "euclidean", F.col("label") == 0).collect()
    assert len(near) == 4 and {r.label for r in near} == {0}


def test_ivf_recall_and_sweep(data):
    x, df = data
    index = S.Ivf(df, iterations=4)
    exact = S.batch_nearest(df, df.where("vec_id IN (3, 100, 200)"), 10, metric="euclidean")
    queries = {i: x[i].tolist() for i in (3, 100, 200)}
    chosen, seen = S.probe_sweep(index, queries, exact, 10, [1, 4, index.cells], 0.99, "euclidean")
    assert seen[-1][1] >= 0.9 and chosen is not None


def test_kmeans_finds_the_clusters(data):
    x, df = data
    c = B.kmeans(df, "vec_id", "embedding", 3)
    assert np.allclose(np.sort(c.mean(axis=1)), [-2, 0, 2], atol=0.2)
    words = B.assign(df, "embedding", c, "word")
    assert sorted(r["count"] for r in words.groupBy("word").count().collect()) == [80, 80, 80]


def test_weights_chance_and_sizes(spark):
    counts = spark.createDataFrame([("a", 0, 2), ("a", 1, 2), ("b", 1, 4)], "obj string, word int, n long")
    out = {(r.obj, r.word): r.weight for r in B.word_weights(counts, "obj", "word").collect()}
    assert abs(out["a", 0] - 0.5 * np.log10(2)) < 1e-12 and out["b", 1] == 0
    assert B.choose_size({64: 0.245, 128: 0.254, 256: 0.264, 512: 0.249}, 0.125) == 256
    assert abs(B.chance(spark.createDataFrame([(1,), (1,), (2,), (3,)], "l int"), "l") - 0.375) < 1e-12


def test_standardise(data):
    x, df = data
    out = np.array([r[0] for r in B.standardise(df, "embedding", B.component_stats(df, "embedding")).orderBy("vec_id").select("embedding").collect()])
    assert np.allclose(out.mean(axis=0), 0, atol=1e-9) and np.allclose(out.std(axis=0), 1)


def test_changes(spark):
    src = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "k string, digest string")
    man = spark.createDataFrame([("a", "1", "ok"), ("b", "x", "ok"), ("c", "3", "error"), ("z", "9", "ok")], "k string, digest string, state string")
    assert {r.k: r.change for r in B.changes(src, man, "k").collect()} == {"a": "unchanged", "b": "changed", "c": "error", "d": "new", "z": "deleted"}
    with pytest.raises(ValueError):
        B.changes(src.union(src), man, "k")


def test_samples(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 3)
    assert {r["count"] for r in B.stratified_sample(df, "g", "id", 7).groupBy("g").count().collect()} == {7}
    assert [r.id for r in B.hash_sample(df, "id", 5).collect()] == [r.id for r in B.hash_sample(df.repartition(7), "id", 5).collect()]
