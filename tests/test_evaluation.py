import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenquery.functions.spatial import haversine_m
from lumenquery.operators import evaluation as V


def test_detection_quality(spark):
    rows = spark.createDataFrame([("noise", "t", True, True), ("noise", "t", True, False), ("noise", None, True, False), ("noise", None, False, False)], "kind string, want string, found boolean, good boolean")
    assert tuple(V.detection_quality(rows, "kind", "want", "found", "good").first()) == ("noise", 2, 2, 0.5, 0.5)


def test_segments_drop_the_tail(spark):
    out = V.segments(spark.createDataFrame([("a", 5.9), ("b", 1.0)], "k string, d double"), "k", "d").collect()
    assert [tuple(r) for r in out] == [("a", 0, 0.0, 2.0), ("a", 1, 2.0, 4.0)]


def test_placement_stays_in_the_disk(spark):
    df = spark.range(200).select("id", F.lit(40.0).alias("lat"), F.lit(-3.0).alias("lon"), F.lit(314.159).alias("area"))
    out = V.placed_in_disk(df, "lat", "lon", "area", "id")
    assert out.select(F.max(haversine_m(F.col("lat"), F.col("lon"), F.col("at_lat"), F.col("at_lon")))).first()[0] < 8100
    assert out.collect() == V.placed_in_disk(df.repartition(3), "lat", "lon", "area", "id").orderBy("id").collect()


def test_log_scale(spark):
    row = spark.range(1).select(V.log_scaled(F.lit(1), 1, 100), V.log_scaled(F.lit(100), 1, 100), V.log_scaled(F.lit(10), 1, 100), V.log_scaled(F.lit(7), 5, 5)).first()
    assert tuple(row) == (5, 40, 22, 5)


def test_grown(spark):
    df = spark.createDataFrame([(i, [float(i), 0.0, 1.0]) for i in range(40)], "k long, v array<double>")
    out = V.grown(df, "k", "v", 3).collect()
    assert len(out) == 120 and len({(r.k, r["copy"]) for r in out}) == 120
    assert all(r.v == [float(r.k), 0.0, 1.0] for r in out if r["copy"] == 0) and all(r.v[1] == 0 for r in out)
    assert len({tuple(r.v) for r in out}) > 100 and out == V.grown(df, "k", "v", 3).collect()
    assert V.grown(df.limit(0), "k", "v", 3).count() == 0


def test_noise_gains(spark):
    rng = np.random.default_rng(0)
    floor = rng.exponential(1.0, (16, 200))  # power of white noise
    floor[0] += 100
    rows = spark.createDataFrame([(floor.tolist(),), (np.zeros((8, 3)).tolist(),), ([],)], "p array<array<double>>")
    got = [r.g for r in rows.select(V.noise_gains(F.col("p")).alias("g")).collect()]
    mean = np.median(floor[12:]) / math.log(2)
    want = np.sqrt(np.maximum(floor - mean, 0.02 * floor) / floor)
    assert np.allclose(got[0], want) and want[0].min() > 0.9 and np.median(want[-1]) < 0.2
    assert (np.array(got[1]) == 1).all() and got[2] == []

def test_purchase(spark):
    ops = spark.createDataFrame([], "request string, user int, signature string, answer string")
    stock = spark.createDataFrame([(1, 1, 5), (2, 1, 1)], "product long, store long, stock long")
    items = [{"product": 1, "store": 1, "quantity": 3}]
    answer, ops, after = V.purchase(ops, stock, "r", 7, items)
    assert sorted(tuple(r) for r in after.collect()) == [(1, 1, 2), (2, 1, 1)]
    again, same, untouched = V.purchase(ops, after, "r", 7, items)
    assert again == answer and same is ops and untouched is after
    for user, what in ((8, items), (7, [{"product": 1, "store": 1, "quantity": 1}])):
        with pytest.raises(V.PurchaseConflict):
            V.purchase(ops, after, "r", user, what)
    with pytest.raises(V.PurchaseConflict):
        V.purchase(ops, after, "s", 7, items)


def test_contained_equals_all_pairs(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(12)] + ["the"] * 6
    some = lambda n: [rng.choice(words) for _ in range(n)]
    left, right = {i: some(rng.randrange(1, 8)) for i in range(20)}, {i: some(rng.randrange(0, 30)) for i in range(25)}
    frame = lambda rows, name: spark.createDataFrame(list(rows.items()), f"{name} int, w array<string>")
    got = {(r.p, r.t): r.share for r in V.contained(frame(left, "p"), "p", frame(right, "t"), "t", "w", 0.6).collect()}
    share = lambda a, b: len({*a} & {*b}) / len({*a})
    assert got == {(p, t): share(a, b) for p, a in left.items() for t, b in right.items() if share(a, b) >= 0.6}
