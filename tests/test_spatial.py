import math
import random

import pytest
from pyspark.sql import functions as F

from lumenquery.functions import spatial as G
from lumenquery.operators import spatial as S


def test_known_distances(spark):
    row = spark.range(1).select(G.haversine_m(-12.1354, -77.0224, -12.0464, -77.0428), G.local_euclidean_m(-12.1354, -77.0224, -12.0464, -77.0428), G.haversine_m(0, 179.5, 0, -179.5), G.local_euclidean_m(0, 179.5, 0, -179.5)).first()
    assert [round(x, 3) for x in row] == [10141.868, 10141.868, 111194.927, 39918978.719] or abs(row[3] - 39918978.7) < 1
    assert abs(row[0] - 10141.8679) < 1e-3 and abs(row[2] - 111194.927) < 1e-2


def haversine(a, b, c, d):
    dx = min(abs(b - d), 360 - abs(b - d))
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(dx) / 2) ** 2
    return 2 * 6371000.0 * math.asin(math.sqrt(min(1.0, h)))


@pytest.mark.parametrize(("lat", "lon", "radius"), [(0, 0, 5e5), (60, 179.5, 8e5), (-89.5, 10, 3e5), (45, -120, 2e6), (0, 0, 2.1e7)])
def test_radius_equals_brute_force(spark, lat, lon, radius):
    rng = random.Random(1)
    pts = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(3000)] + [(9000 + i, float(lat), float(lon)) for i in range(2)]
    got = {r.i for r in S.radius(spark.createDataFrame(pts, "i int, lat double, lon double"), "lat", "lon", (lat, lon), radius).collect()}
    assert got == {i for i, a, b in pts if haversine(a, b, lat, lon) <= radius}


def test_polygon_includes_its_boundary(spark):
    square = [(0, 0), (0, 10), (10, 10), (10, 0)]
    pts = [(0.0, 0.0, True), (5.0, 0.0, True), (5.0, 5.0, True), (10.0, 10.0, True), (10.1, 5.0, False), (-1e-9, 5.0, False)]
    got = spark.createDataFrame(pts, "lat double, lon double, want boolean").withColumn("got", G.in_polygon(F.col("lat"), F.col("lon"), square)).collect()
    assert all(r.got == r.want for r in got)
    assert S.polygon(spark.createDataFrame(pts, "lat double, lon double, want boolean"), "lat", "lon", square).count() == 4
    assert spark.range(1).select(G.in_polygon(F.lit(0.0), F.lit(0.0), square[:2])).first()[0] is False


def test_distance_join_equals_brute_force(spark):
    rng = random.Random(2)
    near = [(rng.choice([-0.5, 59.9, 88.0]) + rng.uniform(-1, 1), rng.choice([179.8, -179.9, 5.0]) + rng.uniform(-0.2, 0.2)) for _ in range(150)]
    a = [(i, x, (y + 180) % 360 - 180) for i, (x, y) in enumerate(near[:75])]
    b = [(i, x, (y + 180) % 360 - 180) for i, (x, y) in enumerate(near[75:])]
    out = S.distance_join(spark.createDataFrame(a, "i int, la double, lo double"), spark.createDataFrame(b, "j int, ra double, ro double"), ("la", "lo"), ("ra", "ro"), 60000).select("i", "j").collect()
    assert sorted(map(tuple, out)) == sorted((i, j) for i, x, y in a for j, u, v in b if haversine(x, y, u, v) <= 60000)


def test_nearest_breaks_ties_by_key(spark):
    df = spark.createDataFrame([(3, 0.0, 1.0), (1, 0.0, -1.0), (2, 5.0, 5.0)], "k int, lat double, lon double")
    assert [r.k for r in S.nearest(df, "lat", "lon", (0, 0), 2, "k").collect()] == [1, 3]


def test_map_sample(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), F.col("id").cast("double").alias("lat"), (-F.col("id")).cast("double").alias("lon"))
    rows = S.map_sample(df, "k", "lat", "lon", 100).collect()
    assert sorted(r.k for r in rows) == list(range(0, 1000, 10)) and rows[0].lat_high == 999.0
    assert S.map_sample(df.limit(0), "k", "lat", "lon", 5).count() == 0


def test_map_sample_of_many_files(spark, tmp_path):
    rows = spark.range(60_000).select(F.pmod(F.col("id") * 7919, F.lit(60_000)).alias("k"))
    rows = rows.unionByName(spark.createDataFrame([(None,)], "k long"))
    rows.select("k", F.col("k").cast("double").alias("lat"), (-F.col("k")).cast("double").alias("lon")).repartition(12).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        # many partitions, which a plan that only counts them coalesces otherwise than one that carries rows
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100k")
        got = S.map_sample(df, "k", "lat", "lon", 100).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(r.k for r in got) == list(range(0, 60_000, 601)) and {r.lat_high for r in got} == {59_999.0}
