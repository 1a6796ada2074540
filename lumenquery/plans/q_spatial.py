"""Spatial operators over points derived from customer and supplier keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenquery.functions import spatial as G
from lumenquery.operators import spatial as S
from lumenquery.plans.registry import query
from lumenquery.session import table

CENTRE = (-11.6, -76.5)
POLYGON = [(-11.9, -76.95), (-11.2, -76.8), (-11.1, -76.2), (-11.7, -76.1), (-11.5, -76.5)]
_C = "customer_at AS (SELECT c_custkey, -12 + (c_custkey * 37 % 1000) / 1000.0::DOUBLE AS lat, -77 + (c_custkey * 91 % 1000) / 1000.0::DOUBLE AS lon FROM customer)"
_S = "supplier_at AS (SELECT s_suppkey, -12 + (s_suppkey * 53 % 1000) / 1000.0::DOUBLE AS slat, -77 + (s_suppkey * 17 % 1000) / 1000.0::DOUBLE AS slon FROM supplier)"


def _haversine(a: str, b: str, c: str, d: str) -> str:
    gap = f"least(abs({b} - {d}), 360 - abs({b} - {d}))"
    return f"(2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({gap}) / 2), 2)))))"


def _local(a: str, b: str, c: str, d: str) -> str:
    m = "(pi() * 6371000.0 / 180)"
    return f"sqrt(pow(({b} - {d}) * {m} * cos(radians(({a} + {c}) / 2)), 2) + pow(({a} - {c}) * {m}, 2))"


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k, (-12 + (k * 37 % 1000) / 1000.0).alias("lat"), (-77 + (k * 91 % 1000) / 1000.0).alias("lon"))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k, (-12 + (k * 53 % 1000) / 1000.0).alias("slat"), (-77 + (k * 17 % 1000) / 1000.0).alias("slon"))


@query("spatial_haversine", f"WITH {_C} SELECT c_custkey, round({_haversine('lat', 'lon', '-11.6', '-76.5')}, 3) AS d FROM customer_at")
def spatial_haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir).select("c_custkey", F.round(G.haversine_m(F.col("lat"), F.col("lon"), *CENTRE), 3).alias("d"))


@query("spatial_local_distance", f"WITH {_C} SELECT c_custkey, round({_local('lat', 'lon', '-11.6', '-76.5')}, 3) AS d FROM customer_at")
def spatial_local_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir).select("c_custkey", F.round(G.local_euclidean_m(F.col("lat"), F.col("lon"), *CENTRE), 3).alias("d"))


@query("spatial_antimeridian", f"SELECT round({_haversine('0', '179.5', '0', '-179.5')}, 3) AS d, round({_local('0', '179.5', '0', '-179.5')}, 3) AS plane")
def spatial_antimeridian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1).select(F.round(G.haversine_m(0, 179.5, 0, -179.5), 3).alias("d"), F.round(G.local_euclidean_m(0, 179.5, 0, -179.5), 3).alias("plane"))


@query("spatial_radius", f"WITH {_C} SELECT c_custkey, lat, lon FROM customer_at WHERE {_haversine('lat', 'lon', '-11.6', '-76.5')} <= 20000")
def spatial_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.radius(customers(spark, sf_dir), "lat", "lon", CENTRE, 20000).select("c_custkey", "lat", "lon")


@query("spatial_rectangle", f"WITH {_C} SELECT c_custkey, lat, lon FROM customer_at WHERE lat BETWEEN -11.75 AND -11.5 AND lon BETWEEN -76.8 AND -76.3")
def spatial_rectangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.rectangle(customers(spark, sf_dir), "lat", "lon", (-11.5, -76.8), (-11.75, -76.3))


@query("spatial_point", f"WITH {_C} SELECT c_custkey FROM customer_at WHERE lat = -12 + 370 / 1000.0::DOUBLE AND lon = -77 + 910 / 1000.0::DOUBLE")
def spatial_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir).where((F.col("lat") == -12 + 370 / 1000.0) & (F.col("lon") == -77 + 910 / 1000.0)).select("c_custkey")


def _polygon_sql() -> str:
    edges = list(zip(POLYGON, [*POLYGON[1:], POLYGON[0]], strict=True))
    on, cross = [], []
    for (ay, ax), (by, bx) in edges:
        on.append(f"(abs(({bx} - {ax}) * (lat - {ay}) - ({by} - {ay}) * (lon - {ax})) <= 1e-12 AND lon BETWEEN {min(ax, bx)} AND {max(ax, bx)} AND lat BETWEEN {min(ay, by)} AND {max(ay, by)})")
        cross.append(f"(CASE WHEN ({ay} > lat) <> ({by} > lat) AND lon < {ax}::DOUBLE + (lat - {ay}) * ({bx} - {ax}) / ({by} - {ay}) THEN 1 ELSE 0 END)")
    return f"WITH {_C} SELECT c_custkey, lat, lon FROM customer_at WHERE {' OR '.join(on)} OR ({' + '.join(cross)}) % 2 = 1"


@query("spatial_polygon", _polygon_sql())
def spatial_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.polygon(customers(spark, sf_dir), "lat", "lon", POLYGON)


@query("spatial_nearest", f"WITH {_C} SELECT c_custkey, round({_haversine('lat', 'lon', '-11.6', '-76.5')}, 3) AS d FROM customer_at WHERE c_custkey > 50 ORDER BY {_haversine('lat', 'lon', '-11.6', '-76.5')}, c_custkey LIMIT 15")
def spatial_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = S.nearest(customers(spark, sf_dir), "lat", "lon", CENTRE, 15, "c_custkey", where=F.col("c_custkey") > 50)
    return near.select("c_custkey", F.round("distance_m", 3).alias("d"))


@query("spatial_distance_join", f"WITH {_C}, {_S} SELECT c_custkey, s_suppkey, round({_haversine('lat', 'lon', 'slat', 'slon')}, 3) AS d FROM customer_at, supplier_at WHERE {_haversine('lat', 'lon', 'slat', 'slon')} <= 4000")
def spatial_distance_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = S.distance_join(customers(spark, sf_dir), suppliers(spark, sf_dir), ("lat", "lon"), ("slat", "slon"), 4000)
    return near.select("c_custkey", "s_suppkey", F.round("distance_m", 3).alias("d"))


@query("spatial_stores_with_stock", f"""WITH {_S}, stock AS (SELECT l_suppkey, sum(l_quantity) AS stock FROM lineitem WHERE l_partkey = 5 GROUP BY l_suppkey)
    SELECT s_suppkey, stock, round({_haversine('slat', 'slon', '-11.6', '-76.5')}, 3) AS d FROM supplier_at JOIN stock ON s_suppkey = l_suppkey WHERE stock > 0
    ORDER BY {_haversine('slat', 'slon', '-11.6', '-76.5')}, s_suppkey LIMIT 5""")  # fmt: skip
def spatial_stores_with_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    stock = table(spark, sf_dir, "lineitem").where(F.col("l_partkey") == 5).groupBy("l_suppkey").agg(F.sum("l_quantity").alias("stock"))
    s = suppliers(spark, sf_dir)
    near = S.nearest(s.join(stock, s.s_suppkey == stock.l_suppkey), "slat", "slon", CENTRE, 5, "s_suppkey", where=F.col("stock") > 0)
    return near.select("s_suppkey", "stock", F.round("distance_m", 3).alias("d"))


@query("spatial_map_sample", f"""WITH {_C}, r AS (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer_at)
    SELECT c_custkey, lat, lon, (SELECT min(lat) FROM customer_at) AS lat_low, (SELECT max(lat) FROM customer_at) AS lat_high, (SELECT min(lon) FROM customer_at) AS lon_low,
    (SELECT max(lon) FROM customer_at) AS lon_high FROM r WHERE i % greatest(1, CAST(ceil(n / 100.0) AS BIGINT)) = 0""")  # fmt: skip
def spatial_map_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.map_sample(customers(spark, sf_dir), "c_custkey", "lat", "lon", 100)


@query("spatial_boxes", f"""WITH {_C}, b AS (SELECT c_custkey % 20 AS g, min(lat) AS y0, min(lon) AS x0, max(lat) AS y1, max(lon) AS x1 FROM customer_at GROUP BY 1)
    SELECT g, (y1 - y0) * (x1 - x0) AS area, y0 <= -11.4 AND y1 >= -11.6 AND x0 <= -76.3 AND x1 >= -76.6 AS meets, y0 <= -11.6 AND x0 <= -76.6 AND y1 >= -11.4 AND x1 >= -76.3 AS holds,
    (greatest(y1, -11.4) - least(y0, -11.6)) * (greatest(x1, -76.3) - least(x0, -76.6)) - (y1 - y0) * (x1 - x0) AS gain FROM b""")  # fmt: skip
def spatial_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = customers(spark, sf_dir).groupBy((F.col("c_custkey") % 20).alias("g")).agg(F.min("lat").alias("y0"), F.min("lon").alias("x0"), F.max("lat").alias("y1"), F.max("lon").alias("x1"))
    box, other = tuple(F.col(c) for c in ("y0", "x0", "y1", "x1")), tuple(F.lit(v) for v in (-11.6, -76.6, -11.4, -76.3))
    return b.select("g", G.box_area(box).alias("area"), G.box_intersects(box, other).alias("meets"), G.box_contains(box, other).alias("holds"), G.box_enlargement(box, other).alias("gain"))
