"""Radius, rectangle, polygon, nearest-neighbour and distance-join operators over lat/lon columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumenquery.functions import spatial as S
from lumenquery.session import Scratch


def radius(df: DataFrame, lat: str, lon: str, point: tuple[float, float], meters: float, metric: str = "haversine", strict: bool = False) -> DataFrame:
    """Rows within meters of a point, with distance_m; a pushable rectangle goes before the exact test."""
    box = S.bounding_box(*point, meters) if metric == "haversine" else None
    near = df.where(S.in_box(F.col(lat), F.col(lon), box)) if box else df
    near = near.withColumn("distance_m", S.METRICS[metric](F.col(lat), F.col(lon), *point))
    return near.where(F.col("distance_m") < meters if strict else F.col("distance_m") <= meters)


def rectangle(df: DataFrame, lat: str, lon: str, corner: tuple[float, float], other: tuple[float, float]) -> DataFrame:
    (a, b), (c, d) = corner, other
    return df.where(S.in_box(F.col(lat), F.col(lon), (min(a, c), max(a, c), min(b, d), max(b, d))))


def polygon(df: DataFrame, lat: str, lon: str, vertices: list[tuple[float, float]]) -> DataFrame:
    """Rows inside a polygon or on its boundary, after a pushable rectangle."""
    ys, xs = [v[0] for v in vertices], [v[1] for v in vertices]
    box = (min(ys) - S.EPS, max(ys) + S.EPS, min(xs) - S.EPS, max(xs) + S.EPS)
    return df.where(S.in_box(F.col(lat), F.col(lon), box)).where(S.in_polygon(F.col(lat), F.col(lon), vertices))


def nearest(df: DataFrame, lat: str, lon: str, point: tuple[float, float], k: int, key: str, metric: str = "haversine", where: Column | None = None) -> DataFrame:
    """The k rows nearest to a point after a filter, ties by key: one TakeOrdered, no shuffle."""
    rows = df if where is None else df.where(where)
    return rows.withColumn("distance_m", S.METRICS[metric](F.col(lat), F.col(lon), *point)).orderBy("distance_m", key).limit(k)


def distance_join(left: DataFrame, right: DataFrame, left_at: tuple[str, str], right_at: tuple[str, str], meters: float) -> DataFrame:
    """Pairs within meters: both sides meet in grid cells, then the exact distance decides.

    A cell is at least `meters` high and wide at the latitude of its row; the left side is looked up
    in its own cell and the eight around it, so each pair meets once. Column names must differ.
    """
    step = meters / S.METERS_PER_DEGREE * 1.000001
    rows_of = lambda lat: F.floor(F.col(lat) / step).cast("long")
    # widest degree step of the row of cells and its neighbours: that of the latitude farthest from the equator
    far = lambda row: F.least(F.lit(89.0), (F.abs(row.cast("double")) + 2) * step)
    width = lambda row: F.lit(step) / F.cos(F.radians(far(row)))
    r = right.withColumn("__row", rows_of(right_at[0])).withColumn("__cell", F.floor((F.col(right_at[1]) + 180.0) / width(F.col("__row"))).cast("long"))
    up = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    l_rows = left.withColumn("__row", F.explode(F.transform(up, lambda d: rows_of(left_at[0]) + d)))
    cells = F.floor(F.lit(360.0) / width(F.col("__row"))).cast("long") + 1
    here = F.floor((F.col(left_at[1]) + 180.0) / width(F.col("__row"))).cast("long")
    # the last cell of a row is cut short by the antimeridian, so it takes a second neighbour
    around = F.array_distinct(F.transform(F.array(*[F.lit(d) for d in (-2, -1, 0, 1, 2)]), lambda d: F.pmod(here + d, cells)))
    l_cells = l_rows.withColumn("__cell", F.explode(around))
    met = l_cells.join(r, ["__row", "__cell"])
    met = met.withColumn("distance_m", S.haversine_m(F.col(left_at[0]), F.col(left_at[1]), F.col(right_at[0]), F.col(right_at[1])))
    return met.where(F.col("distance_m") <= meters).drop("__row", "__cell")


def cell_of(lat: Column, lon: Column, degrees: float) -> Column:
    """Grid cell key, to partition or sort files by place."""
    per_row = math.ceil(360.0 / degrees)
    return F.floor((lat + 90.0) / degrees) * per_row + F.floor((lon + 180.0) / degrees)


def map_sample(df: DataFrame, key: str, lat: str, lon: str, limit: int) -> DataFrame:
    """At most `limit` evenly spaced rows in key order, each with the bounding box of all rows."""
    box = df.agg(F.min(lat).alias("lat_low"), F.max(lat).alias("lat_high"), F.min(lon).alias("lon_low"), F.max(lon).alias("lon_high"), F.count(F.lit(1)).alias("n")).first()
    step = max(1, math.ceil(box.n / limit))
    parts = df.select(key).rdd.getNumPartitions()
    by = F.col(key).asc_nulls_last()
    # ranks without one big window: rows before each partition, then places inside it. The partition of
    # a row is stored with it, since a plan that runs again may deal rows to other partitions
    scratch = Scratch(df.sparkSession)
    ranked = scratch.store((df.repartitionByRange(parts, by) if parts > 1 else df.coalesce(1)).withColumn("__part", F.spark_partition_id()))
    counts = {r["__part"]: r["count"] for r in ranked.groupBy("__part").count().collect()}
    before, total = [], 0
    for part in sorted(counts):
        before.append((part, total))
        total += counts[part]
    starts = F.broadcast(df.sparkSession.createDataFrame(before, "__part int, __start long"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(by)) - 1 + F.col("__start")
    picked = ranked.join(starts, "__part").withColumn("__place", place).where(F.col("__place") % step == 0)
    out = picked.select(*[F.col(f"`{c}`") for c in df.columns])
    return out.withColumns({c: F.lit(box[c]) for c in ("lat_low", "lat_high", "lon_low", "lon_high")})
