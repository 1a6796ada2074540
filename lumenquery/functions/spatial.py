"""Distances in metres and containment, as Column expressions on degrees."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, functions as F

EARTH_RADIUS_M = 6_371_000.0  # fixed value
METERS_PER_DEGREE = math.pi * EARTH_RADIUS_M / 180.0
EPS = 1e-12  # fixed value: slack of the boundary test


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance; longitudes wrap at the antimeridian."""
    lat1, lon1, lat2, lon2 = map(_col, (lat1, lon1, lat2, lon2))
    gap = F.abs(lon1 - lon2)
    wrapped = F.least(gap, 360.0 - gap)
    up, across = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(wrapped) / 2)
    chord = up * up + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * across * across
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(F.lit(1.0), chord)))


def local_euclidean_m(lat1, lon1, lat2, lon2) -> Column:
    """Distance on the plane that touches at the mean latitude; longitudes do not wrap."""
    lat1, lon1, lat2, lon2 = map(_col, (lat1, lon1, lat2, lon2))
    dx = (lon1 - lon2) * METERS_PER_DEGREE * F.cos(F.radians((lat1 + lat2) / 2))
    return F.hypot(dx, (lat1 - lat2) * METERS_PER_DEGREE)


METRICS = {"haversine": haversine_m, "euclidean": local_euclidean_m}


def in_polygon(lat: Column, lon: Column, vertices: list[tuple[float, float]]) -> Column:
    """Whether a point is in a polygon of (lat, lon) vertices: its boundary, or inside by even-odd count."""
    if len(vertices) < 3:
        return F.lit(False)
    edges = list(zip(vertices, [*vertices[1:], vertices[0]], strict=True))
    on_edge, crossings = [], []
    for (ay, ax), (by, bx) in edges:
        turn = (bx - ax) * (lat - ay) - (by - ay) * (lon - ax)
        box = lon.between(min(ax, bx) - EPS, max(ax, bx) + EPS) & lat.between(min(ay, by) - EPS, max(ay, by) + EPS)
        on_edge.append((F.abs(turn) <= EPS) & box)
        if ay != by:
            spans = (F.lit(ay) > lat) != (F.lit(by) > lat)
            crossings.append((spans & (lon < ax + (lat - ay) * (bx - ax) / (by - ay))).cast("int"))
    inside = reduce(lambda a, b: a + b, crossings, F.lit(0)) % 2 == 1
    return reduce(lambda a, b: a | b, on_edge) | inside


def bounding_box(lat: float, lon: float, radius_m: float) -> tuple[float, float, float, float] | None:
    """(lat low, lat high, lon low, lon high) that holds a circle; None where it reaches a pole or wraps."""
    dlat = radius_m / METERS_PER_DEGREE * 1.0000001
    low, high = lat - dlat, lat + dlat
    if low <= -90 or high >= 90:
        return None
    dlon = math.degrees(math.asin(min(1.0, math.sin(min(math.pi / 2, radius_m / EARTH_RADIUS_M)) / math.cos(math.radians(lat))))) * 1.0000001 + 1e-9
    if math.sin(min(math.pi / 2, radius_m / EARTH_RADIUS_M)) >= math.cos(math.radians(lat)) or lon - dlon < -180 or lon + dlon > 180:
        return None
    return low, high, lon - dlon, lon + dlon


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """Rectangle test on plain columns, which Parquet readers can push down."""
    return lat.between(box[0], box[1]) & lon.between(box[2], box[3])


# ---- rectangles as (lat low, lon low, lat high, lon high)


def box_area(b) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def box_union(a, b) -> tuple:
    return F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3])


def box_enlargement(a, b) -> Column:
    """Area that a gains by taking in b."""
    return box_area(box_union(a, b)) - box_area(a)


def box_intersects(a, b) -> Column:
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def box_contains(a, b) -> Column:
    return (a[0] <= b[0]) & (a[1] <= b[1]) & (a[2] >= b[2]) & (a[3] >= b[3])


def box_min_distance(lat, lon, b, metric: str = "haversine") -> Column:
    """Distance from a point to the nearest point of a rectangle, by clamping."""
    y, x = F.least(F.greatest(lat, b[0]), b[2]), F.least(F.greatest(lon, b[1]), b[3])
    return METRICS[metric](lat, lon, y, x)
