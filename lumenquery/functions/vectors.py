"""Distances and scores of array columns, in double precision inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def literal(vector) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine within [0, 2]; 1 if either vector is zero."""
    size = norm(a) * norm(b)
    value = F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1 - dot(a, b) / F.when(size > 0, size)))
    return F.when(size > 0, value).otherwise(1.0)


def negative_dot(a: Column, b: Column) -> Column:
    return -dot(a, b)


DISTANCES = {"euclidean": euclidean, "cosine": cosine_distance, "dot": negative_dot}


def score(metric: str, distance: Column) -> Column:
    """A similarity from a distance: 1 - d, 1 / (1 + d) or -d."""
    return {"cosine": 1 - distance, "euclidean": 1 / (1 + distance), "dot": -distance}[metric]
