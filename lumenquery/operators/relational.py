"""Relational operators with the semantics that Spark's own do not have out of the box."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumenquery.session import Scratch


def like(column: Column, pattern: str) -> Column:
    """LIKE without an escape sign, matching the whole string; wildcards do not match line ends."""
    body = "".join({"%": r"[^\n]*", "_": r"[^\n]"}.get(ch, re.escape(ch)) for ch in pattern)
    return column.rlike(rf"\A{body}\z")


def in_subquery(df: DataFrame, column: str, subquery: DataFrame, negated: bool = False) -> DataFrame:
    """IN / NOT IN over a one-column subquery, two-valued: a semi or anti join on non-null keys."""
    keys = subquery.toDF("__key").where("__key IS NOT NULL").distinct()
    return df.join(keys, df[column] == keys["__key"], "left_anti" if negated else "left_semi")


def total(kind: str, column: Column | None, label: str) -> Column:
    """count, sum or avg whose value over no rows is 0."""
    if kind == "count":
        return F.count(F.lit(1)).alias(label)
    value = F.sum(column) if kind == "sum" else F.avg(column)
    return F.coalesce(value, F.lit(0)).alias(label)


def group_by(df: DataFrame, key: str, aggregates: list[tuple[str, str | None]] = ()) -> DataFrame:
    """One key and (function, column) aggregates labelled fn(column); without aggregates, the count.

    The key comes first. A repeated aggregate appears once.
    """
    if not aggregates:
        return df.groupBy(key).agg(F.count(F.lit(1)).alias("count"))
    labels = dict.fromkeys((fn, c) for fn, c in aggregates)
    return df.groupBy(key).agg(*[total(fn, F.col(c) if c else None, f"{fn}({c or '*'})") for fn, c in labels])


def top_per_group(df: DataFrame, groups: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of every group; Spark limits the groups before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return df.withColumn("__place", place).where(F.col("__place") <= k).drop("__place")


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str], width: float) -> DataFrame:
    """Pairs of equal keys whose half-open numeric spans overlap.

    Spans are dealt to buckets of `width`, so a hot key splits over time; a pair is kept in the
    bucket where its overlap starts. Non-key column names must differ.
    """
    a, b = left_span
    c, d = right_span
    # spans without length still stand in the bucket of their start
    buckets = lambda s, e: F.sequence(F.floor(F.col(s) / width).cast("long"), F.greatest(F.floor(F.col(s) / width), F.ceil(F.col(e) / width) - 1).cast("long"))
    x = left.withColumn("__bucket", F.explode(buckets(a, b)))
    y = right.withColumn("__bucket", F.explode(buckets(c, d)))
    met = x.join(y, [*keys, "__bucket"]).where((F.col(a) < F.col(d)) & (F.col(c) < F.col(b)))
    return met.where(F.floor(F.greatest(F.col(a), F.col(c)) / width).cast("long") == F.col("__bucket")).drop("__bucket")


def nth_from_quantile(df: DataFrame, column: str, share: float) -> float | None:
    """The value at index min(n - 1, floor(n * share)) of the sorted non-null values; None if there are none.

    Only counts and bounds reach the driver until few enough values are left to sort.
    """
    scratch = Scratch(df.sparkSession)
    try:
        return _nth(scratch.store(df.where(F.col(column).isNotNull()).select(F.col(column).alias("v"))), share)
    finally:
        scratch.close()


def _nth(known: DataFrame, share: float) -> float | None:
    n = known.count()
    if not n:
        return None
    place = min(n - 1, int(n * share))
    # an interval of approximate quantiles is counted exactly and narrowed until few values are left
    edges = lambda rows, a, b: rows.agg(F.percentile_approx("v", F.array(F.lit(max(0.0, a)), F.lit(min(1.0, b))), 10_000)).first()[0]
    low, high = known.agg(F.min("v"), F.max("v")).first()
    below = 0  # values under low
    while True:
        inside = known.where(F.col("v").between(low, high))
        size = inside.count()
        if size <= EXACT:
            return float(inside.orderBy("v").limit(place - below + 1).agg(F.max("v")).first()[0])
        at = (place - below + 0.5) / size
        lo, hi = edges(inside, at - 0.001, at + 0.001)
        if lo == hi or (lo == low and hi == high):
            # one value stands there, or nothing narrows: count what is around it
            under = inside.where(F.col("v") < lo).count()
            if below + under > place:
                high = inside.where(F.col("v") < lo).agg(F.max("v")).first()[0]
            elif below + under + inside.where(F.col("v") == lo).count() > place:
                return float(lo)
            else:
                below += inside.where(F.col("v") <= lo).count()
                low = inside.where(F.col("v") > lo).agg(F.min("v")).first()[0]
            continue
        under = inside.where(F.col("v") < lo).count()
        if below + under > place:  # the approximation was too high
            high = inside.where(F.col("v") < lo).agg(F.max("v")).first()[0]
        elif below + inside.where(F.col("v") <= hi).count() <= place:  # or too low
            below += inside.where(F.col("v") <= hi).count()
            low = inside.where(F.col("v") > hi).agg(F.min("v")).first()[0]
        else:
            below, low, high = below + under, lo, hi


EXACT = 100_000  # values that are sorted to read one of them


def largest_remainder(df: DataFrame, key: str, weight: str, seats: int) -> DataFrame:
    """(key, seats): shares of whole seats in proportion to weights, the rest by largest remainder, then key."""
    quota = F.lit(seats) * F.col(weight) / F.sum(weight).over(Window.partitionBy())
    base = df.select(key, quota.alias("__quota")).withColumn("__base", F.floor("__quota"))
    rank = F.row_number().over(Window.orderBy(F.desc(F.col("__quota") - F.col("__base")), key))
    left = F.lit(seats) - F.sum("__base").over(Window.partitionBy())
    return base.withColumn("__rank", rank).withColumn("seats", (F.col("__base") + (F.col("__rank") <= left).cast("long")).cast("long")).where("seats > 0").select(key, "seats")


def statistics(df: DataFrame, key: str) -> DataFrame:
    """Rows, distinct keys and key bounds of a table."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_keys"), F.min(key).alias("key_low"), F.max(key).alias("key_high"))


def fixed_width_window(df: DataFrame, time: str, width: float) -> Column:
    """Index of the tumbling window of a time in seconds."""
    return F.floor(F.col(time) / width).cast("long")


def sliding_starts(time: Column, width: float, hop: float) -> Column:
    """Indices n of all sliding windows [n * hop, n * hop + width) that hold a time, from 0 on."""
    last = F.floor(time / hop).cast("long")
    first = F.greatest(F.lit(0).cast("long"), (F.floor((time - width) / hop) + 1).cast("long"))
    return F.sequence(first, last)
