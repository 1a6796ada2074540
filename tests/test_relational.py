import random

import pytest
from pyspark.sql import functions as F

from lumenquery.operators import relational as R
from lumenquery.operators.components import connected_components


@pytest.mark.parametrize(
    ("pattern", "text", "want"),
    [("a%b", "axxb", True), ("a%b", "a\nb", False), ("a_c", "abc", True), ("a_c", "a\nc", False), ("a.c", "abc", False), ("%", "", True), ("a", "a\n", False), ("A%", "abc", False), ("a\\%", "a\\z", True)],
)
def test_like(spark, pattern, text, want):
    assert spark.createDataFrame([(text,)], "s string").select(R.like(F.col("s"), pattern)).first()[0] is want


def test_empty_totals_are_zero(spark):
    row = spark.createDataFrame([], "x int").agg(R.total("count", None, "n"), R.total("sum", F.col("x"), "s"), R.total("avg", F.col("x"), "a")).first()
    assert tuple(row) == (0, 0, 0)


def test_group_without_aggregates_and_repeats(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "k string, x int")
    assert {tuple(r) for r in R.group_by(df, "k").collect()} == {("a", 2), ("b", 1)}
    assert R.group_by(df, "k", [("sum", "x"), ("sum", "x"), ("count", None)]).columns == ["k", "sum(x)", "count(*)"]


def test_in_subquery_ignores_nulls(spark):
    df, sub = spark.createDataFrame([(1,), (2,)], "x int"), spark.createDataFrame([(1,), (None,), (1,)], "y int")
    assert [r.x for r in R.in_subquery(df, "x", sub).collect()] == [1]
    assert [r.x for r in R.in_subquery(df, "x", sub, negated=True).collect()] == [2]


def test_interval_join_finds_each_pair_once(spark):
    a = spark.createDataFrame([("k", i, float(i * 3), i * 3 + 10.0) for i in range(20)], "k string, a int, s1 double, e1 double")
    b = spark.createDataFrame([("k", i, float(i * 5), i * 5 + 1.5) for i in range(20)] + [("k", 99, 4.0, 4.0)], "k string, b int, s2 double, e2 double")
    got = sorted((r.a, r.b) for r in R.interval_join(a, b, ["k"], ("s1", "e1"), ("s2", "e2"), 4.0).collect())
    want = sorted((x.a, y.b) for x in a.collect() for y in b.collect() if x.s1 < y.e2 and y.s2 < x.e1)
    assert got == want


@pytest.mark.parametrize("values", [[float(i) for i in range(1000)], [5.0] * 10, [1.0], [i / 1000 for i in range(1000)] + [50.0]])
def test_nth_from_quantile(spark, values):
    got = R.nth_from_quantile(spark.createDataFrame([(v,) for v in values], "v double"), "v", 0.99)
    assert got == sorted(values)[min(len(values) - 1, int(len(values) * 0.99))]


def test_quantile_of_nothing(spark):
    assert R.nth_from_quantile(spark.createDataFrame([], "v double"), "v", 0.99) is None


def test_largest_remainder(spark):
    out = {r.k: r.seats for r in R.largest_remainder(spark.createDataFrame([("a", 50), ("b", 30), ("c", 20), ("d", 0)], "k string, w int"), "k", "w", 7).collect()}
    assert out == {"a": 4, "b": 2, "c": 1}


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (9, 9), (None, 3), (10, 11), (11, 12), (12, 13), (13, 14), (3, 2)] + [(100 + i, 101 + i) for i in range(40)]
    out = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert out[3] == out[2] == out[1] == 1 and out[5] == out[4] == 4 and out[14] == 10 and 9 not in out
    assert {out[100 + i] for i in range(41)} == {100}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_nth_by_narrowing(spark, monkeypatch):
    """With few values to sort at once, a hot value and ties are narrowed to the same place as sorting gives."""
    monkeypatch.setattr(R, "EXACT", 40)
    rng = random.Random(1)
    for values in ([rng.random() for _ in range(700)], [5.0] * 400 + [rng.gauss(5, 1) for _ in range(300)], [float(rng.randrange(6)) for _ in range(500)], [1.0] * 300):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        for share in (0.0, 0.37, 0.5, 0.99, 1.0):
            assert R.nth_from_quantile(df, "v", share) == sorted(values)[min(len(values) - 1, int(len(values) * share))]
