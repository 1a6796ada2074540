"""Named queries over the test tables, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenquery.session import table

FLAGSHIP = "group_by_priority"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can express it, its oracle."""

    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query(
    "group_by_priority",
    """SELECT o_orderpriority, count(*) AS n, sum(o_totalprice) AS total, avg(o_totalprice) AS mean
       FROM orders GROUP BY o_orderpriority""",
)
def group_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return (
        o.groupBy("o_orderpriority")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"), F.avg("o_totalprice").alias("mean"))
        .orderBy("o_orderpriority")
    )


from lumenquery.plans import q_dialect, q_evaluation, q_recommend, q_relational, q_spatial, q_tables, q_text, q_vector  # noqa: E402, F401  (modules register their queries)
