"""Samples, segments and quality measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenquery.operators import evaluation as V
from lumenquery.plans.registry import query
from lumenquery.session import table


@query("detection_quality", """SELECT event_type, CAST(sum((user_id % 3 <> 0)::INT) AS BIGINT) AS positives, CAST(sum((user_id % 3 = 0)::INT) AS BIGINT) AS negatives,
    avg((value > 20)::INT) FILTER (user_id % 3 <> 0) AS recall, avg((value > 40)::INT) FILTER (user_id % 3 = 0) AS false_rate FROM events GROUP BY event_type""")  # fmt: skip
def detection_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", F.when(F.col("user_id") % 3 != 0, F.col("user_id")).alias("expected"), (F.col("value") > 40).alias("found"), (F.col("value") > 20).alias("right"))
    return V.detection_quality(e, "event_type", "expected", "found", "right")


@query("segment_inventory", "SELECT p_partkey, CAST(s AS INT) AS segment, s * 2.0 AS start_s, (s + 1) * 2.0 AS end_s FROM (SELECT p_partkey, unnest(range(0, CAST(floor(p_size / 2.0) AS BIGINT))) AS s FROM part)")
def segment_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.segments(table(spark, sf_dir, "part"), "p_partkey", "p_size")


@query("passage_containment", r"""WITH b AS (SELECT item_id, string_split_regex(lower(text), '\s+') AS w FROM benchmark), d AS (SELECT doc_id, string_split_regex(lower(text), '\s+') AS w FROM documents)
    SELECT item_id, doc_id, round(len(list_intersect(b.w, d.w)) / len(list_distinct(b.w))::DOUBLE, 9) AS share FROM b, d WHERE len(list_intersect(b.w, d.w)) / len(list_distinct(b.w))::DOUBLE >= 0.6""")  # fmt: skip
def passage_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lambda t: F.split(F.lower(t), r"\s+")
    b = table(spark, sf_dir, "benchmark").select("item_id", words("text").alias("w"))
    d = table(spark, sf_dir, "documents").select("doc_id", words("text").alias("w"))
    return V.contained(b, "item_id", d, "doc_id", "w", 0.6).withColumn("share", F.round("share", 9))


@query("query_word_groups", r"""WITH g AS (SELECT len(list_filter(string_split_regex(trim(p_name), '\s+'), lambda w: w <> '')) AS n FROM part)
    SELECT CASE WHEN n = 1 THEN '1' WHEN n = 3 THEN '3' WHEN n >= 5 THEN '5+' END AS words, count(*) AS n FROM g GROUP BY 1""")  # fmt: skip
def query_word_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(V.word_group(F.col("p_name")).alias("words")).agg(F.count(F.lit(1)).alias("n"))


@query("judged_sample", """WITH j AS (SELECT DISTINCT l_suppkey AS query_id, l_partkey AS p, max(l_quantity) > 40 AS relevant FROM lineitem GROUP BY ALL),
    c AS (SELECT DISTINCT p FROM (SELECT p, relevant, row_number() OVER (PARTITION BY query_id, relevant ORDER BY md5('42' || p), p) AS n FROM j) WHERE n <= CASE WHEN relevant THEN 5 ELSE 3 END),
    r AS (SELECT p_partkey AS p FROM part WHERE p_partkey NOT IN (SELECT p FROM j) ORDER BY md5('42' || p_partkey), p_partkey LIMIT (SELECT greatest(0, 2500 - count(*)) FROM c))
    SELECT p, true AS core FROM c UNION ALL SELECT p, false FROM r""")  # fmt: skip
def judged_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("p")).agg((F.max("l_quantity") > 40).alias("relevant"))
    return V.judged_sample(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p")), j, "p", 2500, 5, 3)


@query("stores_per_product", """WITH c AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey), m AS (SELECT min(n) AS a, max(n) AS b FROM c)
    SELECT l_partkey, CAST(round_even(5 + 35 * least(1.0, (ln(n::DOUBLE) - ln(a::DOUBLE)) / (ln(b::DOUBLE) - ln(a::DOUBLE))), 0) AS INT) AS stores FROM c, m""")  # fmt: skip
def stores_per_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    low, high = c.agg(F.min("n"), F.max("n")).first()
    return c.select("l_partkey", V.log_scaled(F.col("n"), low, high).alias("stores"))
