"""Statements of the SQL dialect over the test tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenquery.plans import q_spatial
from lumenquery.plans.dialect import Session
from lumenquery.plans.q_text import _TOKENS
from lumenquery.plans.registry import query
from lumenquery.session import table


def session(spark: SparkSession, sf_dir: str) -> Session:
    s = Session(spark, "english", stemming=False)
    for name, key in (("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"), ("part", "p_partkey"), ("orders", "o_orderkey"), ("documents", "doc_id"), ("embeddings", "vec_id")):
        s.register(name, table(spark, sf_dir, name), key)
    places = q_spatial.customers(spark, sf_dir)
    s.register("places", places.select("c_custkey", F.struct("lat", "lon").alias("at")), "c_custkey")
    return s


@query("sql_filter_order", "SELECT p_partkey, p_brand FROM part WHERE (p_size > 40 OR p_brand = 'Brand#11') AND NOT p_retailprice < 950 ORDER BY p_retailprice DESC, p_partkey LIMIT 30")
def sql_filter_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark, sf_dir).execute("SELECT p_partkey, p_brand FROM part WHERE (p_size > 40 OR p_brand = 'Brand#11') AND NOT p_retailprice < 950 ORDER BY p_retailprice DESC LIMIT 30")


@query("sql_group", """SELECT p_type, count(*) AS "count(*)", avg(p_size) AS "avg(p_size)" FROM part WHERE p_brand LIKE 'Brand#1%' GROUP BY p_type""")
def sql_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark, sf_dir).execute("SELECT p_type, COUNT(*), AVG(p_size) FROM part WHERE p_brand LIKE 'Brand#1%' ORDER BY p_type GROUP BY p_type")


@query("sql_join", """SELECT c_name AS "customer.c_name", r_name AS "region.r_name" FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal BETWEEN 5000 AND 5200""")
def sql_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark, sf_dir).execute(
        "SELECT customer.c_name, region.r_name FROM customer JOIN nation ON customer.c_nationkey = nation.n_nationkey JOIN region ON nation.n_regionkey = region.r_regionkey WHERE customer.c_acctbal BETWEEN 5000 AND 5200"
    )


@query("sql_subquery", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 350000) AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def sql_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark, sf_dir).execute(
        "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 350000) AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)"
    )


@query("sql_spatial", f"""WITH {q_spatial._C} SELECT c_custkey, round({q_spatial._haversine('lat', 'lon', '-11.6', '-76.5')}, 3) AS d FROM customer_at
    WHERE {q_spatial._haversine('lat', 'lon', '-11.6', '-76.5')} < 30000 AND c_custkey > 20 ORDER BY {q_spatial._haversine('lat', 'lon', '-11.6', '-76.5')}, c_custkey LIMIT 12""")  # fmt: skip
def sql_spatial(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    s.execute("SET here = POINT(-11.6, -76.5)")
    out = s.execute("SELECT c_custkey, distancia(at, here) AS d FROM places WHERE distancia(at, here) < 30000 AND c_custkey > 20 ORDER BY distancia(at, here) LIMIT 12")
    return out.withColumn("d", F.round("d", 3))


@query("sql_match", f"""WITH {_TOKENS}, len AS (SELECT id, len(terms) AS dl FROM terms),
    sc AS (SELECT p.id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM post p JOIN dfs USING (term) JOIN len USING (id), stat WHERE term IN ('license', 'apache') GROUP BY p.id)
    SELECT doc_id, round(score, 6) AS s FROM documents JOIN sc ON doc_id = id WHERE doc_id > 100""")  # fmt: skip
def sql_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    s.execute("CREATE INDEX ON documents(text) USING INVERTED")
    return s.execute("SELECT doc_id, SCORE() AS s FROM documents WHERE MATCH(text, 'apache license') USING BM25 AND doc_id > 100").withColumn("s", F.round("s", 6))


@query("sql_similar", """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT v FROM e WHERE vec_id = 7)
    SELECT e.vec_id, round(1 / (1 + list_distance(e.v, q.v)), 9) AS s FROM e, q WHERE label <> 4 ORDER BY list_distance(e.v, q.v), e.vec_id LIMIT 8""")  # fmt: skip
def sql_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    s.execute("CREATE INDEX ON embeddings(embedding) USING EXACT")
    vector = json.dumps(table(spark, sf_dir, "embeddings").where("vec_id = 7").first().embedding)
    out = s.execute(f"SELECT vec_id, SIMILARITY_SCORE() AS s FROM embeddings WHERE SIMILAR_TO('{vector}', k=8) USING EXACT WITH METRIC=euclidean AND label <> 4")
    return out.withColumn("s", F.round("s", 9))


@query("sql_changes", "SELECT r_regionkey, CASE WHEN r_regionkey = 2 THEN 'CHANGED' ELSE r_name END AS r_name FROM region WHERE r_regionkey <> 1 UNION ALL SELECT 77, 'NEW'")
def sql_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    s.script("INSERT INTO region VALUES (77, 'NEW'); UPDATE region SET r_name = 'CHANGED' WHERE r_regionkey = 2; BEGIN; DELETE FROM region; ROLLBACK; DELETE FROM region WHERE r_regionkey = 1")
    return s.execute("SELECT * FROM region")
