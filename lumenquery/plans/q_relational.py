"""Scans, predicates, joins, aggregates, ordering and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenquery.operators import relational as R
from lumenquery.plans.registry import query
from lumenquery.session import epoch_seconds, table


@query("scan_project", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")


@query("scan_point_lookup", "SELECT * FROM orders WHERE o_orderkey = 37")
def scan_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where(F.col("o_orderkey") == 37)


@query("scan_key_range", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey >= 100 AND c_custkey <= 160")
def scan_key_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where(F.col("c_custkey").between(100, 160)).select("c_custkey", "c_name", "c_acctbal").orderBy("c_custkey")


@query("filter_boolean", """SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem
    WHERE (l_quantity >= 45 OR l_discount > 0.09) AND NOT (l_returnflag = 'N') AND l_linestatus <> 'O'""")  # fmt: skip
def filter_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    keep = ((F.col("l_quantity") >= 45) | (F.col("l_discount") > 0.09)) & ~(F.col("l_returnflag") == "N") & (F.col("l_linestatus") != "O")
    return li.where(keep).select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


@query("filter_columns", "SELECT l_orderkey, l_partkey, l_tax, l_discount FROM lineitem WHERE l_tax > l_discount AND l_quantity < 3")
def filter_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where((F.col("l_tax") > F.col("l_discount")) & (F.col("l_quantity") < 3)).select("l_orderkey", "l_partkey", "l_tax", "l_discount")


@query("filter_like", r"SELECT p_partkey, p_name FROM part WHERE regexp_full_match(p_name, '[^\n]*r[^\n]d[^\n]*') AND NOT regexp_full_match(p_type, 'PROMO[^\n]*')")
def filter_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.where(R.like(F.col("p_name"), "%r_d%") & ~R.like(F.col("p_type"), "PROMO%")).select("p_partkey", "p_name")


@query("filter_in_list", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('F')")
def filter_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & ~F.col("o_orderstatus").isin("F")).select("o_orderkey", "o_orderpriority")


@query("filter_between", "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice BETWEEN 920 AND 930 AND p_size NOT BETWEEN 10 AND 40")
def filter_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.where(F.col("p_retailprice").between(920, 930) & ~F.col("p_size").between(10, 40)).select("p_partkey", "p_retailprice")


@query("in_subquery", """SELECT c_custkey, c_name FROM customer WHERE c_custkey IN
    (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)""")  # fmt: skip
def in_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").where(F.col("o_totalprice") > 300000).select("o_custkey")
    return R.in_subquery(table(spark, sf_dir, "customer"), "c_custkey", big).select("c_custkey", "c_name")


@query("in_limited_subquery", """SELECT c_custkey, c_name FROM customer WHERE c_custkey IN
    (SELECT o_custkey FROM (SELECT o_custkey, o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25))""")  # fmt: skip
def in_limited_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_custkey")
    return R.in_subquery(table(spark, sf_dir, "customer"), "c_custkey", top).select("c_custkey", "c_name")


@query("not_in_subquery", """SELECT p_partkey, p_brand FROM part WHERE p_partkey NOT IN
    (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)""")  # fmt: skip
def not_in_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    sold = table(spark, sf_dir, "lineitem").where(F.col("l_quantity") > 49).select("l_partkey")
    return R.in_subquery(table(spark, sf_dir, "part"), "p_partkey", sold, negated=True).select("p_partkey", "p_brand")


@query("join_two", """SELECT o_orderkey AS "orders.o_orderkey", c_name AS "customer.c_name" FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 250000""")  # fmt: skip
def join_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    both = o.join(c, o.o_custkey == c.c_custkey).where((F.col("c_mktsegment") == "BUILDING") & (F.col("o_totalprice") > 250000))
    return both.select(F.col("o_orderkey").alias("orders.o_orderkey"), F.col("c_name").alias("customer.c_name"))


@query("join_many", """SELECT l_orderkey, s_name, n_name, r_name, l_extendedprice FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND l_quantity > 48""")  # fmt: skip
def join_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, s, n, r = (table(spark, sf_dir, x) for x in ("lineitem", "supplier", "nation", "region"))
    out = li.join(s, li.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return out.where((F.col("r_name") == "ASIA") & (F.col("l_quantity") > 48)).select("l_orderkey", "s_name", "n_name", "r_name", "l_extendedprice")


@query("join_group_count", """SELECT n_name, count(*) AS "count" FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def join_group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return R.group_by(c.join(n, c.c_nationkey == n.n_nationkey), "n_name")


@query("join_revenue", """SELECT n_name, sum(l_extendedprice * (1 - l_discount)) AS revenue, count(*) AS n FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")  # fmt: skip
def join_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o, c, n = (table(spark, sf_dir, x) for x in ("lineitem", "orders", "customer", "nation"))
    out = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return out.groupBy("n_name").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("group_count", """SELECT event_type, count(*) AS "count" FROM events GROUP BY event_type""")
def group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.group_by(table(spark, sf_dir, "events"), "event_type")


@query("group_sum_avg", """SELECT l_returnflag, count(*) AS "count(*)", sum(l_quantity) AS "sum(l_quantity)", avg(l_extendedprice) AS "avg(l_extendedprice)"
    FROM lineitem GROUP BY l_returnflag""")  # fmt: skip
def group_sum_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.group_by(table(spark, sf_dir, "lineitem"), "l_returnflag", [("count", None), ("sum", "l_quantity"), ("avg", "l_extendedprice")])


@query("global_aggregate", """SELECT count(*) AS "count(*)", coalesce(sum(o_totalprice), 0) AS "sum(o_totalprice)", coalesce(avg(o_totalprice), 0) AS "avg(o_totalprice)" FROM orders""")
def global_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").agg(R.total("count", None, "count(*)"), R.total("sum", price, "sum(o_totalprice)"), R.total("avg", price, "avg(o_totalprice)"))


@query("global_aggregate_empty", """SELECT count(*) AS n, coalesce(sum(p_size), 0) AS total, coalesce(avg(p_size), 0) AS mean FROM part WHERE p_size < 0""")
def global_aggregate_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = table(spark, sf_dir, "part").where(F.col("p_size") < 0)
    return none.agg(R.total("count", None, "n"), R.total("sum", F.col("p_size"), "total"), R.total("avg", F.col("p_size"), "mean"))


@query("pricing_summary", """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_extendedprice) AS sum_base, sum(l_extendedprice * (1 - l_discount)) AS sum_disc,
    avg(l_quantity) AS avg_qty, avg(l_discount) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")  # fmt: skip
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.sum("l_extendedprice").alias("sum_base"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("sum_disc"),
        F.avg("l_quantity").alias("avg_qty"), F.avg("l_discount").alias("avg_disc"), F.count(F.lit(1)).alias("n"),
    )


@query("order_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def order_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


@query("order_ascending", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey")
def order_ascending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").orderBy("c_acctbal", "c_custkey")


@query("top_per_group", """SELECT o_custkey, o_orderkey, o_totalprice FROM
    (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 3""")  # fmt: skip
def top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return R.top_per_group(o, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3)


@query("set_operations", """(SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier)
    EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0""")  # fmt: skip
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where(F.col("c_acctbal") > 9000).select(F.col("c_nationkey").alias("k"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    n = table(spark, sf_dir, "nation").where(F.col("n_regionkey") == 0).select(F.col("n_nationkey").alias("k"))
    return c.intersect(s).subtract(n)


@query("left_join_defaults", """SELECT c_custkey, coalesce(n, 0) AS n_orders, coalesce(top, 0) AS top_price FROM customer LEFT JOIN
    (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey""")  # fmt: skip
def left_join_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey")
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top"))
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.coalesce("top", F.lit(0.0)).alias("top_price"))


@query("missing_keys", "SELECT c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY c_custkey")
def missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")).distinct()
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("key"))
    return keys.join(urgent, "key", "left_anti")


@query("interval_overlap_join", """WITH spans AS (SELECT event_id, user_id, event_type, epoch_us(ts) / 1000000.0 AS s, epoch_us(ts) / 1000000.0 + 900 AS e FROM events)
    SELECT a.event_id AS view_id, b.event_id AS click_id, a.user_id FROM spans a JOIN spans b ON a.user_id = b.user_id AND a.s < b.e AND b.s < a.e
    WHERE a.event_type = 'view' AND b.event_type = 'click'""")  # fmt: skip
def interval_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("s", epoch_seconds("ts"))
    a = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("s").alias("s1"), (F.col("s") + 900).alias("e1"))
    b = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("s").alias("s2"), (F.col("s") + 900).alias("e2"))
    return R.interval_join(a, b, ["user_id"], ("s1", "e1"), ("s2", "e2"), 3600.0).select("view_id", "click_id", "user_id")


@query("table_statistics", "SELECT count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_keys, min(l_orderkey) AS key_low, max(l_orderkey) AS key_high FROM lineitem")
def table_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.statistics(table(spark, sf_dir, "lineitem"), "l_orderkey")


@query("quantile_scale", """WITH r AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) AS i, count(*) OVER () AS n FROM orders)
    SELECT v AS scale FROM r WHERE i = least(n, CAST(floor(n * 0.99) AS BIGINT) + 1)""")  # fmt: skip
def quantile_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = R.nth_from_quantile(table(spark, sf_dir, "orders"), "o_totalprice", 0.99)
    return spark.range(1).select(F.lit(value).cast("double").alias("scale"))


@query("proportional_seats", """WITH w AS (SELECT c_nationkey AS k, count(*) AS weight FROM customer GROUP BY c_nationkey),
    q AS (SELECT k, 200 * weight / sum(weight) OVER () AS quota FROM w), b AS (SELECT k, quota, floor(quota) AS base FROM q),
    r AS (SELECT *, row_number() OVER (ORDER BY quota - base DESC, k) AS place, 200 - sum(base) OVER () AS rest FROM b)
    SELECT k, CAST(base + CASE WHEN place <= rest THEN 1 ELSE 0 END AS BIGINT) AS seats FROM r WHERE base + CASE WHEN place <= rest THEN 1 ELSE 0 END > 0""")  # fmt: skip
def proportional_seats(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("weight"))
    return R.largest_remainder(w, "k", "weight", 200)


@query("tumbling_segments", """SELECT user_id, CAST(floor(epoch_us(ts) / 1000000.0 / 7200) AS BIGINT) AS segment, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL""")
def tumbling_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("s", epoch_seconds("ts"))
    return e.withColumn("segment", R.fixed_width_window(e, "s", 7200)).groupBy("user_id", "segment").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("sliding_windows", """WITH e AS (SELECT event_type, epoch_us(ts) / 1000000.0 - 1704067200 AS s, value FROM events)
    SELECT event_type, w AS win, count(*) AS n, max(value) AS top FROM (SELECT *, unnest(range(greatest(0, CAST(floor((s - 86400) / 21600) AS BIGINT) + 1), CAST(floor(s / 21600) AS BIGINT) + 1)) AS w FROM e) GROUP BY ALL""")  # fmt: skip
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("s", epoch_seconds("ts") - 1704067200)
    return e.withColumn("win", F.explode(R.sliding_starts(F.col("s"), 86400, 21600))).groupBy("event_type", "win").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))


@query("sessions", """WITH e AS (SELECT user_id, ts, epoch_us(ts) / 1000000.0 AS s FROM events), g AS
    (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s) <= 1800 THEN 0 ELSE 1 END AS fresh FROM e),
    n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM n GROUP BY user_id, session""")  # fmt: skip
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenquery.operators.sequences import gap_groups

    e = table(spark, sf_dir, "events").select("user_id", "ts", (epoch_seconds("ts")).alias("s"))
    grouped = gap_groups(e, ["user_id"], "s", 1800.0, "session")
    return grouped.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("json_property", """SELECT event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS k FROM events GROUP BY event_type""")
def json_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))
