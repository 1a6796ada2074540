"""Affinity, fusion, similarity, curation and sequence queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenquery.operators import recommend as C, sequences as Q
from lumenquery.plans.registry import query
from lumenquery.session import Scratch, epoch_seconds, table

_BOUGHT = "bought AS (SELECT DISTINCT o_custkey AS u, l_partkey AS i FROM orders JOIN lineitem ON o_orderkey = l_orderkey), cnt AS (SELECT i, count(*) AS buyers FROM bought GROUP BY i)"
_PAIRS = f"""{_BOUGHT}, few AS (SELECT u FROM bought GROUP BY u HAVING count(*) <= 50), kept AS (SELECT * FROM bought WHERE u IN (SELECT u FROM few)),
    pairs AS (SELECT x.i AS a, y.i AS b, count(*) AS support FROM kept x JOIN kept y ON x.u = y.u AND x.i < y.i GROUP BY ALL),
    scored AS (SELECT a, b, support, support / sqrt(p.buyers::DOUBLE * q.buyers) * (support / (support + 10.0::DOUBLE)) AS score FROM pairs JOIN cnt p ON a = p.i JOIN cnt q ON b = q.i)"""


def _bought(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return o.join(li, o.o_orderkey == li.l_orderkey).select(F.col("o_custkey").alias("u"), F.col("l_partkey").alias("i")).distinct()


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    bought = _bought(spark, sf_dir)
    return C.scored_pairs(C.supports(bought, "u", "i"), C.buyers(bought, "u", "i"), "i")


@query("best_sellers", f"WITH {_BOUGHT} SELECT i, buyers FROM cnt ORDER BY buyers DESC, i LIMIT 50")
def best_sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.best_sellers(C.buyers(_bought(spark, sf_dir), "u", "i"), "i")


@query("affinity_neighbours", f"""WITH {_PAIRS}, two AS (SELECT a AS source, b AS target, score, support FROM scored UNION ALL SELECT b, a, score, support FROM scored),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(score, 12) DESC, support DESC, target) AS place FROM two) SELECT source, target, round(score, 9) AS score, support FROM r WHERE place <= 20""")  # fmt: skip
def affinity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.neighbours(_scored(spark, sf_dir).withColumn("score", F.round("score", 12))).withColumn("score", F.round("score", 9))


@query("affinity_scale", f"""WITH {_PAIRS}, r AS (SELECT score, row_number() OVER (ORDER BY score) AS i, count(*) OVER () AS n FROM scored)
    SELECT round(score, 9) AS scale FROM r WHERE i = least(n, CAST(floor(n * 0.99) AS BIGINT) + 1)""")  # fmt: skip
def affinity_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    scale = C.global_scale(_scored(spark, sf_dir), "score")
    return spark.range(1).select(F.round(F.lit(scale).cast("double"), 9).alias("scale"))


@query("affinity_after_purchase", f"""WITH {_BOUGHT}, had AS (SELECT i FROM bought WHERE u = 7), fresh AS (SELECT i FROM (VALUES (1), (2), (3)) v(i) WHERE i NOT IN (SELECT i FROM had)),
    few AS (SELECT u FROM bought GROUP BY u HAVING count(*) <= 50), kept AS (SELECT * FROM bought WHERE u IN (SELECT u FROM few)),
    pairs AS (SELECT x.i AS a, y.i AS b, count(*) AS support FROM kept x JOIN kept y ON x.u = y.u AND x.i < y.i GROUP BY ALL),
    more AS (SELECT DISTINCT least(f.i, e.i) AS a, greatest(f.i, e.i) AS b, 1 AS support FROM fresh f, (SELECT i FROM had UNION SELECT i FROM fresh) e WHERE f.i <> e.i)
    SELECT a, b, CAST(sum(support) AS BIGINT) AS support FROM (SELECT * FROM pairs UNION ALL SELECT * FROM more) GROUP BY a, b""")  # fmt: skip
def affinity_after_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    bought = _bought(spark, sf_dir)
    _, pairs = C.add_purchase(C.buyers(bought, "u", "i"), C.supports(bought, "u", "i"), bought, 7, [1, 2, 3], "u", "i")
    return pairs


_SIGNALS = """sig AS (SELECT 'price' AS signal, p_partkey AS id, p_retailprice AS score FROM part UNION ALL
    SELECT 'size', p_partkey, CAST(p_size AS DOUBLE) FROM part UNION ALL SELECT 'sold', l_partkey, sum(l_quantity) / 1000 FROM lineitem GROUP BY l_partkey)"""


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, li = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    price = p.select(F.lit("price").alias("signal"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score"))
    size = p.select(F.lit("size").alias("signal"), F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("score"))
    sold = li.groupBy(F.col("l_partkey").alias("id")).agg((F.sum("l_quantity") / 1000).alias("score")).select(F.lit("sold").alias("signal"), "id", "score")
    return price.unionByName(size).unionByName(sold)


@query("fusion", f"""WITH {_SIGNALS}, n AS (SELECT *, CASE WHEN signal = 'sold' THEN least(1.0, greatest(0.0, score / 0.9)) WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS value,
    row_number() OVER (PARTITION BY signal ORDER BY score DESC, id) AS place FROM sig WINDOW w AS (PARTITION BY signal)), c AS (SELECT *, value * CASE signal WHEN 'price' THEN 0.5 WHEN 'size' THEN 0.2 ELSE 0.3 END AS part FROM n)
    SELECT id, round(sum(part), 9) AS total, round(coalesce(max(part) FILTER (signal = 'price'), 0), 9) AS part_price, CAST(max(place) FILTER (signal = 'size') AS INT) AS place_size,
    round(CASE WHEN sum(part) > 0 THEN 100 * coalesce(max(part) FILTER (signal = 'sold'), 0) / sum(part) ELSE 0 END, 6) AS pct_sold FROM c GROUP BY id""")  # fmt: skip
def fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = C.fuse(_signals(spark, sf_dir), {"price": 1.0, "size": 0.4, "sold": 0.6, "absent": 3.0}, {"sold": 0.9})
    return fused.select("id", F.round("total", 9).alias("total"), F.round("part_price", 9).alias("part_price"), "place_size", F.round("pct_sold", 6).alias("pct_sold"))


@query("search_combined", f"""WITH {_SIGNALS}, n AS (SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS value FROM sig WINDOW w AS (PARTITION BY signal))
    SELECT id, round(sum(value * CASE signal WHEN 'price' THEN 0.4 WHEN 'size' THEN 0.4 ELSE 0.2 END), 9) AS total FROM n GROUP BY id ORDER BY round(sum(value * CASE signal WHEN 'price' THEN 0.4 WHEN 'size' THEN 0.4 ELSE 0.2 END), 9) DESC, id LIMIT 25""")  # fmt: skip
def search_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.combine(_signals(spark, sf_dir), {"price": 0.4, "size": 0.4, "sold": 0.2}).withColumn("total", F.round("total", 9)).orderBy(F.desc("total"), "id").limit(25)


@query("gower_similar", """WITH r AS (SELECT ln(max(p_retailprice)) - ln(min(p_retailprice)) AS span FROM part WHERE p_retailprice > 0), q AS (SELECT * FROM part WHERE p_partkey = 10)
    SELECT p.p_partkey, round(((p.p_type = q.p_type)::INT + (lower(p.p_brand) = lower(q.p_brand))::INT + 1 - abs(ln(p.p_retailprice) - ln(q.p_retailprice)) / span) / 3, 9) AS score FROM part p, q, r WHERE p.p_partkey <> 10
    ORDER BY round(((p.p_type = q.p_type)::INT + (lower(p.p_brand) = lower(q.p_brand))::INT + 1 - abs(ln(p.p_retailprice) - ln(q.p_retailprice)) / span) / 3, 9) DESC, p.p_partkey LIMIT 20""")  # fmt: skip
def gower_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    own = p.where("p_partkey = 10").first()
    span = C.log_price_range(p, "p_retailprice")
    score = C.gower(F.col("p_type"), F.lit(own.p_type), F.col("p_brand"), F.lit(own.p_brand), F.col("p_retailprice"), F.lit(own.p_retailprice), span)
    return p.where("p_partkey <> 10").select("p_partkey", F.round(score, 9).alias("score")).orderBy(F.desc("score"), "p_partkey").limit(20)


@query("catalogue_page", "SELECT p_partkey, p_name FROM part WHERE p_partkey > 100 AND p_size > 20 ORDER BY p_partkey LIMIT 24")
def catalogue_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.catalogue_page(table(spark, sf_dir, "part"), "p_partkey", 100, 24, F.col("p_size") > 20).select("p_partkey", "p_name")


@query("curation", """WITH u AS (SELECT *, row_number() OVER (PARTITION BY trim(regexp_replace(lower(p_name), '\\W+', ' ', 'g')) ORDER BY p_size DESC, p_partkey) AS n FROM part), k AS (SELECT * FROM u WHERE n = 1),
    t AS (SELECT *, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_size DESC, p_partkey) AS turn FROM k), pl AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY turn, p_brand) AS place FROM t),
    c AS (SELECT p_type, count(*) AS c FROM k GROUP BY p_type), cap AS (SELECT coalesce(max(h), 0) AS h FROM (SELECT unnest(range(1, (SELECT max(c) FROM c) + 1)) AS h) WHERE (SELECT sum(least(c, h)) FROM c) <= 120)
    SELECT p_partkey, p_type, CAST(place AS INT) AS place FROM pl, cap WHERE place <= h""")  # fmt: skip
def curation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.curated(table(spark, sf_dir, "part"), "p_type", "p_brand", "p_name", "p_size", "p_partkey", 120).select("p_partkey", "p_type", "place")


@query("alignment_votes", """WITH h AS (SELECT user_id, event_type, fmod(epoch_us(ts) / 1000000.0::DOUBLE - 1704067200, 600) AS q, fmod(epoch_us(ts) / 1000000.0::DOUBLE - 1704067200, 600) + floor(value / 40) AS o, 1 / (1 + value) AS sim FROM events),
    t AS (SELECT *, o - v * q AS off FROM h, (VALUES (0.95::DOUBLE), (1.0), (1.05)) s(v)),
    w AS (SELECT a.user_id, a.event_type, a.v, a.off AS opened, b.q, b.sim, b.off, row_number() OVER (PARTITION BY a.user_id, a.event_type, a.v, a.off, b.q ORDER BY b.sim DESC, b.off) AS n
          FROM (SELECT DISTINCT user_id, event_type, v, off FROM t) a JOIN t b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.v = b.v AND b.off >= a.off AND b.off <= a.off + 4),
    c AS (SELECT user_id, event_type, v, opened, count(*) AS votes, round(avg(sim), 9) AS sim, median(off) AS offset_s, min(q) AS first_s, max(q) AS last_s FROM w WHERE n = 1 GROUP BY ALL HAVING count(*) >= 2 AND max(q) - min(q) >= 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY votes DESC, sim DESC, round(abs(1 - v), 9), v, opened) AS place FROM c)
    SELECT user_id, event_type, CAST(votes AS INT) AS votes, sim AS similarity, v AS speed, round(offset_s, 6) AS offset_s, round(first_s, 6) AS first_s, round(last_s, 6) AS last_s FROM r WHERE place = 1""")  # fmt: skip
def alignment_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("s", epoch_seconds("ts") - 1704067200)
    hits = e.select("user_id", "event_type", F.pmod("s", F.lit(600.0)).alias("query_s"), (F.pmod("s", F.lit(600.0)) + F.floor(F.col("value") / 40)).alias("original_s"), (1 / (1 + F.col("value"))).alias("similarity"))
    found = Q.alignment_votes(hits, ["user_id", "event_type"], tolerance=2.0)
    return found.select("user_id", "event_type", "votes", "similarity", "speed", *[F.round(c, 6).alias(n) for c, n in (("offset", "offset_s"), ("first_s", "first_s"), ("last_s", "last_s"))])


@query("merged_events", """WITH RECURSIVE s AS (SELECT user_id, event_id, epoch_us(ts) / 1000000.0::DOUBLE - 1704067200 AS start_s, value FROM events),
    e AS (SELECT user_id, start_s, start_s + 43200 AS end_s, value / 100 AS off, CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 1.05 END::DOUBLE AS speed, 1 / (1 + value) AS sim, [floor(start_s / 1800)::DOUBLE, floor(start_s / 1800)::DOUBLE + 1] AS inst FROM s),
    o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_s, end_s, off, speed, sim) AS n FROM e),
    f(user_id, n, acc) AS (SELECT user_id, n, [{'start_s': start_s, 'end_s': end_s, 'off': off, 'speed': speed, 'sim': sim, 'inst': inst}] FROM o WHERE n = 1
      UNION ALL SELECT user_id, n, CASE WHEN hit IS NULL THEN list_append(acc, {'start_s': start_s, 'end_s': end_s, 'off': off, 'speed': speed, 'sim': sim, 'inst': inst}) ELSE list_transform(acc, lambda x, i: CASE WHEN i = hit THEN
        {'start_s': x.start_s, 'end_s': greatest(x.end_s, end_s), 'off': x.off, 'speed': x.speed, 'sim': (x.sim * len(x.inst) + sim * (len(list_distinct(list_concat(x.inst, inst))) - len(x.inst))) / len(list_distinct(list_concat(x.inst, inst))), 'inst': list_distinct(list_concat(x.inst, inst))} ELSE x END) END
        FROM (SELECT o.*, f.acc, list_max(list_transform(f.acc, lambda x, i: CASE WHEN o.start_s <= x.end_s + 3600 AND abs(x.speed - o.speed) <= 0.051 AND abs(x.off - o.off) <= 1 THEN i END)) AS hit FROM f JOIN o ON f.user_id = o.user_id AND o.n = f.n + 1)),
    l AS (SELECT user_id, unnest(acc) AS x FROM f QUALIFY n = max(n) OVER (PARTITION BY user_id))
    SELECT user_id, round(x.start_s, 3) AS start_s, round(x.end_s, 3) AS end_s, x.speed AS speed, round(x.off, 9) AS off, round(x.sim, 9) AS similarity, CAST(len(x.inst) AS INT) AS votes FROM l""")  # fmt: skip
def merged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("s", epoch_seconds("ts") - 1704067200)
    at = F.floor(F.col("s") / 1800).cast("double")
    spans = e.select("user_id", F.col("s").alias("start_s"), (F.col("s") + 43200).alias("end_s"), F.when(F.col("event_id") % 3 == 0, 1.0).otherwise(1.05).alias("speed"), (F.col("value") / 100).alias("offset"), (1 / (1 + F.col("value"))).alias("similarity"), F.array(at, at + 1).alias("instants"))
    found = Q.merge_events(spans, "user_id", step=3600.0, tolerance=0.5)
    return found.select("user_id", F.round("start_s", 3).alias("start_s"), F.round("end_s", 3).alias("end_s"), "speed", F.round("offset", 9).alias("off"), F.round("similarity", 9).alias("similarity"), "votes")


@query("free_spans", """WITH c AS (SELECT user_id, epoch_us(ts) / 1000000.0::DOUBLE - 1704067200 AS s, epoch_us(ts) / 1000000.0::DOUBLE - 1704067200 + 7200 AS e FROM events WHERE event_type = 'view'), w AS (SELECT DISTINCT user_id, 0.0 AS w0, 604800.0 AS w1 FROM events),
    m AS (SELECT user_id, w0, w1, s, e FROM w JOIN c USING (user_id) WHERE e > w0 AND s < w1 UNION ALL SELECT user_id, w0, w1, w1, w1 FROM w),
    f AS (SELECT *, greatest(w0, coalesce(max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), w0)) AS frm FROM m)
    SELECT user_id, round(frm, 3) AS start_s, round(least(s, w1), 3) AS end_s FROM f WHERE frm < s""")  # fmt: skip
def free_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    covered = e.where("event_type = 'view'").select("user_id", (epoch_seconds("ts") - 1704067200).alias("start_s"), (epoch_seconds("ts") - 1704067200 + 7200).alias("end_s"))
    whole = e.select("user_id").distinct().select("user_id", F.lit(0.0).alias("start_s"), F.lit(604800.0).alias("end_s"))
    return Q.free_spans(whole, covered, "user_id").select("user_id", F.round("start_s", 3).alias("start_s"), F.round("end_s", 3).alias("end_s"))


_ROUTES = "SELECT event_id, user_id, value, epoch_us(ts) / 1000000.0::DOUBLE AS s FROM events WHERE event_type = "


@query("stronger_spans", f"""WITH b AS (SELECT *, s + 1800 AS e, 0 AS r FROM ({_ROUTES} 'view') UNION ALL SELECT *, s + 1800, 1 FROM ({_ROUTES} 'click'))
    SELECT event_id, user_id, value FROM b x WHERE NOT EXISTS (SELECT 1 FROM b y WHERE x.user_id = y.user_id AND x.s < y.e AND y.s < x.e AND x.r <> y.r AND (y.value > x.value OR (y.value = x.value AND y.r < x.r)))""")  # fmt: skip
def stronger_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("start_s", epoch_seconds("ts")).withColumn("end_s", F.col("start_s") + 1800)
    cols = ["event_id", "user_id", "value", "start_s", "end_s"]
    return Q.keep_stronger(e.where("event_type = 'view'").select(cols), e.where("event_type = 'click'").select(cols), "user_id", "value").select("event_id", "user_id", "value")


@query("densest_window", """WITH e AS (SELECT user_id, epoch_us(ts) / 1000000.0::DOUBLE - 1704067200 AS s, value FROM events), t AS (SELECT a.user_id, a.s, sum(b.value) AS total FROM e a JOIN e b ON a.user_id = b.user_id AND b.s >= a.s AND b.s + 60 <= a.s + 86400 GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(total, 6) DESC, s) AS n FROM t) SELECT user_id, round(s, 3) AS start, round(total, 6) AS total FROM r WHERE n = 1""")  # fmt: skip
def densest_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", (epoch_seconds("ts") - 1704067200).alias("s"), "value").withColumn("e", F.col("s") + 60)
    return Q.densest_window(e, "user_id", "s", "e", "value", 86400.0).select("user_id", F.round("start", 3).alias("start"), F.round("total", 6).alias("total"))


@query("phrase_votes")
def phrase_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as phrases, documents as tracks, BM25 as the score."""
    from lumenquery.operators import text_index as X

    docs = table(spark, sf_dir, "documents")
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.concat_ws(":", "conv_id", "turn").alias("phrase"), "text")
    asked = Scratch(spark).store(X.postings(turns, "phrase", "text").withColumnRenamed("id", "query"))
    words = asked.groupBy("query").agg(F.sum("tf").cast("int").alias("words")).where("words >= 3")
    hits = X.bm25_blocks(docs, "doc_id", "text", asked.join(words.select("query"), "query", "left_semi"), 5)
    rows = hits.join(words, "query")
    part = F.split("query", ":")
    at = part[1].cast("double") * 5
    return Q.phrase_votes(rows.select(part[0].alias("query"), F.col("query").alias("phrase"), "words", F.col("id").alias("track"), at.alias("q_start"), (at + 4).alias("q_end"), at.alias("o_start"), "score"))
