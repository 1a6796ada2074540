"""Co-purchase affinity, score fusion, attribute similarity, catalogue and curation operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumenquery.operators.relational import nth_from_quantile

MAX_PER_USER = 50  # fixed value: users with more items add no pairs
SHRINK = 10  # fixed value
NEIGHBOURS = 20  # fixed value


def buyers(purchases: DataFrame, user: str, item: str) -> DataFrame:
    """(item, buyers): distinct users of every item."""
    return purchases.select(user, item).distinct().groupBy(item).agg(F.count(F.lit(1)).alias("buyers"))


def supports(purchases: DataFrame, user: str, item: str, max_per_user: int = MAX_PER_USER) -> DataFrame:
    """(a, b, support) with a < b: users who have both.

    A user's items become one sorted array, bounded by the limit that drops heavy users, and pairs
    are made inside it: one shuffle for the arrays and one for the counts, no self-join.
    """
    sizes = purchases.select(user, item).distinct()
    baskets = sizes.groupBy(user).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(item)).alias("items")).where(F.col("n").between(2, max_per_user))
    pairs = baskets.select(F.explode(F.flatten(F.transform("items", lambda x, i: F.transform(F.slice("items", i + 2, F.size("items")), lambda y: F.struct(x.alias("a"), y.alias("b"))))).alias("p")).alias("p"))
    return pairs.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count(F.lit(1)).alias("support"))


def affinity(support: Column, buyers_a: Column, buyers_b: Column, shrink: float = SHRINK) -> Column:
    """Cosine of the two sets of users, shrunk where few users share them."""
    return support / F.sqrt(buyers_a.cast("double") * buyers_b) * (support / (support + F.lit(float(shrink))))


def scored_pairs(pairs: DataFrame, counts: DataFrame, item: str) -> DataFrame:
    """(a, b, score, support) of unordered pairs."""
    n_a, n_b = counts.select(F.col(item).alias("a"), F.col("buyers").alias("na")), counts.select(F.col(item).alias("b"), F.col("buyers").alias("nb"))
    return pairs.join(n_a, "a").join(n_b, "b").select("a", "b", affinity(F.col("support"), F.col("na"), F.col("nb")).alias("score"), "support")


def neighbours(scored: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(source, target, score, support): the k nearest items of each, by score, support, then id."""
    # both directions of a pair from one row, so the pairs are scored once
    ways = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("target")), F.struct(F.col("b").alias("source"), F.col("a").alias("target")))
    both = scored.select(F.explode(ways).alias("w"), "score", "support").select("w.source", "w.target", "score", "support")
    order = Window.partitionBy("source").orderBy(F.desc("score"), F.desc("support"), "target")
    return both.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= k).drop("__place")


def add_purchase(counts: DataFrame, pairs: DataFrame, purchases: DataFrame, user_value, new_items: list, user: str, item: str) -> tuple[DataFrame, DataFrame]:
    """(counts, supports) after one user buys items: one buyer more a new item, one user more a new pair."""
    spark = counts.sparkSession
    had = purchases.where(F.col(user) == user_value).select(item).distinct()
    offered = spark.createDataFrame([(x,) for x in dict.fromkeys(new_items)], f"`{item}` {counts.schema[item].dataType.simpleString()}")
    fresh = offered.join(had, item, "left_anti")
    counted = counts.unionByName(fresh.select(item, F.lit(1).cast("long").alias("buyers"))).groupBy(item).agg(F.sum("buyers").alias("buyers"))
    everything = had.unionByName(fresh).select(F.col(item).alias("y"))
    met = fresh.select(F.col(item).alias("x")).join(F.broadcast(everything), F.col("x") != F.col("y"))
    gained = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().withColumn("support", F.lit(1).cast("long"))
    return counted, pairs.unionByName(gained).groupBy("a", "b").agg(F.sum("support").alias("support"))


def global_scale(scores: DataFrame, column: str, share: float = 0.99) -> float | None:
    """A high quantile that no single extreme decides; None if there is none over zero."""
    value = nth_from_quantile(scores, column, share)
    return value if value and value > 0 else None


# ---- fusion: signals are (signal, id, score) rows


def normalised(signals: DataFrame, scales: dict[str, float] | None = None) -> DataFrame:
    """signals with value in [0, 1]: min-max inside a signal (1 if all are equal), or score / scale cut to [0, 1]."""
    per = signals.groupBy("signal").agg(F.min("score").alias("__low"), F.max("score").alias("__high"))
    spread = F.col("__high") - F.col("__low")
    value = F.when(spread == 0, 1.0).otherwise((F.col("score") - F.col("__low")) / spread)
    for name, scale in (scales or {}).items():
        value = F.when(F.col("signal") == name, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score") / scale))).otherwise(value)
    return signals.join(F.broadcast(per), "signal").withColumn("value", value).drop("__low", "__high")


def first_seen(signals: DataFrame, place: str) -> DataFrame:
    """One row for each (signal, id): the one of the least place."""
    order = Window.partitionBy("signal", "id").orderBy(place)
    return signals.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def fuse(signals: DataFrame, weights: dict[str, float], scales: dict[str, float] | None = None) -> DataFrame:
    """(id, total, and part_, pct_ and place_ of each signal), best first.

    The weights of signals without rows go to the others, so weights always sum to 1.
    """
    if any(w < 0 for w in weights.values()) or sum(weights.values()) <= 0:
        raise ValueError("weights are not negative and have a positive sum")
    wanted = [s for s, w in weights.items() if w > 0]
    active = {r.signal for r in signals.where(F.col("signal").isin(wanted)).select("signal").distinct().collect()}
    total = sum(weights[s] for s in active) or 1.0
    rows = normalised(signals.where(F.col("signal").isin(sorted(active))), scales)
    place = F.row_number().over(Window.partitionBy("signal").orderBy(F.desc("score"), "id"))
    weight = reduce(lambda acc, s: F.when(F.col("signal") == s, weights[s] / total).otherwise(acc), sorted(active), F.lit(0.0))
    rows = rows.withColumn("place", place).withColumn("part", weight * F.col("value"))
    one = lambda s, c: F.max(F.when(F.col("signal") == s, F.col(c)))
    out = rows.groupBy("id").agg(F.sum("part").alias("total"), *[F.coalesce(one(s, "part"), F.lit(0.0)).alias(f"part_{s}") for s in weights], *[one(s, "place").alias(f"place_{s}") for s in weights])
    pct = {f"pct_{s}": F.when(F.col("total") > 0, 100 * F.col(f"part_{s}") / F.col("total")).otherwise(0.0) for s in weights}
    return out.withColumns(pct).orderBy(F.desc("total"), "id")


def combine(signals: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(id, total): the fused scores alone, for search."""
    return fuse(signals, weights).select("id", "total")


#: Shares of the signals of search and of recommendation (fixed values).
SEARCH = {"lexical": 0.4, "semantic": 0.4, "popularity": 0.2}
SIMILAR = {"visual": 1.0, "text": 1.0, "metadata": 1.0, "purchases": 1.0}


def hybrid_search(lexical: DataFrame, semantic: DataFrame, counts: DataFrame, item: str, k: int, weights: dict[str, float] | None = None) -> DataFrame:
    """(id, total) of the k best by words, meaning and ln(1 + buyers) of what either found.

    lexical and semantic are (id, score), repeated ids count with their best; counts is (item, buyers).
    """
    best = lambda df, name: df.groupBy("id").agg(F.max("score").alias("score")).select(F.lit(name).alias("signal"), "id", F.col("score").cast("double").alias("score"))
    found = best(lexical, "lexical").unionByName(best(semantic, "semantic"))
    ids = found.select("id").distinct()
    bought = counts.select(F.col(item).alias("id"), F.col("buyers").cast("double").alias("buyers"))
    popular = ids.join(bought, "id", "left").select(F.lit("popularity").alias("signal"), "id", F.log1p(F.coalesce("buyers", F.lit(0.0))).alias("score"))
    return combine(found.unionByName(popular), weights or SEARCH).limit(k)


def recommend(anchor, visual: DataFrame, lexical: DataFrame, semantic: DataFrame, metadata: DataFrame, purchases: DataFrame, k: int, weights: dict[str, float] | None = None, purchase_scale: float | None = None) -> DataFrame:
    """The k items most like an anchor by four signals, with each signal's part, share and place.

    Every signal is (id, score). Words and meaning are brought to [0, 1] and count half each as the
    text signal; purchases are held against the catalogue's scale if it is given. The anchor itself is
    left out, and weights of signals without rows go to the others.
    """
    as_rows = lambda df, name: df.where(F.col("id") != F.lit(anchor)).select(F.lit(name).alias("signal"), "id", F.col("score").cast("double").alias("score"))
    halves = normalised(as_rows(lexical, "lexical").unionByName(as_rows(semantic, "semantic")))
    text = halves.groupBy("id").agg((F.sum("value") / 2).alias("score"))
    signals = as_rows(visual, "visual").unionByName(as_rows(text, "text")).unionByName(as_rows(metadata, "metadata")).unionByName(as_rows(purchases, "purchases"))
    return fuse(signals, weights or SIMILAR, {"purchases": purchase_scale} if purchase_scale else None).limit(k)


# ---- attributes


def log_price_range(df: DataFrame, price: str) -> float:
    """ln(highest) - ln(lowest) of the positive prices, 0 without any."""
    row = df.where(F.col(price) > 0).agg(F.max(price).alias("high"), F.min(price).alias("low")).select(F.ln("high") - F.ln("low")).first()
    return float(row[0] or 0.0)


def gower(kind_a, kind_b, brand_a, brand_b, price_a, price_b, price_range: float) -> Column:
    """Mean of the similarities that both sides have: kind, brand without case, price on a log scale."""
    parts = [(kind_a == kind_b).cast("double")]
    known = [F.lit(1)]
    both = (brand_a != "") & (brand_b != "")
    parts.append(F.when(both, (F.lower(brand_a) == F.lower(brand_b)).cast("double")).otherwise(0.0))
    known.append(both.cast("int"))
    if price_range > 0:
        priced = (price_a > 0) & (price_b > 0)
        parts.append(F.when(priced, 1 - F.abs(F.ln(price_a) - F.ln(price_b)) / price_range).otherwise(0.0))
        known.append(priced.cast("int"))
    return reduce(lambda a, b: a + b, parts) / reduce(lambda a, b: a + b, known)


def best_sellers(counts: DataFrame, item: str, k: int = 50) -> DataFrame:
    return counts.orderBy(F.desc("buyers"), item).limit(k)


def catalogue_page(df: DataFrame, key: str, after=None, size: int = 24, where: Column | None = None) -> DataFrame:
    """The next page in key order behind a key: the filter is pushed down, nothing before it is read."""
    rows = df if after is None else df.where(F.col(key) > after)
    rows = rows if where is None else rows.where(where)
    return rows.orderBy(key).limit(min(size, 500))


# ---- curation


def longest_prefix(df: DataFrame, path: str, rules: dict[tuple[str, ...], str], label: str) -> DataFrame:
    """df with the target of the longest rule that a path (array) starts with; rows without one go."""
    target = F.lit(None).cast("string")
    for prefix in sorted(rules, key=len):
        hit = F.slice(F.col(path), 1, len(prefix)) == F.array(*[F.lit(p) for p in prefix])
        target = F.when(hit, rules[prefix]).otherwise(target)
    return df.withColumn(label, target).where(F.col(label).isNotNull())


def title_key(title: Column) -> Column:
    """A title without case and with runs of other signs as one space."""
    return F.trim(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}_]+", " "))


def unique_titles(df: DataFrame, title: str, reviews: str, key: str) -> DataFrame:
    """One row a title: most reviews, then least key."""
    order = Window.partitionBy(title_key(F.col(title))).orderBy(F.desc(reviews), key)
    return df.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def quotas(counts: dict[str, int], n: int) -> dict[str, int]:
    """The highest common ceiling whose capped counts stay within n; small groups enter whole."""
    left, ceiling, sizes = n, 0, sorted(counts.values())
    for i, c in enumerate(sizes):
        fair = left // (len(sizes) - i)
        if c > fair:  # all larger groups share what is left alike
            ceiling = fair
            break
        left, ceiling = left - c, c
    return {k: min(c, ceiling) for k, c in counts.items()}


def interleave(df: DataFrame, group: str, order: list[Column], sub: str) -> DataFrame:
    """df with place: inside a group, its subgroups take turns, each in the given order."""
    turn = F.row_number().over(Window.partitionBy(group, sub).orderBy(*order))
    rows = df.withColumn("__turn", turn)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("__turn", sub))).drop("__turn")


def curated(df: DataFrame, group: str, sub: str, title: str, reviews: str, key: str, n: int) -> DataFrame:
    """n rows or fewer: unique titles, equal ceilings a group, subgroups in turn."""
    rows = unique_titles(df, title, reviews, key)
    counts = {r[group]: r["count"] for r in rows.groupBy(group).count().collect()}  # one row a group
    caps = quotas(counts, n)
    placed = interleave(rows, group, [F.desc(reviews), F.col(key)], sub)
    cap = reduce(lambda acc, kv: F.when(F.col(group) == kv[0], kv[1]).otherwise(acc), sorted(caps.items()), F.lit(0))
    return placed.where(F.col("place") <= cap)
