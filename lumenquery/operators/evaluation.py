"""Samples, segments, placements and quality measures that benchmarks and applications share."""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumenquery.functions.spatial import METERS_PER_DEGREE


def detection_quality(rows: DataFrame, kind: str, expected: str, found: str, right: str) -> DataFrame:
    """(kind, positives, negatives, recall, false_rate): right detections of what is expected, any detection of what is not."""
    want = F.col(expected).isNotNull()
    return rows.groupBy(kind).agg(
        F.sum(want.cast("long")).alias("positives"), F.sum((~want).cast("long")).alias("negatives"),
        F.avg(F.when(want, F.col(right).cast("double"))).alias("recall"), F.avg(F.when(~want, F.col(found).cast("double"))).alias("false_rate"),
    )


def segments(tracks: DataFrame, key: str, duration: str, width: float = 2.0) -> DataFrame:
    """(key, segment, start_s, end_s): whole windows of a track, the tail dropped."""
    count = F.floor(F.col(duration) / width).cast("int")
    rows = tracks.where(count > 0).select(key, F.explode(F.sequence(F.lit(0), count - 1)).alias("segment"))
    return rows.select(key, "segment", (F.col("segment") * width).alias("start_s"), ((F.col("segment") + 1) * width).alias("end_s"))


def containment(mine: Column, other: Column) -> Column:
    """Share of the distinct words of one array that another has; 0 for none."""
    size = F.size(F.array_distinct(mine))
    return F.when(size > 0, F.size(F.array_intersect(mine, other)) / size).otherwise(0.0)


def contained(passages: DataFrame, passage: str, texts: DataFrame, text: str, words: str, least: float) -> DataFrame:
    """(passage, text, share): texts that have at least a share of a passage's distinct words.

    Words are arrays. A text with a share t of n words has one of any n - ceil(t n) + 1 of them, so
    each passage is looked for by its rarest words only, and common words join nothing.
    """
    own = passages.select(F.col(passage).alias("__p"), F.array_distinct(words).alias("__pw")).where(F.size("__pw") > 0)
    held = texts.select(F.col(text).alias("__t"), F.array_distinct(words).alias("__tw"))
    asked = own.select("__p", F.size("__pw").alias("n"), F.explode("__pw").alias("word"))
    vocabulary = asked.select("word").distinct()
    met = held.select("__t", F.explode_outer("__tw").alias("word")).join(vocabulary, "word", "left_semi")
    counts = met.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy("__p").orderBy(F.coalesce("df", F.lit(0)), "word")
    rare = asked.join(counts, "word", "left").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= F.col("n") - F.ceil(least * F.col("n") - 1e-9) + 1)
    pairs = rare.select("__p", "word").join(met, "word").select("__p", "__t").distinct()
    share = F.size(F.array_intersect("__pw", "__tw")) / F.size("__pw")
    return pairs.join(own, "__p").join(held, "__t").withColumn("share", share).where(F.col("share") >= least).select(F.col("__p").alias(passage), F.col("__t").alias(text), "share")


def word_group(text: Column) -> Column:
    """'1', '3' or '5+' words; other lengths have no group."""
    n = F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))
    return F.when(n == 1, "1").when(n == 3, "3").when(n >= 5, "5+")


def judged_sample(products: DataFrame, judgements: DataFrame, key: str, size: int, relevant_each: int, other_each: int, seed: str = "42") -> DataFrame:
    """(key, core): for each query some relevant and some other products, filled up with unjudged ones.

    judgements is (query_id, key, relevant). Judged products that are not chosen stay out, since they
    would be relevant without a mark. Chance is the MD5 of a seed and the key.
    """
    chance = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))
    order = Window.partitionBy("query_id", "relevant").orderBy(chance, key)
    chosen = judgements.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= F.when(F.col("relevant"), relevant_each).otherwise(other_each))
    core = chosen.select(key).distinct().withColumn("core", F.lit(True))
    rest = products.select(key).distinct().join(judgements.select(key), key, "left_anti").orderBy(chance, key).limit(max(0, size - core.count()))
    return core.unionByName(rest.withColumn("core", F.lit(False)))


def placed_in_disk(df: DataFrame, lat: str, lon: str, area_km2: str, key: str, seed: int = 42, share: float = 0.8) -> DataFrame:
    """df with at_lat and at_lon: uniform in a disk of the area round the point, the same for a key each time."""
    chance = lambda n: F.pmod(F.xxhash64(F.lit(seed + n), F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    r = F.sqrt(F.col(area_km2) / math.pi) * 1000 * F.sqrt(chance(0)) * share
    angle = chance(1) * 2 * math.pi
    return df.withColumns({"at_lat": F.col(lat) + r * F.sin(angle) / METERS_PER_DEGREE, "at_lon": F.col(lon) + r * F.cos(angle) / (METERS_PER_DEGREE * F.cos(F.radians(F.col(lat))))})


def log_scaled(value: Column, low: float, high: float, least: int = 5, most: int = 40) -> Column:
    """A whole number between least and most on a log scale of a value between low and high, halves to even."""
    if high <= low:
        return F.lit(least)
    t = (F.ln(F.greatest(value.cast("double"), F.lit(float(low)))) - math.log(low)) / (math.log(high) - math.log(low))
    return F.bround(least + (most - least) * F.least(F.lit(1.0), t)).cast("int")


def grown(df: DataFrame, key: str, vec_col: str, times: int, pull: float = 0.2, noise: float = 0.02, seed: int = 42) -> DataFrame:
    """(key, copy, vector): every vector, and times - 1 relatives of each for tests of scale.

    A relative lies up to `pull` of the way to the vector that follows in hash order, with components
    shaken by up to `noise` of their size, so zeros of both stay zeros. Chance is a hash of seed, key
    and copy. Hash order is kept inside 256 hash buckets, so no single task sorts all rows.
    """
    chance = lambda *parts: F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 30)) / float(1 << 30)
    mark = F.xxhash64(F.lit(seed), F.col(key))
    order = Window.partitionBy(F.pmod(mark, F.lit(256))).orderBy(mark, key)
    rows = df.select(F.col(key), F.col(vec_col).cast("array<double>").alias("__v")).withColumn("__n", F.coalesce(F.lead("__v").over(order), F.col("__v")))
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    step = F.when(F.col("copy") == 0, 0.0).otherwise(pull * chance(F.col(key), F.col("copy")))
    shake = lambda i: F.when(F.col("copy") == 0, 1.0).otherwise(1 + noise * (2 * chance(F.col(key), F.col("copy"), i) - 1))
    mixed = F.transform(F.zip_with("__v", "__n", lambda a, b: a + F.col("__step") * (b - a)), lambda x, i: x * shake(i))
    return copies.withColumn("__step", step).select(key, "copy", mixed.alias(vec_col))


def noise_gains(power: Column) -> Column:
    """Gains (bins of frames) that take a steady noise floor off a power spectrogram, an array of bins.

    The floor is the median of the upper quarter of the bins over ln 2; a fiftieth of the power stays.
    Without a floor all gains are 1; cells without power have gain 0.
    """
    upper = F.array_sort(F.flatten(F.slice(power, F.floor(3 * F.size(power) / 4).cast("int") + 1, F.size(power))))
    n = F.size(upper)
    middle = (F.element_at(upper, (F.floor((n + 1) / 2)).cast("int")) + F.element_at(upper, (F.floor((n + 2) / 2)).cast("int"))) / 2
    floor = F.when(n > 0, middle).otherwise(0.0) / math.log(2)

    def gain(p):
        return F.when(floor <= 1e-12, 1.0).when(p <= 0, 0.0).otherwise(F.sqrt(F.greatest(p - floor, 0.02 * p) / p))

    return F.transform(power, lambda frames: F.transform(frames, gain))


class PurchaseConflict(ValueError):
    """A request key belongs to another purchase, or stock does not suffice."""


def purchase(operations: DataFrame, stock: DataFrame, request: str, user: int, items: list[dict]) -> tuple[dict, DataFrame, DataFrame]:
    """(answer, operations, stock) after a purchase; the same request again gives the stored answer and changes nothing.

    operations is (request, user, signature, answer), stock (product, store, stock). Items are
    {product, store, quantity}; one line for each product and store, 20 lines at most.
    """
    if not 1 <= len(items) <= 20 or len({(i["product"], i["store"]) for i in items}) != len(items) or any(i["quantity"] < 1 for i in items):
        raise PurchaseConflict("a purchase has 1 to 20 different lines of 1 or more")
    items = sorted(items, key=lambda i: (i["product"], i["store"]))
    signature = hashlib.sha256(json.dumps(items, sort_keys=True).encode()).hexdigest()
    before = operations.where(F.col("request") == request).first()
    if before is not None:
        if before["user"] != user or before["signature"] != signature:
            raise PurchaseConflict("the request key belongs to another purchase")
        return json.loads(before["answer"]), operations, stock
    spark = operations.sparkSession
    asked = spark.createDataFrame([(i["product"], i["store"], i["quantity"]) for i in items], "product long, store long, __q long")
    after = stock.join(F.broadcast(asked), ["product", "store"], "left").withColumn("__q", F.coalesce("__q", F.lit(0)))
    enough = after.where("__q > 0 AND stock >= __q").count()
    if enough != len(items):
        raise PurchaseConflict("stock does not suffice")
    answer = {"request": request, "items": items}
    row = spark.createDataFrame([(request, user, signature, json.dumps(answer))], operations.schema)
    return answer, operations.unionByName(row), after.select("product", "store", (F.col("stock") - F.col("__q")).alias("stock"))
