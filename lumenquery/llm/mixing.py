"""Mixing sources to target weights with DataFrame functions only.

A document's place in its source's shuffled order is the MD5 of its id, so reruns agree. The hash
range is cut into buckets; prefix sums are taken over the bucket totals and then inside each bucket,
so no task ever holds a whole source. Bucket count is the square root of the row count: both the
bucket and the list of bucket totals of a source then stay at that size, however hot the source is.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from lumenquery.session import cut

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text):
    """Words of a text: runs of anything but ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=(5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """(source_key, source_size, target) from (source_key, size) rows.

    Sources in key order take the weights in turn. A target stops at max_epochs times its source's
    size and what is left over goes to the others by weight: with sources ordered by
    limit / weight, the capped ones are a prefix, found with running sums over one row per source.
    """
    per = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy("source_key")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", pick).withColumn("cap", F.col("source_size") * max_epochs)
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "source_key")
    every = Window.partitionBy()
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    per = (
        per.withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", F.col("left") / F.col("open"))
        .withColumn("fits", F.col("level") <= F.col("cap") / F.col("weight"))
        .withColumn("first_fit", F.when(F.col("fits"), F.struct(F.row_number().over(by_level).alias("nth"), "level")))
        .withColumn("settled", F.min("first_fit").over(every)["level"])
    )
    target = F.when(F.col("settled").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("settled") * F.col("weight")))
    return per.select("source_key", "source_size", target.alias("target"))


def _source_key(source):
    """Sources in code point order, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def _place(ident, text):
    """Where a document stands in its source's shuffled order; documents without an id stand by their text."""
    return F.coalesce(F.md5(ident.cast("string")), F.md5(F.concat(F.lit("text:"), F.coalesce(text, F.lit("")))))


def _taken(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, max_epochs: int) -> DataFrame:
    """(id, source_key, place, size, source_size, target, epochs, rest) of every document."""
    ident = F.col(id_col)
    slim = cut(docs.select(ident.alias("id"), _source_key(F.col(source_col)).alias("source_key"), word_count(F.col(text_col)).alias("size"), _place(ident, F.col(text_col)).alias("place")))
    rows = slim.count()
    bits = min(30, max(1, math.ceil(math.log2(math.sqrt(rows + 1)))))
    head = F.coalesce(F.conv(F.substring("place", 1, 8), 16, 10).cast("long"), F.lit(0))
    placed = slim.withColumn("bucket", F.shiftright(head, 32 - bits))
    totals = placed.groupBy("source_key", "bucket").agg(F.sum("size").alias("bucket_size"))
    ahead = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("start", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0))).drop("bucket_size")
    targets = source_targets(slim.select("source_key", "size"), weights, max_epochs)
    starts = starts.join(targets, "source_key")
    inside = Window.partitionBy("source_key", "bucket").orderBy("place", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    run = placed.join(starts, ["source_key", "bucket"]).withColumn("before", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(F.lit(0))
    rest = F.greatest(F.lit(0), F.least(F.col("size"), budget - epochs * F.col("source_size") - F.col("before")))
    return run.select("id", "source_key", "place", "size", "source_size", "target", epochs.cast("long").alias("epochs"), rest.cast("long").alias("rest"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """One row per document: id, size, source_size, target, taken.

    taken counts the words the mix takes from the document over all epochs: whole epochs first, then
    the shuffled order up to the exact budget, the document at the cut giving only the words that
    still fit. Null ids, sources and texts are ordinary values (a null source sorts last, a null
    text has size 0); repeated rows each count; an empty table gives no rows. Documents of size 0
    take 0. Extra columns are ignored, whatever their names.
    """
    run = _taken(docs, id_col, text_col, source_col, weights, max_epochs)
    return run.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("rest")).alias("taken"))


#: Sources up to this many are sent to every task; more are joined by key.
BROADCAST_SOURCES = 50_000


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """The rows of docs that the mix takes, once for each epoch that takes from them.

    A source's decision is its number of whole epochs and the last place of the shuffled order that
    the next one reaches, so documents need no join but with one row per source. The document at the
    cut is given whole. Documents without words are not taken; null ids stand by their text, a null
    source is a source; documents of one id stand and fall together. Columns stay as they are.
    """
    run = _taken(docs, id_col, text_col, source_col, weights, max_epochs)
    cuts = cut(run.groupBy(F.col("source_key").alias("source")).agg(F.max("epochs").alias("epochs"), F.coalesce(F.max(F.when(F.col("rest") > 0, F.col("place"))), F.lit("")).alias("cut")))
    if cuts.count() <= BROADCAST_SOURCES:
        cuts = F.broadcast(cuts)
    # the row is packed, so that columns of any name stay apart from these
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    words = word_count(F.col(text_col))
    keyed = docs.select(row, _source_key(F.col(source_col)).alias("source"), _place(F.col(id_col), F.col(text_col)).alias("place"), words.alias("words"))
    both = keyed.join(cuts, "source")
    again = (F.col("cut") != "") & (F.col("place") <= F.col("cut"))
    times = F.when(F.col("words") > 0, F.col("epochs") + again.cast("long")).otherwise(F.lit(0))
    return both.select("row", F.explode(F.array_repeat(F.lit(0), times.cast("int")))).select("row.*")
