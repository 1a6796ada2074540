"""Connected components over an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lumenquery.session import Scratch


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, scratch: Scratch | None = None) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node it can reach.

    Edges are undirected; loops, repeats and nulls are ignored. Every round rewrites the edge set
    with two aggregations and joins and cuts lineage by a written table, the last of which stays in
    the scratch folder for the result, so nothing but two scalars per round reaches the driver. The rounds needed grow with
    the logarithm of the longest path. An empty table gives an empty result.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    e = scratch.store(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour is linked to the least of the neighbourhood
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        # small star: smaller neighbours and the node itself are linked to the least of them
        moved = large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        nxt = moved.unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        nxt = scratch.store(nxt)
        scratch.free(e)
        state = nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        e = nxt
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()
