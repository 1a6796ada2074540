"""Windowed, sessionised and stateful operators over event streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F


def read_stream(spark: SparkSession, path: str, schema, pattern: str | None = None) -> DataFrame:
    """Parquet files as a stream; a glob pattern picks files of a folder."""
    reader = spark.readStream.schema(schema).format("parquet")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def tumbling(df: DataFrame, time: str, keys: list[str], width: str, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of value per key and window; rows later than the watermark are dropped."""
    rows = df.withWatermark(time, late) if df.isStreaming else df
    out = rows.groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total")


def sliding(df: DataFrame, time: str, keys: list[str], width: str, hop: str, late: str = "10 minutes") -> DataFrame:
    rows = df.withWatermark(time, late) if df.isStreaming else df
    out = rows.groupBy(F.window(time, width, hop), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total")


def sessions(df: DataFrame, time: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """One row a session of a key: its bounds, events and sum of value."""
    rows = df.withWatermark(time, late) if df.isStreaming else df
    out = rows.groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n", "total")


def running_totals(df: DataFrame, key: str) -> DataFrame:
    """(key, n, total) after every micro-batch, from state kept for each key."""

    def step(k, chunks: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for pdf in chunks:
            n, total = n + len(pdf), total + float(pdf["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [k[0]], "n": [n], "total": [total]})

    kind = df.schema[key].dataType.simpleString()
    out = f"`{key}` {kind}, n long, total double"
    return df.select(key, "value").groupBy(key).applyInPandasWithState(step, out, "n long, total double", "update", "NoTimeout")


def to_memory(df: DataFrame, name: str, mode: str = "append"):
    """Run a stream over what there is into a table of the session; for tests and small results."""
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def upsert(df: DataFrame, write_batch, checkpoint: str):
    """Hand every micro-batch to a function exactly once by its number, over what there is."""
    query = df.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
