"""Small helpers for Arrow-batch operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from lumenquery.session import ship

#: Bounds of an Arrow batch: whole texts travel in it, so it is kept short in rows and in bytes.
BATCH_ROWS, BATCH_BYTES = 400, 16 << 20


def _give_back() -> None:
    """Return freed memory to the system: worker processes outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: What bounds Spark's Arrow batches, and its values where nobody set any.
_SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}


def _bounded(spark: SparkSession) -> None:
    """Bound the session's Arrow batches in rows and bytes; a setting that the caller made stays.

    Spark reads them when a plan runs, long after this, so they can't be put back here.
    """
    for key, value in _SETTINGS.items():
        if not spark.conf._jconf.contains(key):
            spark.conf.set(key, str(value))


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with batches of bounded rows and bytes: larger ones are cut before fn sees them."""
    _bounded(df.sparkSession)
    ship(df.sparkSession)

    def short(batches):
        for b in batches:
            rows = b.num_rows
            step = max(1, min(BATCH_ROWS, rows * BATCH_BYTES // max(1, b.nbytes)))
            for at in range(0, rows, step):
                yield b.slice(at, step)

    def run(batches):
        try:
            yield from fn(short(batches))
        finally:
            _give_back()

    return df.mapInArrow(run, schema)


def texts(column: pa.Array) -> list[str]:
    """Python strings of a text column, null as the empty string."""
    return [x or "" for x in column.to_pylist()]
