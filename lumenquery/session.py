"""Session factory, table access and lineage cutting shared by the whole library."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def build_session(app: str = "lumenquery", cpus: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own through spark-submit."""
    n = cpus or os.cpu_count() or 8
    spark = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    ship(spark)
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once an application, so functions need no install there."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    root = Path(__file__).resolve().parent
    if not root.is_dir():  # the package came in an archive of its own
        return
    archive = Path(os.path.realpath(tempfile.mkdtemp(prefix="lumenquery-"))) / "lumenquery.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(str(archive))


#: Tables of text of at most this many bytes a core are dealt out to all cores; larger ones come in splits.
SMALL_BYTES = 8 << 20
TEXT_TABLES = frozenset(("documents", "pages", "conversations"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables, through Spark's own reader so any file system works.

    A small file is one row group, which one core would read: tables of text of a few megabytes are
    dealt out first. Filters and column choices still reach the scan.
    """
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in TEXT_TABLES:
        cores = spark.sparkContext.defaultParallelism
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if size <= SMALL_BYTES * cores and df._jdf.inputFiles().__len__() < cores:
            df = df.repartition(cores)
    return df


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Temp views over the Parquet tables for SQL text."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Only a local master may fall back to a folder of its own; a cluster without the setting is an
    error, since executors could not read each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lumenquery-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder, so a lost executor costs no recomputation."""
    ship(df.sparkSession)
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables written to a folder of their own in the shared folder, each deleted once it is not needed.

    Unlike checkpoints they are columnar and compressed, take no further disk after `free`, and leave
    nothing behind after `close`. A lost executor costs no recomputation, since every one reads them.
    """

    def __init__(self, spark: SparkSession):
        ship(spark)
        self.spark = spark
        self.folder = f"{checkpoint_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def store(self, df: DataFrame) -> DataFrame:
        """The rows of df from a written table; shuffle files of the work that made them go at once."""
        path = f"{self.folder}/{len(self._paths)}-{uuid.uuid4().hex[:8]}"
        with released_shuffles(self.spark):
            df.write.option("compression", "none").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = (out, path)
        return out

    def free(self, *tables: DataFrame) -> None:
        """Delete stored tables that nothing reads any more."""
        for t in tables:
            _, path = self._paths.pop(id(t), (None, None))
            if path:
                delete_path(self.spark, path)

    def close(self) -> None:
        delete_path(self.spark, self.folder)
        self._paths.clear()


@contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, a finished execution deletes its shuffle files; the caller's setting comes back after."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's file systems."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def epoch_seconds(column: str):
    """Seconds since 1970 of a timestamp column without time zone, as double."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {column})") / 1e6
