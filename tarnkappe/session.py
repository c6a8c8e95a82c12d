"""Session and folder helpers shared by the whole library."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only on a local master (tests, a laptop) where that is unset a
    temporary folder is made, one for each application; on a cluster the executors wouldn't see it.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
        named = _own[app]
    return named.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is created yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, passing: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage ends there, lost executors don't matter.

    The folder is added to ``passing``, if given, so that ``deleted`` can take it away after the table's last use.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    if passing is not None:
        passing.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys`` to as many tasks as shuffles have, before work that takes long for few bytes.

    A small file of many rows is read by one or two tasks; a number that is given isn't lowered by the size in bytes.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def deleted(spark: SparkSession, passing: list[str]) -> None:
    """Take away tables that nothing reads any more; what was made from them must have been written."""
    for path in passing:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    passing.clear()
    released(spark)


def released(spark: SparkSession) -> None:
    """Let finished shuffles go: Spark keeps their files until the driver's collector finds that nothing refers to them."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows in what is planned and run inside; the caller's setting comes back after it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Keep Arrow batches small, so that a batch of very long texts still fits a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
