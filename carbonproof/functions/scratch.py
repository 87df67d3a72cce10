"""Folders for intermediate tables, and settings that hold for a block of code."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from threading import Lock

from pyspark.sql import DataFrame, SparkSession

#: For each setting that blocks hold, the values before them, the outermost first.
_BLOCKS: dict[tuple[int, str], list[list[str | None]]] = {}
_LOCK = Lock()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Only a local session may leave it unset and gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="carbonproof-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The session's setting has another value for what is written inside this block.

    Blocks of several threads may overlap: what was set before the first of them is set again after the last.
    """
    with _LOCK:
        blocks = _BLOCKS.setdefault((id(spark), key), [])
        own = [spark.conf.get(key, None)]
        blocks.append(own)
        spark.conf.set(key, value)
    try:
        yield
    finally:
        with _LOCK:
            at = next(i for i, block in enumerate(blocks) if block is own)
            del blocks[at]
            if at < len(blocks):
                blocks[at][0] = own[0]
            elif own[0] is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, own[0])


def dropping_shuffles(spark: SparkSession):
    """Writes inside this block remove their shuffle files as soon as they end, to hold less disk."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def small_batches(spark: SparkSession, rows: int = 1000):
    """What is written inside this block goes to Python workers in Arrow batches of at most ``rows`` rows."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    A lost executor costs its running tasks only, and no later job computes ``df`` again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with dropping_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_folder = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the folders of tables that ``materialise`` wrote, once nothing reads them any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.scratch_folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
